import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronocohort.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n \n", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext", "don't we'll I'M", "漢字🙂 é́ ñ٣٤", "\x00\x1c\x85 ​", "aaaa" * 300, "ab" * 500, " " * 700, "the " * 3000]


@pytest.fixture(scope="module")
def codec():
    with open(FILE, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def noise(n):
    rng = random.Random(5)
    letters = "ab cde\n\t éèß漢字🙂'sS12٣  _-<|>tionthe "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encodes_as_the_library(codec, library):
    texts = ODD + noise(3000)
    for text, ids, want in zip(texts, codec.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text[:80]
        assert codec.vocabulary.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_pairs_are_judged_as_exact_merging_does(codec):
    rng, v = random.Random(2), codec.vocabulary
    tokens = [b for b in v.ids if len(b) < 9]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(4000)]
    a, b = (np.array([v.ids[p[i]] for p in pairs]) for i in range(2))
    fits = v.compatible(a, b)
    assert fits.tolist() == [v.merge(x + y) == [v.ids[x], v.ids[y]] for x, y in pairs]
    assert 0 < fits.sum() < len(fits)


def test_failing_proposals_are_merged(codec):
    words, v = sorted({w.encode() for t in noise(2000) for w in codec.words.findall(t)}), codec.vocabulary
    exact = [v.merge(w) for w in words]
    assert [np.frombuffer(x, np.int32).tolist() for x in v.encode_words(words)] == exact
    token, word = v.propose(words)
    greedy = [[] for _ in words]
    for t, w in zip(token.tolist(), word.tolist()):
        greedy[w].append(t)
    assert sum(g != e for g, e in zip(greedy, exact)) > 50
    for g, w in zip(greedy, words):
        at = 0
        for t in g:  # each is the longest token there
            n = next(n for n in range(len(w) - at, 0, -1) if w[at : at + n] in v.ids)
            assert v.ids[w[at : at + n]] == t
            at += n


def test_both_ways_of_merging(codec):
    v = codec.vocabulary
    for w in (b"aaaaaaa", b" thethethe", "ééé漢".encode(), b"x" * 40):
        assert v.merge(w) == v._merge_long(w)


def test_forgetting_words_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "SLICE", 30)
    texts = noise(200)
    assert [x.tolist() for x in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_in_pieces(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "WORDS", 7)
    text = "It's a long text <|endoftext|> of   many words,\n\n 12345 of them. " * 20
    assert next(codec.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_columns(spark, library):
    file = bpe.load(spark, FILE)
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", bpe.encoder(spark, file)("text").alias("ids"))
    got = df.select("doc_id", "ids", bpe.decoder(spark, file)("ids").alias("back")).collect()
    assert sorted((r.doc_id, r.ids, r.back) for r in got) == sorted((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert df.where("false").count() == 0
    bad = spark.createDataFrame([(None,), ([],), ([-1, 99999999, 262],)], "ids array<int>")
    assert [r[0] for r in bad.select(bpe.decoder(spark, file)("ids")).collect()] == ["", "", " the"]


def test_tasks_of_a_worker_share_what_is_built_and_known():
    with open(FILE, encoding="utf-8") as f:
        source = f.read()
    coder = bpe.shared_encoder(source)
    words = [f"zq{i:x}xj" for i in range(100_000)]
    first = list(coder.encode([" ".join(words)]))[0]
    again, asked = bpe.shared_encoder(source), []
    assert again is coder and bpe.shared_pieces(source) is bpe.shared_pieces(source)
    work, again.vocabulary.encode_words = again.vocabulary.encode_words, lambda new: asked.extend(new) or work(new)
    try:
        assert list(again.encode([" ".join(words)]))[0].tolist() == first.tolist()
    finally:
        del again.vocabulary.encode_words
    assert not asked  # 100,000 distinct words are remembered
