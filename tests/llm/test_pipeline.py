"""Every stage against a plain version of its decision, on tables with nulls, copies, ties and clashing columns."""

import random

import corpus_pipeline as P
import public_tokenizers
from test_ledger import brute as spans
from test_mixing import brute as mixed
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, fp string, n_words string, k int, words int"


def docs_of(n=120):
    rng = random.Random(11)
    names = ["the", "of", "and", "to", "in"] + [f"word{k}" for k in range(400)]
    out = []
    for i in range(n):
        body = " ".join(rng.choice(names[:5] if rng.random() < 0.4 else names) for _ in range(rng.randint(90, 260)))
        if i % 9 == 1:
            body += " password = abcdefghijkl0123"
        if i % 10 == 2:
            body = " ".join(w + "$$$" for w in body.split())
        out.append([i, body])
    for i in range(30):
        out.append([n + i, out[i][1] if i % 2 else out[i][1] + " end"])
    out += [[n + 50, None], [n + 51, ""], [n + 52, "few words"], [3, out[3][1]], [3, out[3][1]], [None, out[4][1]], [None, "the of and " + out[5][1]]]
    return [(i, t, "en", rng.choice(["a", "a", "b", None]), None if t is None else len(t), "clash", 1, "x", "y", 2, 3) for i, t in out]


def stage(spark, number, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = P.STAGES[number][1](spark, docs, "/none")
    if number < 4:
        assert out.columns == docs.columns
    return [tuple(r) for r in out.collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_quality_keeps_clean_documents(spark):
    rows = docs_of()
    kept = stage(spark, 0, rows)
    assert order(kept) == order([r for r in rows if r[1] and len(r[1].split()) >= 50 and "$$$" not in r[1]])


def test_one_of_each_group_of_near_copies_stays(spark):
    rows = docs_of()
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, repr(r)))
    label = brute_components([brute_print(r[1]) for r in by_id])
    got = stage(spark, 1, rows)
    assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in (by_id[i] for i in set(label)))


def test_documents_with_secrets_go(spark):
    rows = docs_of()
    assert order(stage(spark, 2, rows)) == order([r for r in rows if not spans(r[1])])


def test_documents_with_long_numbers_stay(spark):
    texts = ["call 9807915762804490 now", "1" * 5000, "key 98079157628044a0 now", "id 98079157628044900f", "fe 0123456789 abcdef", "AKIA99999999999999", "token=1234567890123456"]
    rows = [(i, t, "en", "a", len(t), "clash", 1, "x", "y", 2, 3) for i, t in enumerate(texts)]
    assert sorted(r[0] for r in stage(spark, 2, rows)) == [0, 1, 4]


def test_copies_go_to_the_rows_that_the_mix_takes(spark):
    # Source b is taken often; every doc_id is in a too, as are rows without an id and without words.
    rng = random.Random(5)
    rows = [(i % 40 if i % 7 else None, " ".join(rng.choice("xyz") + str(i) for _ in range(rng.choice([0, 5, 9, 400 if i < 40 else 9]))) or rng.choice([None, ""]), "en", "a" if i < 40 else rng.choice(["b", "c", None]), 1, "clash", 1, "x", "y", 2, 3) for i in range(240)]
    want, got = {}, {}
    for _, s, _, target, _, t in mixed([(r[0], r[1], r[3]) for r in rows]):
        want[s] = want.get(s, 0) + t
    for r in stage(spark, 3, rows):
        got[r[3]] = got.get(r[3], 0) + len(r[1].split())
    assert got == {s: t for s, t in want.items() if t}


def test_documents_are_repeated_as_the_mix_takes_them(spark):
    rows = docs_of()
    got = stage(spark, 3, rows)
    taken = {}
    for i, s, n, _, _, t in mixed([(r[0], r[1], r[3]) for r in rows]):
        taken[i, s, n] = taken.get((i, s, n), 0) + t
    seen = {}
    by_key = {(r[0], r[3], len((r[1] or "").split())): r for r in rows}
    for r in got:
        n = len(r[1].split())
        whole = [k for k in by_key if k[0] == r[0] and k[1] == r[3] and any(x[1] == r[1] for x in rows if x[0] == r[0] and x[3] == r[3])]
        of = next((k for k in whole if k[2] == n), None) or next(k for k in by_key if k[0] == r[0] and k[1] == r[3] and k[2] > n and (by_key[k][1] or "").split()[:n] == r[1].split())
        assert r[4] == len(r[1]) and r[5:] == by_key[of][5:]
        seen[of] = seen.get(of, 0) + n
    assert seen == {k: t for k, t in taken.items() if t}


def test_tokens(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs_of(20)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.STAGES[4][1](spark, docs, "/none").collect()
    assert all(r.restored and r.n_tokens == len(r.ids) for r in got)
    assert order((r.doc_id, r.source, r.ids) for r in got) == order((r[0], r[3], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)


def test_whole_run_and_empty_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(docs_of(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    got = P.run(spark, folder)
    assert got.count() > 60 and got.where("not restored").count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/none/documents.parquet")
    assert P.run(spark, f"{folder}/none").count() == 0
