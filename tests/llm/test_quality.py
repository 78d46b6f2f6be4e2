import random
from collections import Counter

import numpy as np
import pandas as pd

from chronocohort.llm import quality as Q


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def texts():
    rng = random.Random(1)
    bits = ["the", "cat", "é🙂", "#x", "A|B", "\n", "\n", "\t", " ", "sat"]
    return [None, "", "\n\n", "a", "a b c a b c", "x\n x\nx\n"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(150)]


def test_measures(spark):
    rows = [(i, t, -1) for i, t in enumerate(texts())]
    got = Q.measures(spark.createDataFrame(rows, "doc_id int, text string, n_words int")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t, _ in rows}


def test_fit_on_pattern_counts_is_fit_on_documents():
    counts = {"ggg": 80, "gga": 10, "bbg": 7, "bga": 3, "gbb": 5}
    by_count = Q.fit(counts)
    # The same by documents: each weighs 1, patterns are told apart by nothing but their votes.
    docs = [p for p, n in counts.items() for _ in range(n)]
    votes = np.array([["bag".index(v) for v in p] for p in docs])
    bad = (votes == 0).sum(1)
    good = np.where(bad == 0, 0.95, np.where(bad == 1, 0.3, 0.05))
    for _ in range(200):
        rates = np.empty((2, 3, 3))
        for k, p in enumerate((1 - good, good)):
            for r in range(3):
                seen = np.array([p[votes[:, r] == v].sum() + 0.1 + k * 0.3 * len(docs) * (0.01, 0.09, 0.9)[v] for v in range(3)])
                rates[k, r] = seen / seen.sum()
        for r in range(3):
            if rates[0, r, 0] < rates[1, r, 0]:
                rates[:, r] = rates[:, r].mean(0)
        share = good.mean()
        like = [np.log(s) + np.log(rates[k, np.arange(3), votes]).sum(1) for k, s in ((0, 1 - share), (1, share))]
        good = 1 / (1 + np.exp(like[0] - like[1]))
    assert {p: round(g, 6) for p, g in zip(docs, good)} == {p: round(g, 6) for p, g in by_count.items()}
    assert by_count["ggg"] > 0.5 > by_count["bbg"]


def test_a_bad_call_that_many_clean_documents_share_does_not_reject_them():
    rng = random.Random(3)
    bad = Counter("".join("b" if k in hit else "g" for k in range(8)) for hit in (rng.sample(range(8), 3) for _ in range(1000)))
    for share in (10, 20, 25, 30, 33, 40, 50):
        counts = Counter({"gggggggg": 90 * (100 - share), "gggggggb": 90 * share}) + bad
        got = Q.fit(counts)
        assert got["gggggggg"] > 0.9 and got["gggggggb"] > 0.9, share
        assert all(got[p] < 0.5 for p in bad), share
    assert Q.fit({"gggggggg": 700, "gggggggb": 300})["gggggggg"] > 0.5


def test_short_words_are_counted_in_code_points():
    n_short = Q.FIELDS.index("n_short")
    assert Q.measure("он и она 猫 été quatre".encode())[n_short] == 5


def test_verdicts_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    measured = Q.measures(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).drop("text").cache()
    judged = Q.judge(measured, Q.posterior(measured)).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    long = judged[~judged.base_failed]
    assert (long.kept == (long.quality == 1)).mean() == 1
    assert not judged[judged.base_failed].kept.any()


def test_edge_tables(spark):
    empty = Q.measures(spark.createDataFrame([], "doc_id long, text string"))
    assert Q.posterior(empty) == {} and Q.judge(empty, {}).count() == 0
    one = Q.measures(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    row = Q.judge(one, Q.posterior(one)).first()
    assert row.base_failed and not row.kept and row.n_words == 0
