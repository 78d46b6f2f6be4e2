"""Quality rules by weak supervision.

Each rule votes that a document is good (1) or bad (-1), or abstains (0).  Which rules can be trusted is not given but estimated: a latent
class, good or bad, explains the votes, and expectation-maximisation finds the share of good documents and, for every rule, how often it
votes each way on good and on bad documents.  A document's posterior probability of being good replaces all-must-pass filtering.

The votes of all documents are summed by pattern in Spark.  There are at most 3 ** rules patterns, whatever the corpus, so fitting on the
pattern counts uses every document, is exact, and only that bounded table reaches the driver.

Null or empty texts have no word, fail the base test and are not kept.  Repeated rows are judged alike.  An empty table gives an empty
result.  Other columns are left as they are; a column that has the name of an added one is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocohort.llm.base import raw_texts, small_batches

SYMBOLS = "#*$%&|<>"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_short"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SHORT_WORD = 3  # code points

#: (name, bad when, good when) over the measures below; in between the rule abstains.
RULES = [
    ("length", "n_words < 60", "n_words >= 80"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 12 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.03 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.15 * n_words"),
    ("capitals", "n_upper > 0.4 * n_letters", "n_upper <= 0.15 * n_letters"),
    ("shouts", "n_shouts > 0.2 * n_words", "n_shouts <= 0.05 * n_words"),
    ("short_words", "n_short < 0.05 * n_words", "n_short >= 0.15 * n_words"),
]


#: What rules are expected to say of good documents (bad, abstain, good), and how much that counts against what they say: a share of all
#: documents, so that corpora of any size are treated alike.  It counts only where twice as many documents are found good and the cleanest
#: votes are among them; else it outweighs the documents, and they are fitted by themselves.
EXPECTED, STRENGTH = (0.01, 0.09, 0.9), 0.3


def measure(data: bytes) -> tuple[int, ...]:
    """The figures named in FIELDS for one text in UTF-8."""
    words = data.split()
    n = len(words)
    chars = np.frombuffer(b"".join(words), np.uint8)
    leads = (chars & 0xC0) != 0x80
    points = int(leads.sum())
    upper = int(((chars >= 65) & (chars <= 90)).sum())
    letters = upper + int(((chars >= 97) & (chars <= 122)).sum())
    symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if n >= 3:
        codes: dict[bytes, int] = {}
        c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        _, pair = np.unique(c[:-1] * len(codes) + c[1:], return_inverse=True)
        _, which, times = np.unique(pair[:-1] * len(codes) + c[2:], return_inverse=True, return_counts=True)
        twice = times[which] >= 2
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    sizes = np.fromiter(map(len, words), np.int64, n)
    if n and points < len(chars):
        sizes = np.add.reduceat(leads, np.cumsum(sizes) - sizes, dtype=np.int64)
    short = int((sizes <= SHORT_WORD).sum())
    return n, points, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, data.count(b"!"), short


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in FIELDS]))
def _measures(texts: pa.Array) -> pa.Array:
    rows = [measure(x) for x in raw_texts(texts)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))], names=FIELDS)


# Called nondeterministic so that no filter on a measure is moved below and has it evaluated a second time.
_measures_once = _measures.asNondeterministic()


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the figures of FIELDS."""
    small_batches(docs.sparkSession)
    held = "_measures" + "_" * max(len(c) for c in docs.columns)
    out = docs.withColumn(held, _measures_once(F.col(text)))
    return out.withColumns({f: F.col(f"{held}.{f}") for f in FIELDS}).drop(held)


def pattern() -> Column:
    """The votes of all rules as one text, a letter each: b, g or a for abstain."""
    return F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("a") for _, bad, good in RULES])


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def fit(counts: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation over the counts.

    Start: a document that no rule calls bad is good with 0.95, one call makes it 0.3, more 0.05.  Every rule's rates are smoothed by a tenth
    of a document, those on good documents also by what is expected there, and tied to their meaning: a rule calls bad documents bad at
    least as often as good ones.
    """
    if not counts:
        return {}
    found = _fit(counts, STRENGTH, rounds, tolerance)
    cleanest = min(counts, key=lambda p: (p.count("b"), -p.count("g"), p))
    if found[cleanest] < 0.5 or sum(n * found[p] for p, n in counts.items()) < 2 * STRENGTH * sum(counts.values()):
        found = _fit(counts, 0.0, rounds, tolerance)
    return found


def _fit(counts: dict[str, int], strength: float, rounds: int, tolerance: float) -> dict[str, float]:
    names = sorted(counts)
    weight = np.array([counts[p] for p in names], float)
    votes = np.array([["bag".index(v) for v in p] for p in names])
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)  # pattern, rule, vote
    bad_calls = (votes == 0).sum(1)
    good = np.where(bad_calls == 0, 0.95, np.where(bad_calls == 1, 0.3, 0.05))
    for _ in range(rounds):
        rates = []
        for p, before in ((1 - good, 0.1), (good, 0.1 + strength * weight.sum() * np.array(EXPECTED))):
            seen = np.einsum("p,prv->rv", weight * p, one_hot) + before
            rates.append(seen / seen.sum(1, keepdims=True))
        turned = rates[0][:, 0] < rates[1][:, 0]
        rates[0][turned] = rates[1][turned] = (rates[0][turned] + rates[1][turned]) / 2
        share = np.clip((weight * good).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        like = [np.log(s) + np.einsum("prv,rv->p", one_hot, np.log(r)) for s, r in ((1 - share, rates[0]), (share, rates[1]))]
        after = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        done = np.abs(after - good).max() < tolerance
        good = after
        if done:
            break
    return dict(zip(names, (float(round(x, 9)) for x in good)))


def posterior(measured: DataFrame) -> dict[str, float]:
    """Fit on all documents of ``measured`` that pass the base test."""
    rows = measured.where(~base_failed()).groupBy(pattern().alias("p")).count().collect()  # at most 3 ** len(RULES) rows
    return fit({r["p"]: r["count"] for r in rows})


def judge(measured: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``votes``, ``p_good`` and ``kept``."""
    out = measured.withColumn("base_failed", base_failed()).withColumn("votes", pattern())
    known = F.create_map(*[F.lit(x) for pair in model.items() for x in pair]) if model else F.lit(None).cast("map<string,double>")
    out = out.withColumn("p_good", F.coalesce(F.element_at(known, F.col("votes")), F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
