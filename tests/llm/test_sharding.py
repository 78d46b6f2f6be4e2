import random
import zlib

from chronocohort.llm import sharding as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def run(spark, rows, shards):
    return S.slots(S.assign(S.rows(spark.createDataFrame(rows, SCHEMA)), shards)).collect()


def test_bytes_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 200), rng.choice(["en", "de", None]), rng.choice(["a"] * 5 + ["b", None]), rng.choice([None, i, 5]), "clash") for i in range(3000)]
    rows += [(9000, "copy" * 30, "en", "a", 120, None)] * 800 + [(None, None, None, None, None, None)] * 3
    got = run(spark, rows, 12)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    assert sorted(per) == list(range(12))
    sizes = [sum(r.size for r in p) for p in per.values()]
    slack = sum(sizes) / 12 * 0.0005
    assert max(sizes) - min(sizes) <= 2 * 4 * (max(r.size for r in got) + slack)  # a row and the slack at each of up to four splits, on both sides
    for p in per.values():
        assert sorted(r.slot for r in p) == list(range(len(p)))


def test_reruns_agree(spark):
    rows = [(i, "x" * (i % 50), "en", f"s{i % 4}", i, None) for i in range(200)]
    one, two = (sorted((r.doc_id, r.shard) for r in run(spark, rows, 5)) for _ in range(2))
    assert one == two


def test_the_layout_of_the_files_makes_no_difference(spark):
    rng = random.Random(2)
    rows = [(rng.choice([i, i, None, 7]), "x" * rng.randint(0, 90), rng.choice(["en", "de", None]), f"s{i % 4}", rng.choice([i, None]), None) for i in range(700)] + [(5, "same", "en", "s1", 4, None)] * 60
    df = spark.createDataFrame(rows, SCHEMA)

    def placed(layout):
        return sorted(((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.slot) for r in S.slots(S.assign(S.rows(layout), 9)).collect()))

    one = placed(df)
    rng.shuffle(rows)
    assert one == placed(df.repartition(5)) == placed(spark.createDataFrame(rows, SCHEMA).repartition(13, "text"))


def test_splits_follow_more_than_one_dimension(spark):
    """Each dimension is measured by its own spread, so that categories of even frequency and sizes take turns."""
    rng = random.Random(4)
    rows = [(i, "x" * int(rng.paretovariate(0.9)) , rng.choice("abcd"), rng.choice("efgh"), None, None) for i in range(2000)]
    dims = {tuple(r.dims[:2]) for r in S.rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({d[0] for d in dims}) == len({d[1] for d in dims}) == 4 and max(d[0] for d in dims) > 40_000


def test_few_rows_and_none(spark):
    assert [(r.shard, r.slot) for r in run(spark, [(1, "a", "en", "s", 1, None)], 8)][0][1] == 0
    assert run(spark, [], 8) == []


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i, "en", "s", i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    S.write(docs, S.slots(S.assign(S.rows(docs), 4)), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 40 and back.select("shard").distinct().count() == 4
