"""One query per operator, over its whole table; see each operator's module for what nulls, ties and empty tables give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocohort.llm import bpe, extraction, ledger, lexical, mixing, multiset, permutation, quality, recompression, sharding, simhash, trie, warc
from chronocohort.llm.base import table
from chronocohort.session import durable, output_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op6_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    simhash.small_batches(spark)
    prints = durable(docs.select("doc_id", simhash.fingerprints().alias("fp")))
    return simhash.near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = durable(quality.measures(docs).drop("text"))
    judged = quality.judge(measured, quality.posterior(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "p_good")


@query
def op1_bpe(spark, sf_dir):
    import public_tokenizers

    file = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    encode, decode = bpe.encoder(spark, file), bpe.decoder(spark, file)
    coded = table(spark, sf_dir, "documents").select("doc_id", encode("text").alias("ids"))
    both = coded.select("doc_id", "ids", decode("ids").alias("decoded"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_warc(spark, sf_dir):
    folder = output_path(spark, "warc")
    warc.write(warc.plan(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return warc.read(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to,
       NOT (payload_bytes >= 1000 AND page_id IS DISTINCT FROM last) AS verified FROM m
"""


@query
def op3_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    book = ledger.Ledger(spark, output_path(spark, "ledger"))
    found = ledger.join_back(ledger.scan(docs, book, ["doc_id"]), book)
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in ("assign", "access", "hex")}
    return found.withColumns(counts).withColumn("spans", spans).select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLES["op3_secrets"] = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
m AS (
  SELECT rid, 0 AS no, 'assign' AS kind, regexp_extract_all(body, '{_ASSIGN}') AS hits, string_split_regex(body, '{_ASSIGN}') AS gaps FROM t
  UNION ALL SELECT rid, 1, 'access', regexp_extract_all(body, 'AKIA[A-Z0-9]+'), string_split_regex(body, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT rid, 2, 'hex', regexp_extract_all(body, '[0-9a-f]+'), string_split_regex(body, '[0-9a-f]+') FROM t),
e AS (SELECT rid, no, kind, i, hits[i] AS hit, length(gaps[i]) + length(hits[i]) AS moved FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
p AS (SELECT rid, no, kind, hit, sum(moved) OVER (PARTITION BY rid, no ORDER BY i) AS stop FROM e),
f AS (SELECT rid, no, kind, stop - length(hit) AS start, stop FROM p
      WHERE CASE no WHEN 0 THEN length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 12 WHEN 1 THEN length(hit) >= 18 ELSE length(hit) >= 16 END),
s AS (SELECT rid, count(*) FILTER (WHERE no = 0) AS a, count(*) FILTER (WHERE no = 1) AS b, count(*) FILTER (WHERE no = 2) AS c,
             string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, no) AS spans FROM f GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (rid)
"""


@query
def op5_kd_shards(spark, sf_dir):
    placed = sharding.slots(sharding.assign(sharding.rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")), 40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_mixing(spark, sf_dir):
    mixed = mixing.mix(mixing.sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mixing"] = mixing.ORACLE


@query
def op4_permutation(spark, sf_dir):
    rows = permutation.valid(table(spark, sf_dir, "embeddings"))
    return permutation.search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


@query
def op7_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", extraction.main_text(spark).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_recompression(spark, sf_dir):
    kept = recompression.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_fptree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), 10)


ORACLES["op11_fptree"] = lexical.ORACLE


@query
def op12_multiset(spark, sf_dir):
    return multiset.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_trie(spark, sf_dir):
    return trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLES["op13_trie"] = trie.ORACLE
