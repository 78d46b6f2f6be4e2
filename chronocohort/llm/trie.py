"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

Each conversation c is rebuilt as the first h turns of conversation c - c % 20 (h = crc32 of c in decimal, mod 4) and its own turns after its first h.
Each distinct sequence of first d rebuilt turns is a node, from the root without turns on; members of a node are the conversations that begin with
it.  A node is named by (conv_id, depth), as no two nodes of one depth share a member: conv_id is its smallest one.

**Nodes without walking.**  Turns are numbered in chunks, also where one conversation holds a third of them.  The key of a prefix is the running sum of
hashes of (place, turn), 128 bits in four lanes; nodes are the groups of equal keys, and the parent of a node is where its conv_id stands one turn earlier.

**Rollup.**  Sums over subtrees come from a centroid decomposition of the forest of parent edges.  In a component of n nodes, those whose subtree
holds more than n / 2 form one path down from its top; the lowest is the centroid.  Taking it out leaves the part above and one component for each child,
none larger than n / 2.  The total of the centroid and what is below it is the centroid's own result and is added to all nodes on the path from the centroid
to the top; then the parts are split again.  So a node's sum is complete after at most log2(n) rounds, each linear, however deep or wide the tree is.
Sizes of the first component, the whole trie, come from one aggregation over (member, depth) rows; later ones by subtracting what is cut off.  Rounds run in
Spark, each written to the shared folder, as long as a component has more than LOCAL nodes; smaller ones are split on in one task each, by the same steps.

Conversations without conv_id take no part (they have no number to rebuild from).  A null turn comes first; equal turns follow the hash of role and text; null
role or text is empty.  c % 20 has the sign of c.  Turnless rebuilt conversations end at the root.  Repeated rows are repeated turns.  Empty tables give an empty
result.  Very long texts are hashed and counted at once, only their digest moves on.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.llm.base import WORD, batches, small_batches, text_of
from chronocohort.operators.ordering import magnitude_chunk, prefix_sums, running_index
from chronocohort.session import durable

GROUP = 20
HEADS = 4
LOCAL = 10_000
CHUNK = 4096
LANES = ["k0", "k1", "k2", "k3"]
COMP = ["top", "top_depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, words): each conversation's turns by place, from 1."""
    role, text = text_of("role"), text_of("text")
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    chunk = F.coalesce(magnitude_chunk(F.col("turn")), F.lit(-(1 << 62)))
    return running_index(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_hash")], chunk, "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "turn_hash", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of each conversation, and (conv_id, depth, turn_hash, words) of its rebuilt turns."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = durable(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))).alias("length")))
    heads = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_hash", "words")
    heads = convs.where("head > 0").select("conv_id", "base", "head").join(heads, "base").where("depth <= head").select("conv_id", "depth", "turn_hash", "words")
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "turn_hash", "words")
    return convs.select("conv_id", "length"), heads.unionByName(tails)


def _lane(k: int) -> Column:
    half = F.xxhash64("depth", "turn_hash", F.lit(k // 2))
    return F.shiftrightunsigned(half, 32) if k % 2 else half.bitwiseAND(0xFFFFFFFF)


def members(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, node, ends) for each conversation and node it is a member of, and the nodes (node, depth, n_convs, words)."""
    convs, rows = rebuilt(durable(numbered(conversations)))
    rows = rows.withColumns({f"own_{k}": _lane(i) for i, k in enumerate(LANES)})
    keyed = prefix_sums(rows, ["conv_id"], [F.col("depth")], F.floor(F.col("depth") / CHUNK), {k: f"own_{k}" for k in LANES})
    keyed = durable(keyed.join(convs, "conv_id").select("conv_id", "depth", *LANES, "words", (F.col("depth") == F.col("length")).alias("ends")))
    nodes = durable(keyed.groupBy("depth", *LANES).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words")))
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0")  # one row
    at_root = convs.crossJoin(F.broadcast(root)).select("conv_id", F.lit(0).cast("long").alias("depth"), "node", (F.col("length") == 0).alias("ends"))
    inside = keyed.join(nodes.select("depth", *LANES, "node"), ["depth", *LANES]).select("conv_id", "depth", "node", "ends")
    all_nodes = nodes.select("node", "depth", "n_convs", "words").unionByName(root.select("node", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words")))
    return durable(inside.unionByName(at_root)), all_nodes


def _endings(members_: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of nodes at which conversations end.  Ids are joined in chunks of at most CHUNK; the digest of a node
    reads its chunks in order, one after the other, as SHA-256 must."""
    ids = members_.where("ends").groupBy("node", "depth", F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ids.agg(text.alias("ids")).repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk")

    def digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, state = None, None
            for batch in stream:
                for node, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                    if at == (node, depth):
                        state.update(b"," + ids.encode())
                        continue
                    if at:
                        yield (*at, state.hexdigest())
                    at, state = (node, depth), hashlib.sha256(ids.encode())
            if at:
                yield (*at, state.hexdigest())

        return batches(rows(), pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

    return chunks.select("node", "depth", "ids").mapInArrow(digests, "node long, depth long, ends_sha256 string")


def _sizes(members_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, depth, size): nodes in each subtree.  The nodes named after one conversation form a chain down to where it ends; a member adds its whole
    chain to the nodes above it, and what is left of it to the nodes in it."""
    chains = nodes.groupBy(F.col("node").alias("conv_id")).agg(F.min("depth").alias("first"), F.max("depth").alias("last"))
    added = F.when(F.col("node") == F.col("conv_id"), F.col("last") - F.col("depth") + 1).otherwise(F.col("last") - F.col("first") + 1)
    return members_.join(chains, "conv_id").groupBy("node", "depth").agg(F.sum(added).alias("size"))


def split(parent: list[int], weights: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Subtree sums of one component by centroid decomposition; nodes stand below their parents, parent[0] is -1."""
    n = len(parent)
    sums = [[0, 0] for _ in range(n)]
    mark, size = [-1] * n, [0] * n
    todo = [list(range(n))]
    while todo:
        part = todo.pop()
        for v in part:
            size[v], mark[v] = 1, -1
        for v in reversed(part[1:]):
            size[parent[v]] += size[v]
        path = [v for v in part if 2 * size[v] > len(part)]
        z = path[-1]
        below: dict[int, list[int]] = {}
        above = []
        total = list(weights[z])
        for v in part:
            if v == z:
                continue
            up = parent[v] if v != part[0] else -1
            mark[v] = v if up == z else (mark[up] if up >= 0 else -1)
            if mark[v] < 0:
                above.append(v)
            else:
                below.setdefault(mark[v], []).append(v)
                total[0] += weights[v][0]
                total[1] += weights[v][1]
        for v in path:
            sums[v][0] += total[0]
            sums[v][1] += total[1]
        todo += [x for x in (above, *below.values()) if x]
    return [tuple(s) for s in sums]


def _finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (top, top_depth, node, depth, parent, leaf, saved, n_leaves, saved_tokens) in order of component and depth in; the last two completed out."""

    def rows() -> Iterator[tuple]:
        part, at = [], None

        def done() -> Iterator[tuple]:
            index = {(r[2], r[3]): i for i, r in enumerate(part)}
            parent = [-1, *(index[r[4], r[3] - 1] for r in part[1:])]
            for r, (leaves, saved) in zip(part, split(parent, [(r[5], r[6]) for r in part])):
                yield r[2], r[3], r[7] + leaves, r[8] + saved

        for batch in stream:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:2] != at:
                    if part:
                        yield from done()
                    part, at = [], r[:2]
                part.append(r)
        if part:
            yield from done()

    return batches(rows(), pa.schema([(k, pa.int64()) for k in ("node", "depth", "n_leaves", "saved_tokens")]))


def rollup(forest: DataFrame, members_: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, depth, n_leaves, saved_tokens): sums over subtrees of ``leaf`` and ``saved``.

    ``forest`` has (node, depth, parent, size, leaf, saved) and one root."""
    spark = forest.sparkSession
    root = forest.where("depth = 0").select(F.col("node").alias("top"), F.col("depth").alias("top_depth"))
    zero = F.lit(0).cast("long")
    now = durable(forest.crossJoin(F.broadcast(root)).withColumns({"n_leaves": zero, "saved_tokens": zero}))
    before = members_.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("step_parent"))
    steps = durable(members_.where("depth > 0").select("conv_id", "depth", F.col("node").alias("step")).join(before, ["conv_id", "depth"]))
    settled, results = [], []
    while True:
        tops = now.groupBy(*COMP).agg(F.max("size").alias("n"))
        large = durable(tops.where(F.col("n") > local))
        if large.isEmpty():
            settled.append(now)
            break
        settled.append(now.join(large, COMP, "left_anti"))
        part = now.join(large, COMP)
        heavy = 2 * F.col("size") > F.col("n")
        centre = durable(part.where(heavy).groupBy(*COMP).agg(F.max(F.struct("depth", "node", "size")).alias("z")).select(*COMP, F.col("z.node").alias("z"), F.col("z.depth").alias("z_depth"), F.col("z.size").alias("z_size")))
        part = part.join(centre, COMP).withColumn("path", heavy & (F.col("depth") < F.col("z_depth"))).withColumn("is_z", (F.col("node") == F.col("z")) & (F.col("depth") == F.col("z_depth")))
        down = steps.select(F.col("conv_id").alias("node"), (F.col("depth") - 1).alias("z_depth"), "step", "step_parent")
        part = part.join(down, ["node", "z_depth"], "left")
        below = F.coalesce((F.col("depth") > F.col("z_depth")) & (F.col("step_parent") == F.col("z")), F.lit(False))
        part = durable(part.withColumn("below", below).drop("step_parent", "n"))
        totals = part.where("below or is_z").groupBy(*COMP).agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        part = part.join(totals, COMP)
        gains = F.col("path") | F.col("is_z")
        part = part.select(
            F.when(F.col("below"), F.col("step")).otherwise(F.col("top")).alias("top"), F.when(F.col("below"), F.col("z_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            "node", "depth", "parent", (F.col("size") - F.when(F.col("path"), F.col("z_size")).otherwise(0)).alias("size"), "leaf", "saved",
            (F.col("n_leaves") + F.when(gains, F.col("more_leaves")).otherwise(0)).alias("n_leaves"), (F.col("saved_tokens") + F.when(gains, F.col("more_saved")).otherwise(0)).alias("saved_tokens"), "is_z")
        part = durable(part)
        results.append(part.where("is_z").select("node", "depth", "n_leaves", "saved_tokens"))
        now = part.where("not is_z").drop("is_z")
    small_batches(spark)
    for rest in settled:
        rest = rest.select(*COMP, "node", "depth", "parent", "leaf", "saved", "n_leaves", "saved_tokens")
        results.append(rest.repartition(*COMP).sortWithinPartitions(*COMP, "depth").mapInArrow(_finish, "node long, depth long, n_leaves long, saved_tokens long"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    members_, nodes = members(conversations)
    nodes = durable(nodes)
    above = members_.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    tree = durable(nodes.join(above, ["node", "depth"], "left").join(_sizes(members_, nodes), ["node", "depth"]))
    children = tree.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = durable(tree.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    sums = rollup(tree.select("node", "depth", "parent", "size", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), members_, local)
    out = tree.join(sums, ["node", "depth"]).join(_endings(members_), ["node", "depth"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::UBIGINT, 999, 999, 999, 999, 999, 999, 999, 999])),
             lambda a, x: CASE WHEN x < 999 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns)),
heads AS (SELECT c, pos AS d, role, text FROM convs JOIN turns ON conv_id = base AND pos <= h),
lengths AS (SELECT c, h, count(d) AS head FROM convs LEFT JOIN heads USING (c) GROUP BY c, h),
rebuilt AS (
  SELECT c, d, role, text FROM heads UNION ALL
  SELECT c, head + pos - h, role, text FROM lengths JOIN turns ON conv_id = c AND pos > h),
paths AS (SELECT c, coalesce(list(struct_pack(r := role, t := text) ORDER BY d) FILTER (d IS NOT NULL), []) AS path FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c),
prefixes AS (SELECT c, unnest(range(0, len(path) + 1)) AS depth, path FROM paths),
nodes AS (
  SELECT depth, path[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(path) = depth), '') AS ends
  FROM prefixes GROUP BY depth, path[1:depth]),
family AS (
  SELECT a.*, p.conv_id AS parent, len(regexp_extract_all(coalesce(a.path[a.depth].t, ''), '{WORD}')) * (a.n_convs - 1) AS saved,
         (SELECT count(*) FROM nodes b WHERE b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path) AS n_children
  FROM nodes a LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.path = a.path[1:a.depth - 1]),
up AS (SELECT unnest(range(0, depth + 1)) AS depth, path, saved, n_children FROM family),
sums AS (SELECT depth, path[1:depth] AS path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM up GROUP BY depth, path[1:depth])
SELECT conv_id, CAST(f.depth AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM family f JOIN sums s ON s.depth = f.depth AND s.path = f.path
"""
