"""Prefix trie of conversations: digest-keyed nodes, rolled up to all ancestors by pointer jumping.

A node is a distinct sequence of first turns. Its key is a SHA-256 over its depth and eight lanes, each the sum, over its
turns, of a part of the SHA-256 of (depth, role, text): a prefix sum, so prefixes of one conversation are keyed by a running
sum that may be cut anywhere, and the parent's key follows from a row alone. Texts are digested where they are read and never
shuffled. Leaf counts and savings then climb by doubling: after round k a node holds what lies less than 2^k below it and
points to its ancestor 2^k above; one round adds to every node what its descendants at exactly that distance hold. Depth d
takes ceil(log2(d + 1)) rounds, each one aggregate and two joins over the nodes that still point somewhere, which at least
halve the depth that is left; every round is a written table.

Cases: rows without conv_id belong to no conversation; a null role or text is empty; equal turn numbers are ordered by the
digest of role and text, and repeated rows are turns of their own; an empty table has no node, not even the root; extra
columns are not read. Long conversations are numbered and summed in chunks of 4,096 turn numbers, and hot keys (one long
conversation, one common first turn) are broadcast by `common.join_hot`, so that no task holds one conversation or node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .oracle import CRC32_SQL, crc32_sql

CHUNK_BITS = 12
LANES = [f"lane{i}" for i in range(8)]


def running(df: DataFrame, key: str, chunk: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with running sums of `values` per key, in (chunk, order): summed within chunks and raised by the chunks before."""
    upto = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(key, chunk).agg(*[F.sum(v).alias(f"{n}_below") for n, v in values.items()])
    below = sums.select(key, chunk, *[F.coalesce(F.sum(f"{n}_below").over(before), F.lit(0)).alias(f"{n}_below") for n in values])
    inside = df.withColumns({n: F.sum(v).over(upto) for n, v in values.items()})
    return inside.join(below, [key, chunk]).withColumns({n: F.col(n) + F.col(f"{n}_below") for n in values}).drop(*[f"{n}_below" for n in values])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n): turns numbered from 0 in the order of `turn`, null first, with the code points of their text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("n"),
        F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(2**63))).alias("chunk"),
    )
    placed = running(common.save(said, "prefix-said"), "conv_id", "chunk", [F.col("turn").asc_nulls_first(), F.col("digest")], {"place": F.lit(1)})
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "digest", "n")


def rebuild(turned: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: of (conv_id, length) and (conv_id, depth, digest, n), depth from 1.

    The first h = crc32(conv_id) % most turns of c come from conversation c - c % group, where it has them; c's own turns
    after its first h follow.
    """
    own = F.crc32(F.col("conv_id").cast("string")) % most
    sizes = turned.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len")).withColumns({"h": own, "base": F.col("conv_id") - F.col("conv_id") % group})
    heads = sizes.filter("base = conv_id").select("base", F.col("len").alias("base_len"))
    c = sizes.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("base_len", F.lit(0))))
    c = c.select("conv_id", "len", "h", "base", "m", (F.col("m") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("length"))
    c = common.save(c, "prefix-conversations")
    lent = turned.filter((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    first = c.select("conv_id", "h", "base").join(lent, "base").filter("place < h")
    rest = common.join_hot(turned, c.select("conv_id", "h", "m", "len"), "conv_id", "len", turned.count()).filter("place >= h")
    both = first.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "n").unionByName(
        rest.select("conv_id", (F.col("m") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "n")
    )
    return c.select("conv_id", "length"), both


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[(x % 2**32).cast("string") for x in lanes]), 256))


def prefixes(lengths: DataFrame, sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, n, ends): a row for each conversation and each of its beginnings, the root's too."""
    part = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    parts = sequences.withColumn("part", part).select(
        "conv_id", "depth", "n", F.shiftright("depth", CHUNK_BITS).alias("chunk"),
        *[F.conv(F.substring("part", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"own{i}") for i in range(len(LANES))],
    )
    parts = common.save(parts, "prefix-parts")
    summed = running(parts, "conv_id", "chunk", [F.col("depth")], {x: F.col(f"own{i}") for i, x in enumerate(LANES)})
    lanes = [F.col(x) for x in LANES]
    ends = lengths.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("ends"))
    grown = summed.select(
        "conv_id", "depth", _key(F.col("depth"), lanes).alias("key"),
        _key(F.col("depth") - 1, [x - F.col(f"own{i}") for i, x in enumerate(lanes)]).alias("parent"), "n",
    ).join(ends, ["conv_id", "depth"], "left")
    zero = [F.lit(0)] * len(LANES)
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), _key(F.lit(0), zero).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n"), (F.col("length") == 0).alias("ends"))
    return grown.withColumn("ends", F.coalesce("ends", F.lit(False))).unionByName(root)


def ends_digests(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): ids of a node, ascending and joined by commas, hashed as they stream by.

    4,096 neighbouring ids at most are joined to one string; the strings of a node then pass one hash in order, none of them kept.
    """
    some = rows.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            keys, sums = [], []
            for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if key == at:
                    h.update(b"," + ids.encode())
                else:
                    if at is not None:
                        keys.append(at)
                        sums.append(h.hexdigest())
                    at, h = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    return some.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """(key, parent, depth, conv_id, n_convs, saved, n_children) of prefixes; a leaf has no children."""
    made = rows.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n").alias("n"))
    made = common.save(made.withColumn("saved", (F.col("n_convs") - 1) * F.col("n")).drop("n"), "prefix-nodes")
    children = made.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "key")
    return made.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def rollup(tree: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens): sums over whole subtrees, by pointer jumping."""
    own = tree.select("key", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    total, deepest = tree.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    active = tree.filter("parent IS NOT NULL").select("key", F.col("parent").alias("jump"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    arrived, span = [own], 1
    while span <= deepest:
        # all rows of `active` lie at depth span or below and point span up
        incoming = active.groupBy("jump").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("n_in"))
        arrived.append(incoming.select(F.col("jump").alias("key"), F.col("more_leaves").alias("leaves"), F.col("more_saved").alias("saved")))
        if 2 * span <= deepest:
            pointers = active.select("key", F.col("jump").alias("next")).join(incoming.select(F.col("jump").alias("key"), "n_in"), "key").withColumnRenamed("key", "jump")
            left = active.filter(F.col("depth") >= 2 * span)
            grown = left.join(incoming.drop("n_in").withColumnRenamed("jump", "key"), "key", "left").select(
                "key", "jump", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
            )
            jumped = common.join_hot(grown, pointers, "jump", "n_in", total)
            active = common.save(jumped.select("key", F.col("next").alias("jump"), "depth", "leaves", "saved"), "prefix-round")
        span *= 2
    rows = arrived[0]
    for more in arrived[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(lengths: DataFrame, sequences: DataFrame) -> DataFrame:
    """All nodes with key and parent, what climbed to them, and the digest of the conversations that end there."""
    rows = common.save(prefixes(lengths, sequences), "prefix-rows")
    tree = common.save(nodes(rows), "prefix-tree")
    up = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = common.join_hot(tree, up.withColumnRenamed("n_children", "siblings"), "parent", "siblings", tree.count()).drop("siblings")
    out = out.join(rollup(tree), "key").join(ends_digests(rows.filter("ends").select("key", "conv_id")), "key", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = common.table(spark, sf_dir, "conversations")
    return trie(*rebuild(common.save(turns(c), "prefix-turns"))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = f"""
WITH {CRC32_SQL},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS dg FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS place FROM g),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM p), bits),
r AS (SELECT c.conv_id, place, dg, length(text) AS n, 0 AS side FROM c JOIN p ON p.conv_id = base WHERE place < h
  UNION ALL SELECT c.conv_id, place, dg, length(text) AS n, 1 AS side FROM c JOIN p USING (conv_id) WHERE place >= h),
s AS (SELECT conv_id, n, dg, row_number() OVER (PARTITION BY conv_id ORDER BY side, place) AS depth FROM r),
x AS (SELECT conv_id, n, depth, sha256(string_agg(dg, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
y AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM x),
nd AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
  coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256 FROM y GROUP BY key),
k AS (SELECT nd.*, (SELECT count(*) FROM nd q WHERE q.parent = nd.key) AS n_children, (SELECT q.conv_id FROM nd q WHERE q.key = nd.parent) AS parent_conv_id FROM nd),
up AS (SELECT y.key, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(k.saved) AS saved_tokens FROM k JOIN y ON y.conv_id = k.conv_id AND y.depth <= k.depth GROUP BY y.key)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM k JOIN up USING (key)
"""
