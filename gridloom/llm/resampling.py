"""Importance resampling of documents towards a target distribution of hashed n-grams.

DuckDB runs inside every task: SQL unnests the words of a slice of texts, windows them into n-grams, hashes each distinct
n-gram by a registered CRC-32 (zlib), and counts buckets per document. Those counts are spilled to Parquet in the shared
folder through Spark's committed writes, so a lost executor costs its own tasks only. Spark merges them into one count per bucket
(10,000 rows, which are all that the driver sees), turns both sides into a gain per bucket, and scores each document
where its counts lie: texts are read once and never shuffled. Gumbel noise from a hash of doc_id makes the highest
scores a sample without replacement with probabilities in proportion to exp(weight/1000).

Ranks are counted within ranges of (score, doc_id), equal rows collapsed first, so no task sorts the table and no key fills one.

Cases: null and empty texts have no features, weight 0 and take no part in the draw; a null doc_id hashes as an empty one and
comes last among ties; equal rows hold neighbouring ranks; an empty table gives no row; without target texts all t are 0;
texts of any length are one slice at most, slices of several texts hold SLICE_BYTES at most; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common
from .oracle import CRC32_SQL, crc32_sql

BUCKETS = 10_000
NGRAMS = (1, 1)
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE_BYTES = 4 << 20
"""Bytes of text that DuckDB unnests at a time."""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def counting_sql(ngrams: tuple[int, int], buckets: int) -> str:
    """SQL over slice(i, text): (n_words, buckets, counts) of each text in order of i."""

    def grams(n: int) -> str:
        if n == 1:
            return "SELECT i, word AS feature FROM w"
        words = ", ".join(["word", *(f"lead(word, {k}) OVER along" for k in range(1, n))])
        return f"SELECT i, concat_ws(' ', {words}) AS feature FROM w WINDOW along AS (PARTITION BY i ORDER BY place) QUALIFY lead(word, {n - 1}) OVER along IS NOT NULL"

    return f"""
WITH t AS (SELECT i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM slice),
w AS (SELECT i, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM t),
g AS ({" UNION ALL ".join(grams(n) for n in range(ngrams[0], ngrams[1] + 1))}),
h AS (SELECT feature, CAST(crc32(feature) % {buckets} AS INT) AS bucket FROM (SELECT DISTINCT feature FROM g)),
b AS (SELECT i, bucket, CAST(count(*) AS INT) AS n FROM g JOIN h USING (feature) GROUP BY i, bucket),
l AS (SELECT i, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM b GROUP BY i)
SELECT CAST(len(words) AS BIGINT) AS n_words, coalesce(buckets, CAST([] AS INT[])) AS buckets, coalesce(counts, CAST([] AS INT[])) AS counts FROM t LEFT JOIN l USING (i) ORDER BY i"""


def _crc32(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in features.cast(pa.binary()).to_pylist()], pa.int64())


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of SLICE_BYTES at most, or of one text."""
    start = size = 0
    for k, n in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
        if k > start and size + n > SLICE_BYTES:
            yield start, k - start
            start, size = k, 0
        size += n
    if len(texts) > start:
        yield start, len(texts) - start


def bucket_counts(df: DataFrame, keep: list[str], ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """`keep` of every row with n_words and its distinct buckets and their counts, written to the shared folder."""
    src = df.select(*keep, "text")
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(src.schema[c] for c in keep), common.long("n_words"), T.StructField("buckets", ints), T.StructField("counts", ints)])
    sql = counting_sql(ngrams, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.compute  # noqa: F401

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        for whole in batches:
            for start, n in _slices(whole.column("text")):
                part = whole.slice(start, n)
                con.register("slice", pa.table({"i": pa.array(range(n), pa.int64()), "text": part.column("text")}))
                found = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("slice")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(found.column(c).chunk(0) for c in found.column_names)], names=[f.name for f in schema])

    return common.save(src.mapInArrow(run, schema), "resampling-counts")


def totals(counted: DataFrame, name: str) -> DataFrame:
    """(bucket, name): features of all rows in each bucket."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p")).select("p.buckets", "p.counts")
    return pairs.groupBy(F.col("buckets").alias("bucket")).agg(F.sum(F.col("counts").cast("long")).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: 1000 times the logarithm of its smoothed share in the target over that in the source, floored."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(totals(source, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = W.partitionBy(F.lit(0))
    s, t = (F.col(c).cast("double") for c in "st")
    ratio = (t + 1) * (F.sum("s").over(whole).cast("double") + buckets) / ((s + 1) * (F.sum("t").over(whole).cast("double") + buckets))
    return [r.gain for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def scores(counted: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) from counts per document; no shuffle."""
    by_bucket = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)

    n = total(F.transform("counts", lambda c: c.cast("long")))
    sums = counted.select("doc_id", "n_words", n.alias("n_features"), total(F.zip_with("buckets", "counts", lambda b, c: F.get(by_bucket, b) * c)).alias("gained"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gained") / F.col("n_features"))).otherwise(0).cast("long")
    return sums.withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: rank 1, 2, 3... of the highest scores among texts of min_words at least."""
    rows = common.save(scored.withColumn("able", F.col("n_words") >= min_words).groupBy("doc_id", "n_features", "weight", "score", "able").agg(F.count(F.lit(1)).alias("copies")), "resampling-scored")
    able = rows.filter("able")
    n_drawn = percent * (able.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]) // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranged = common.save(able.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "resampling-ranges")
    before = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    below = ranged.groupBy("range").agg(F.sum("copies").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    upto = F.sum("copies").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(below), "range")
    last = F.col("below") + F.col("upto")
    ranks = placed.withColumn("rank", F.explode(F.sequence(last - F.col("copies") + 1, last))).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    others = rows.filter("NOT able").withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("rank", F.lit(None).cast("long"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank").unionByName(others.select("doc_id", "n_features", "weight", "score", "rank"))


def resample(documents: DataFrame, target: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Documents drawn towards the distribution of the texts of `target`; both have a column text, documents a doc_id."""
    source, wanted = bucket_counts(documents, ["doc_id"], ngrams, buckets), bucket_counts(target, [], ngrams, buckets)
    return draw(scores(source, gains(source, wanted, buckets), seed), percent, min_words)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _words(table: str, *keep: str) -> str:
    return f"SELECT {''.join(k + ', ' for k in keep)}regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM {table}"


OP11_SQL = f"""
WITH {CRC32_SQL},
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, * FROM ({_words("documents", "doc_id")})),
b AS ({_words("benchmark")}),
dw AS (SELECT i, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
v AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), bits),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS sa, (SELECT coalesce(sum(t), 0) FROM t) AS ta),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000)::DOUBLE))) AS gain FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
m AS (SELECT i, floor(sum(gain) / count(*)) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY i),
x AS (SELECT doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN m USING (i)),
y AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r
"""
