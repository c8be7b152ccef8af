"""Versioned caches, cache keys, queue imports and record serialisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.windows import numbered

TRACK_SCHEMA = "path string, title string, duration double, bpm double, beats_per_bar int, beat_times array<double>, beat_numbers array<int>, downbeat_times array<double>"
SEGMENTS_SCHEMA = "array<struct<start: double, end: double, label: string, confidence: double>>"


def read_versioned(spark: SparkSession, path: str, version: int, entry_schema: str = TRACK_SCHEMA) -> DataFrame:
    """Entries (key, entry) of a one-file JSON cache {"version": n, "tracks": {key: entry}}; none if it is damaged or of another version."""
    whole = f"version int, tracks map<string, struct<{', '.join(f.replace(' ', ': ', 1) for f in entry_schema.split(', '))}>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", whole, {"mode": "PERMISSIVE"}).alias("j"))
    return parsed.filter(F.col("j.version") == version).select(F.explode("j.tracks").alias("key", "entry"))


def cache_key(path: Column, length: Column, modified: Column, *more: Column) -> Column:
    """Hex digest of what makes a cached result stale."""
    return F.sha2(F.concat_ws("::", path, length.cast("string"), modified.cast("string"), *more), 256)


def file_keys(spark: SparkSession, path: str, config: str = "") -> DataFrame:
    f = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return f.withColumn("key", cache_key(F.col("path"), F.col("length"), F.unix_micros("modificationTime"), F.lit(config)))


def write_entries(entries: DataFrame, path: str) -> None:
    """Partitioned feature store by model and configuration; only partitions that are written are replaced."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "config").parquet(path)


def missing(files: DataFrame, cached: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What is still to be analysed."""
    return files.join(cached, by or ["key"], "left_anti")


def upsert(queue: DataFrame, loaded: DataFrame) -> DataFrame:
    """queue (path, pos, ...) with loaded (path, seq, ...) put in: the last load of a path replaces it in place, new paths follow in order of load.

    New rows are numbered within ranges of seq, after the largest place of the queue.
    """
    last = loaded.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))).filter("_r = 1").drop("_r")
    kept = queue.select("path", "pos").join(last, "path")
    untouched = queue.join(last.select("path"), "path", "left_anti")
    new = last.join(queue.select("path"), "path", "left_anti")
    offset = queue.agg(F.max("pos")).first()[0]
    placed = numbered(new, "seq", "_n").withColumn("pos", F.lit(0 if offset is None else offset + 1) + F.col("_n")).drop("_n")
    return untouched.unionByName(kept.drop("seq")).unionByName(placed.drop("seq"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two snapshots hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def to_record(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def from_record(text: Column, schema: str = TRACK_SCHEMA) -> Column:
    return F.from_json(text, schema)
