"""Assembled tracks: signals to bands, features of frames and bars, envelope and one row per track, computed once per content.

The store is an append-only table of results under (track_id, key); a key digests a track's samples and the configuration. A run
computes what has no row under its key, appends it by Spark's commit, and answers from the table: cached and computed rows
alike. A track that changes gets another key, and its old row is not read any more; nothing is computed when nothing changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import filters, spectra
from .caches import missing


@dataclass(frozen=True)
class Config:
    """What features depend on besides the samples."""

    rate: float
    size: int
    hop: int
    mels: int
    bar: int
    bass_hz: float = 220.0
    high_hz: float = 2600.0

    def text(self) -> str:
        return repr(self)


def keys(signal: DataFrame, config: Config) -> DataFrame:
    """(track_id, key): a digest of all samples, whatever their order in the table, and of the configuration."""
    h = F.xxhash64("i", "x")
    each = signal.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("b"))
    return each.select("track_id", F.sha2(F.concat_ws(":", F.lit(config.text()), *[F.col(c).cast("string") for c in "nsb"]), 256).alias("key"))


def features(signal: DataFrame, config: Config) -> DataFrame:
    """One row per track: samples, shares of the bands, acoustic summary, bars and their mean features, place of the loudest bar."""
    bands = filters.three_bands(signal, config.rate, config.bass_hz, config.high_hz)
    energy = lambda x: F.sum(F.col(x) * F.col(x))
    split = bands.groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"), *[(energy(x) / F.greatest(energy("low") + energy("mid") + energy("high"), F.lit(1e-12))).alias(f"{x}_share") for x in ("low", "mid", "high")])
    framed = spectra.frame_features(spectra.spectrum(signal, config.size, config.hop), config.rate, config.size, config.hop, config.mels)
    n = signal.groupBy("track_id").agg(F.max("i").alias("last"))
    bar = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / config.bar)))
    bars = n.select("track_id", bar.alias("bar")).select("track_id", "bar", (F.col("bar") * config.bar / config.rate).alias("start"), ((F.col("bar") + 1) * config.bar / config.rate).alias("end"))
    by_bar = spectra.bar_features(framed, bars, config.rate).groupBy("track_id").agg(F.count(F.lit(1)).alias("bars"), F.avg("rms").alias("bar_rms"), F.avg("onset").alias("bar_onset"), F.max_by("bar", F.struct("rms", -F.col("bar"))).alias("loudest"))
    return split.join(spectra.acoustic_summary(framed, config.rate), "track_id").join(by_bar, "track_id")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def assemble(signal: DataFrame, store: str, config: Config, compute: Callable[[DataFrame, Config], DataFrame] = features) -> tuple[DataFrame, DataFrame]:
    """Results of every track of signal, and (track_id, key) of those that this run computed."""
    spark = signal.sparkSession
    wanted = cut(keys(signal, config), "keys")
    todo = cut(missing(wanted, spark.read.parquet(store).select("track_id", "key"), ["track_id", "key"]), "todo") if exists(spark, store) else wanted
    if not todo.isEmpty():
        compute(signal.join(todo.select("track_id"), "track_id", "left_semi"), config).join(todo, "track_id").write.mode("append").parquet(store)
        found = spark.read.parquet(store)
    elif exists(spark, store):
        found = spark.read.parquet(store)
    else:
        found = compute(signal, config).join(wanted, "track_id")
    # a run that was repeated after a lost driver may have appended a row twice
    return found.join(wanted, ["track_id", "key"], "left_semi").dropDuplicates(["track_id", "key"]), todo
