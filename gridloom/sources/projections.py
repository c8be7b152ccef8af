"""Views of the driver's tables in the domain of ordered sequences, segments, vectors and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LABELS = ("start", "intro", "verse", "chorus", "break", "bridge", "inst", "solo", "outro", "end")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered events of a track, in time order; k is the integer of the JSON column."""
    w = W.partitionBy("track_id").orderBy("s", "event_id")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("track_id"), "event_id", _seconds(F.col("ts")).alias("s"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
        .withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, idx, t): event times scaled so that the median interval is half a second."""
    w = W.partitionBy("track_id").orderBy("idx")
    whole = W.partitionBy("track_id")
    e = events(spark, sf_dir).select("track_id", "idx", "s").withColumn("gap", F.col("s") - F.lag("s").over(w))
    return e.withColumn("t", (F.col("s") - F.min("s").over(whole)) / F.percentile("gap", F.lit(0.5)).over(whole) * 0.5).select("track_id", "idx", "t")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central fact table: one row per bar of a track with its features, role and label."""
    e = events(spark, sf_dir)
    part = lambda a, b, m: F.pmod(F.col("event_id") * a + F.col("k") * b, F.lit(m)) / float(m - 1)
    role = F.element_at(F.create_map(*[F.lit(x) for kv in (("signup", "INTRO"), ("view", "BUILDUP"), ("purchase", "DROP"), ("click", "SECTION"), ("error", "BREAKDOWN")) for x in kv]), F.col("event_type"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(F.floor(F.col("idx") / 8) + F.col("track_id"), F.lit(10)) + 1).cast("int"))
    return e.select(
        "track_id",
        F.col("idx").alias("bar"),
        (F.col("value") / 500.0).alias("rms"),
        (F.col("k") / 100.0).alias("low_ratio"),
        part(7, 1, 101).alias("onset"),
        part(13, 3, 97).alias("brightness"),
        part(29, 5, 89).alias("vocal"),
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda j: F.pmod(F.col("event_id") * j + F.col("k") * (j + 2), F.lit(83)) / 82.0).alias("chroma"),
        role.alias("role"),
        F.upper(label).alias("function"),
        (part(31, 1, 97)).alias("cue"),
        (F.col("idx") * 88200).cast("long").alias("start_sample"),
        ((F.col("idx") + 1) * 88200).cast("long").alias("end_sample"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, seg, start, end, label): turns of conversations laid end to end."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 10.0).alias("d"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(10)) + 1).cast("int"))
    return c.withColumn("start", F.coalesce(F.sum("d").over(w), F.lit(0.0))).select(F.col("conv_id").alias("track_id"), F.col("turn").alias("seg"), "start", (F.col("start") + F.col("d")).alias("end"), label.alias("label"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, bpm, key, mode and vectors): one row per embedding."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = F.col("v")
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("track_id"), "label", e.alias("v"))
        .select(
            "track_id",
            "label",
            (70 + F.pmod(F.col("track_id") * 7919, F.lit(12000)) / 100.0).alias("bpm"),
            F.pmod(F.col("track_id") * 5, F.lit(12)).cast("int").alias("key_index"),
            F.when(F.col("track_id") % 2 == 0, "major").otherwise("minor").alias("mode"),
            v.alias("global"),
            F.slice(v, 1, 32).alias("intro"),
            F.slice(v, 33, 32).alias("outro"),
            F.array(*[F.slice(v, 1 + 16 * i, 16) for i in range(4)]).alias("timeline"),
            F.slice(v, 1, 6).alias("acoustic"),
            F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(F.col("track_id") * 3, F.lit(10)) + 1).cast("int")).alias("first_label"),
            F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(F.col("track_id") * 7 + 4, F.lit(10)) + 1).cast("int")).alias("last_label"),
        )
    )


def queue(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """All tracks: those of each label, by track id, dealt into queues of n; the last queue of a label may be shorter.

    Ranks are counted within ranges of ids and shifted by what lies below the range, so that no task sorts a label.
    """
    t = tracks(spark, sf_dir).withColumn("_range", F.floor(F.col("track_id") / 4096)).withColumn("_l", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sizes = t.groupBy("_l", "_range").agg(F.count(F.lit(1)).alias("_n"))
    below = sizes.select("_l", "_range", F.coalesce(F.sum("_n").over(W.partitionBy("_l").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    inside = F.row_number().over(W.partitionBy("_l", "_range").orderBy("track_id")) - 1
    rank = F.col("_below") + F.col("_rank")
    q = t.withColumn("_rank", inside).join(below, ["_l", "_range"])
    return q.withColumns({"queue_id": F.concat_ws("/", "_l", F.floor(rank / n).cast("string")), "pos": (rank % n).cast("long")}).drop("_l", "_range", "_rank", "_below", "label")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, t, score): purchases as raw detections on the beat clock."""
    e = events(spark, sf_dir).select("track_id", "idx", "event_type", "value")
    d = e.join(beats(spark, sf_dir), ["track_id", "idx"])
    return d.filter(F.col("event_type") == "purchase").select("track_id", "t", (F.col("value") / F.max("value").over(W.partitionBy("track_id"))).alias("score"))
