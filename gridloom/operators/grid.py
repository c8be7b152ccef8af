"""Event grids: plausible intervals, tempo, repair, snapping, numbering, bar boundaries.

Tables: beats (track_id, t) and downbeats (track_id, t). Every operator works per track, in windows or joins
on track_id; only the merge of close events is sequential and folds over one track's sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import clip, fold_bpm
from ..functions.windows import by_time, by_track


def clean(beats: DataFrame) -> DataFrame:
    """Finite, non-negative, distinct times."""
    t = F.col("t")
    return beats.filter(t.isNotNull() & ~F.isnan(t) & (t < float("inf")) & (t >= 0)).select("track_id", "t").distinct()


def intervals(beats: DataFrame) -> DataFrame:
    return beats.withColumn("gap", F.col("t") - F.lag("t").over(by_time()))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def estimate_bpm(beats: DataFrame, low: float = 0.22, high: float = 1.8) -> DataFrame:
    """(track_id, intervals, bpm): trimmed median interval, folded into 70..190; null below four intervals."""
    g = intervals(clean(beats)).filter(F.col("gap").between(low, high))
    g = g.withColumn("centre", median(F.col("gap")).over(by_track())).withColumn("n", F.count(F.lit(1)).over(by_track()))
    near = F.col("gap").between(F.col("centre") * 0.72, F.col("centre") * 1.35)
    per = g.groupBy("track_id").agg(F.max("n").alias("intervals"), F.max("centre").alias("centre"), F.sum(near.cast("int")).alias("kept"), median(F.when(near, F.col("gap"))).alias("trimmed"))
    centre = F.when(F.col("kept") >= 4, F.col("trimmed")).otherwise(F.col("centre"))
    return per.select("track_id", "intervals", F.when(F.col("intervals") >= 4, fold_bpm(60.0 / centre)).alias("bpm"))


def median_gap(beats: DataFrame) -> DataFrame:
    """beats with `m`, the median of the plausible intervals of the track."""
    g = intervals(beats)
    return g.withColumn("m", median(F.when((F.col("gap") > 0.18) & (F.col("gap") < 1.8), F.col("gap"))).over(by_track())).drop("gap")


def merge_close(beats: DataFrame, share: float = 0.42) -> DataFrame:
    """Events nearer than share*median to the last kept one are averaged into it, in order; (track_id, t, m)."""

    def put(kept: Column, t: Column) -> Column:
        last = F.element_at(kept, -1)
        joined = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array((last + t) * 0.5))
        return F.when(t - last < share * F.col("m"), joined).otherwise(F.concat(kept, F.array(t)))

    per = median_gap(clean(beats)).groupBy("track_id").agg(F.max("m").alias("m"), F.array_sort(F.collect_list("t")).alias("ts"))
    rest = F.slice(F.col("ts"), F.lit(2), F.size("ts"))
    folded = F.when(F.col("m").isNull() | (F.size("ts") < 8), F.col("ts")).otherwise(F.aggregate(rest, F.slice("ts", 1, 1), put))
    return per.select("track_id", "m", F.explode(folded).alias("t")).select("track_id", "t", "m")


def steadiness(merged: DataFrame) -> DataFrame:
    """Per track: close intervals, their coefficient of variation and whether gaps may be filled."""
    r = intervals(merged).filter(F.col("gap").isNotNull()).withColumn("r", F.col("gap") / F.col("m"))
    close = F.when(F.col("r").between(0.70, 1.35), F.col("r"))
    per = r.groupBy("track_id").agg(F.count("r").alias("n"), F.count(close).alias("close"), F.coalesce(F.stddev_pop(close), F.lit(1.0)).alias("cv"))
    return per.withColumn("steady", (F.col("close") >= F.greatest(F.lit(6), F.floor(F.col("n") / 2))) & (F.col("cv") < 0.12))


def fill_gaps(merged: DataFrame) -> DataFrame:
    """Missing events inserted where a steady grid has a gap of two to four intervals."""
    g = merged.withColumn("after", F.lead("t").over(by_time())).join(steadiness(merged).select("track_id", "steady"), "track_id", "left")
    gap = F.col("after") - F.col("t")
    multiple = F.bround(gap / F.col("m")).cast("int")
    fits = F.coalesce(F.col("steady"), F.lit(False)) & multiple.between(2, 4) & (F.abs(gap / multiple - F.col("m")) <= 0.16 * F.col("m"))
    steps = F.when(fits, multiple).otherwise(1)
    return g.select("track_id", "m", F.explode(F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.when(i == 0, F.col("t")).otherwise(F.col("t") + i * gap / multiple))).alias("t")).select("track_id", "t", "m")


def regularize(beats: DataFrame) -> DataFrame:
    """merge_close, then fill_gaps."""
    return fill_gaps(merge_close(beats)).dropDuplicates(["track_id", "t"])


def snap(points: DataFrame, grid: DataFrame, reach: Column | None = None) -> DataFrame:
    """Each point (track_id, p) with its nearest grid time; the earlier one of equals. An as-of join both ways.

    The grid and the points of a track are merged in one window instead of being multiplied.
    """
    g = grid.select("track_id", F.col("t").alias("x"), F.lit(0).alias("kind"), F.col("t").alias("g"), F.lit(None).cast("double").alias("p"))
    q = points.select("track_id", F.col("p").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("g"), F.col("p"))
    before = by_track().orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0)
    after = by_track().orderBy("x", "kind").rowsBetween(0, W.unboundedFollowing)
    u = g.unionByName(q).withColumn("left", F.last("g", True).over(before)).withColumn("right", F.first("g", True).over(after))
    both = u.filter("kind = 1")
    near = F.when(F.col("left").isNull(), F.col("right")).when(F.col("right").isNull() | (F.col("p") - F.col("left") <= F.col("right") - F.col("p")), F.col("left")).otherwise(F.col("right"))
    out = both.select("track_id", "p", near.alias("t")).filter("t IS NOT NULL")
    return out if reach is None else out.filter(F.abs(F.col("t") - F.col("p")) <= reach)


def number_beats(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """(track_id, t, idx, number, meter): bar positions counted from the downbeat before.

    downbeats are times of beats. The meter is the median distance of downbeats of 2..8 beats, 4 without any.
    """
    d = downbeats.select("track_id", "t", F.lit(True).alias("down"))
    i = beats.select("track_id", "t").join(d, ["track_id", "t"], "left").withColumn("idx", (F.row_number().over(by_time()) - 1).cast("long"))
    i = i.withColumn("d", F.when(F.col("down"), F.col("idx")))
    so_far = by_time().rowsBetween(W.unboundedPreceding, 0)
    earlier = by_time().rowsBetween(W.unboundedPreceding, -1)
    i = i.withColumn("gap", F.when(F.col("down"), F.col("idx") - F.last("d", True).over(earlier)))
    meter = F.bround(F.percentile(F.when(F.col("gap").between(2, 8), F.col("gap")), F.lit(0.5)).over(by_track()))
    i = i.withColumn("meter", clip(F.coalesce(meter, F.lit(4.0)), 2, 8).cast("int"))
    base = F.coalesce(F.last("d", True).over(so_far), F.min("d").over(by_track()), F.lit(0))
    return i.select("track_id", "t", "idx", (F.pmod(F.col("idx") - base, F.col("meter")) + 1).cast("int").alias("number"), "meter")


def infer_meter(numbered: DataFrame) -> DataFrame:
    """Most frequent bar length of 2..8 beats; of equally frequent ones the one seen first."""
    d = numbered.filter("number = 1").withColumn("length", F.lead("idx").over(by_time()) - F.col("idx")).filter(F.col("length").between(2, 8))
    c = d.groupBy("track_id", "length").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("seen"))
    return c.groupBy("track_id").agg(F.min_by("length", F.struct(-F.col("n"), F.col("seen"))).cast("int").alias("meter"))


def bar_boundaries(downbeats: DataFrame, total: Column) -> DataFrame:
    """(track_id, bar, start, end) from downbeats; the last bar is as long as the median one, within `total`."""
    d = clean(downbeats).withColumn("end", F.lead("t").over(by_time()))
    d = d.withColumn("m", median(F.col("end") - F.col("t")).over(by_track()))
    end = F.coalesce("end", F.least(total, F.col("t") + F.greatest(F.col("m"), F.lit(0.5))))
    out = d.select("track_id", F.col("t").alias("start"), end.alias("end")).filter("end > start")
    return out.withColumn("bar", (F.row_number().over(by_track().orderBy("start")) - 1).cast("long"))


def frames_to_bars(frames: DataFrame, bars: DataFrame, features: list[str]) -> DataFrame:
    """Means of frames per bar [start, end); a bar without frames takes those of its nearest frame.

    An equi-join on the track with a range condition; the fallback runs for empty bars alone.
    """
    inside = frames.join(bars, "track_id").filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    means = inside.groupBy("track_id", "bar").agg(F.count(F.lit(1)).alias("frames"), *[F.avg(c).alias(c) for c in features])
    empty = bars.join(means, ["track_id", "bar"], "left_anti").select("track_id", "bar", F.col("start").alias("p"))
    near = snap(empty.select("track_id", "p"), frames.select("track_id", "t").distinct()).dropDuplicates(["track_id", "p"])
    filled = empty.join(near, ["track_id", "p"]).join(frames.dropDuplicates(["track_id", "t"]), ["track_id", "t"])
    return means.unionByName(filled.select("track_id", "bar", F.lit(0).cast("long").alias("frames"), *features))
