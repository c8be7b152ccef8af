"""Detections and cues: merging, peak picking, snapping with suppression, directional scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import clip
from ..functions.windows import by_track
from .grid import snap
from .structure import min_max



def merge_detections(d: DataFrame) -> DataFrame:
    """(track_id, t, score): the largest score per position, scaled to the range of its track."""
    m = d.groupBy("track_id", "t").agg(F.max("score").alias("raw"))
    return m.select("track_id", "t", min_max(F.col("raw"), 1e-12).alias("score"))


def _suppress(ordered: Column, clash) -> Column:
    """Greedy choice from an array in order of preference: an element stays unless it clashes with one kept."""
    empty = F.slice(ordered, F.lit(1), F.lit(0))
    return F.aggregate(ordered, empty, lambda kept, x: F.when(F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def pick_peaks(merged: DataFrame, sensitivity: float = 0.5, distance: int = 16, plateaus: bool = True) -> DataFrame:
    """Local maxima of at least `sensitivity`, at least `distance` merged detections apart, highest first.

    A plateau counts at its middle, or not at all if plateaus are not asked for; the first and last detection are no peaks; of
    equally high ones the later wins.
    """
    w = by_track().orderBy("t")
    run = merged.withColumn("i", F.row_number().over(w) - 1).withColumn("new", F.coalesce((F.col("score") != F.lag("score").over(w)).cast("int"), F.lit(1)))
    run = run.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    p = run.groupBy("track_id", "run").agg(F.min("i").alias("a"), F.max("i").alias("z"), F.first("score").alias("score"), F.collect_list(F.struct("i", "t")).alias("rows"))
    by_run = by_track().orderBy("run")
    p = p.withColumn("before", F.lag("score").over(by_run)).withColumn("after", F.lead("score").over(by_run))
    p = p.filter((F.col("score") > F.col("before")) & (F.col("score") > F.col("after")) & (F.col("score") >= sensitivity))
    if not plateaus:
        p = p.filter("a = z")
    p = p.withColumn("i", F.floor((F.col("a") + F.col("z")) / 2).cast("int"))
    p = p.withColumn("t", F.get(F.transform(F.filter("rows", lambda r: r["i"] == F.col("i")), lambda r: r["t"]), F.lit(0)))
    per = p.groupBy("track_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "i", "t")))).alias("c"))
    return per.select("track_id", F.explode(_suppress(F.col("c"), lambda x, y: F.abs(x["i"] - y["i"]) < distance)).alias("k")).select("track_id", "k.t", "k.score")


def snap_and_suppress(raw: DataFrame, downbeats: DataFrame, min_bars: int = 8) -> DataFrame:
    """(track_id, bar, t, score): detections on their nearest downbeat, at least min_bars apart, best first.

    Tracks without any get the first bar and the last but min_bars at 0.36, just over the threshold of cues.
    """
    grid = downbeats.select("track_id", "t").distinct().withColumn("bar", (F.row_number().over(by_track().orderBy("t")) - 1).cast("long"))
    at = snap(raw.select("track_id", F.col("t").alias("p")).distinct(), grid).join(grid, ["track_id", "t"])
    scored = raw.select("track_id", F.col("t").alias("p"), "score").join(at, ["track_id", "p"])
    best = scored.groupBy("track_id", "bar", "t").agg(F.max("score").alias("score"))
    # highest score first; of equal scores the detection that came first
    first = scored.groupBy("track_id", "bar").agg(F.min("p").alias("seen"))
    ranked = best.join(first, ["track_id", "bar"]).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "seen", "bar", "t", "score"))).alias("c"))
    kept = ranked.select("track_id", F.explode(_suppress(F.col("c"), lambda x, y: F.abs(x["bar"] - y["bar"]) < max(1, min_bars))).alias("k")).select("track_id", "k.bar", "k.t", "k.score")
    none = grid.join(ranked.select("track_id"), "track_id", "left_anti").withColumn("last", F.greatest(F.lit(0), F.count(F.lit(1)).over(by_track()) - max(2, min_bars)))
    ends = none.filter((F.col("bar") == 0) | (F.col("bar") == F.col("last"))).select("track_id", "bar", "t", F.lit(0.36).alias("score"))
    return kept.unionByName(ends)


def directional_scores(cues: DataFrame, bars: DataFrame) -> DataFrame:
    """bars (track_id, bar, t, role, function) with cue, phrase, mix_in and mix_out.

    Two cues on one bar: cue and phrase keep the larger, mix_in and mix_out those of the later cue.
    """
    numbered = cues.withColumn("p", F.col("t")).select("track_id", "p", "score")
    at = snap(numbered.select("track_id", "p").distinct(), bars.select("track_id", "t")).join(numbered, ["track_id", "p"])
    per = at.withColumn("s", clip(F.col("score"), 0.02, 1.0)).groupBy("track_id", "t").agg(F.max("s").alias("cue"), F.max_by("s", "p").alias("last"))
    b = bars.withColumn("n", F.count(F.lit(1)).over(by_track())).join(per, ["track_id", "t"], "left")
    x = F.col("bar") / F.greatest(F.col("n") - 1, F.lit(1))
    role, func, s = F.upper("role"), F.upper("function"), F.col("last")
    times = lambda c, v: F.when(c, v).otherwise(1.0)
    entry = s * (1.04 - 0.48 * x) * times(func.isin("INTRO", "START", "INST", "BREAK", "BRIDGE"), 1.18) * times(role.isin("BUILDUP", "BREAKDOWN", "INTRO"), 1.10) * times(role == "DROP", 1.10)
    leave = s * (0.56 + 0.56 * x) * times(func.isin("OUTRO", "END", "BREAK", "BRIDGE"), 1.20) * times(role.isin("COOLDOWN", "BREAKDOWN", "OUTRO"), 1.12) * times(role == "DROP", 0.84)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return b.select(*bars.columns, zero(F.col("cue")).alias("cue"), zero(F.col("cue")).alias("phrase"), zero(F.when(s.isNotNull(), clip(entry))).alias("mix_in"), zero(F.when(s.isNotNull(), clip(leave))).alias("mix_out"))


def first_future_cue(cues: DataFrame, forced: Column) -> DataFrame:
    """(track_id, t, tail): the first cue at or after `forced`, else the last one with tail true."""
    later = F.min(F.when(F.col("t") >= forced, F.col("t")))
    return cues.groupBy("track_id").agg(F.coalesce(later, F.max("t")).alias("t"), later.isNull().alias("tail"))
