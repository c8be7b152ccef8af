"""Phase lock of an incoming track: one smooth shift of all of it, from paired beats, as rows.

Beats (track_id, pa, pb, down, peak_a, peak_b, prominence) are pairs of beats of both tracks in samples of the hand-over, with
the attacks found near them; `down` says that both are downbeats. Decks (track_id, length, beat, per_bar) describe the
hand-over. A track_id is one hand-over of some seconds: all windows and joins are on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import clip, smootherstep
from ..functions.scratch import cut
from ..functions.windows import by_track
from .timemap import interpolate, median3, slew_limit

MOST_MS, DRIFT_MS, STEP_MS = 48.0, 40.0, 14.0
"""Largest shift of a beat, what may come to it over the hand-over, and the change from bar to bar."""


def frames(ms: float, rate: int) -> float:
    return float(max(1, round(ms * rate / 1000)))


def observations(beats: DataFrame, rate: int) -> DataFrame:
    """(track_id, x, y, w, attack): shifts by the grids, and by attacks that stand out, with their weights."""
    most = frames(MOST_MS, rate)
    heavy = F.when(F.col("down"), 1.8).otherwise(1.0)
    shift = lambda a, b: clip(F.col(b) - F.col(a), -most, most)
    grid = F.struct(shift("pa", "pb").alias("y"), (0.38 * heavy).alias("w"), F.lit(False).alias("attack"))
    attack = F.struct(shift("peak_a", "peak_b").alias("y"), ((0.75 + 1.45 * F.col("prominence")) * heavy).alias("w"), F.lit(True).alias("attack"))
    both = F.when(F.col("prominence") >= 0.16, F.array(grid, attack)).otherwise(F.array(grid))
    return beats.select("track_id", ((F.col("pa") + F.col("pb")) / 2.0).alias("x"), F.inline(both))


def robust_fit(obs: DataFrame, rounds: int = 4) -> DataFrame:
    """obs with intercept and slope of a weighted line, refitted with Huber weights, and the weight `robust` left to each row.

    Sums, medians and weights are windows over one partitioning by track: no round shuffles.
    """
    of = by_track()
    total = lambda x: F.sum(x).over(of)
    median = lambda x: F.percentile(x, F.lit(0.5)).over(of)
    d = obs.withColumn("w", F.greatest("w", F.lit(1e-6))).withColumn("robust", F.col("w"))
    for _ in range(rounds):
        d = d.withColumns({"_mx": total(F.col("robust") * F.col("x")) / total("robust"), "_my": total(F.col("robust") * F.col("y")) / total("robust")})
        d = d.withColumns({"_sxx": total(F.col("robust") * (F.col("x") - F.col("_mx")) * (F.col("x") - F.col("_mx"))), "_sxy": total(F.col("robust") * (F.col("x") - F.col("_mx")) * (F.col("y") - F.col("_my")))})
        d = d.withColumn("slope", F.when(F.col("_sxx") > 1e-9, F.col("_sxy") / F.col("_sxx")).otherwise(0.0))
        d = d.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
        d = d.withColumn("_r", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).withColumn("_mid", median("_r"))
        d = d.withColumn("_cut", 2.5 * 1.4826 * (median(F.abs(F.col("_r") - F.col("_mid"))) + 1e-9) + 1.0)
        d = d.withColumn("robust", F.col("w") * F.when(F.abs("_r") > F.col("_cut"), F.col("_cut") / F.greatest(F.abs("_r"), F.lit(1e-9))).otherwise(1.0))
    return d.drop("_mx", "_my", "_sxx", "_sxy", "_r", "_mid", "_cut")


def lower_median(df: DataFrame, keys: list[str], x: str, w: str, name: str) -> DataFrame:
    """(keys, name): the first x in order whose running weight reaches half of all."""
    key = W.partitionBy(*keys)
    run = df.withColumn("_c", F.sum(w).over(key.orderBy(x, w).rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum(w).over(key))
    return run.filter(F.col("_c") >= 0.5 * F.col("_t")).groupBy(*keys).agg(F.min(x).alias(name))


def nudges(fitted: DataFrame, decks: DataFrame, rate: int) -> DataFrame:
    """Keyframes (track_id, bar, x, y): the shift at the start and at each bar, smooth from bar to bar."""
    most = frames(MOST_MS, rate)
    widest = most + frames(DRIFT_MS, rate)
    last = F.greatest(F.col("length") - 1, F.lit(1))
    line = fitted.select("track_id", "intercept", "slope").distinct().join(decks, "track_id").withColumn("intercept", clip("intercept", -most, most))
    line = line.withColumn("slope", (clip(F.col("intercept") + F.col("slope") * last, -widest, widest) - F.col("intercept")) / last).withColumn("span", F.col("beat") * F.col("per_bar"))
    bars = line.withColumn("bar", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("length") / F.greatest("span", F.lit(1.0))).cast("int")))))
    bars = bars.withColumn("x", F.least(F.col("length") - 1.0, F.col("bar") * F.col("span"))).withColumn("model", F.col("intercept") + F.col("slope") * F.col("x"))
    # a bar meets the observations of the stretches that it reaches, each one bar long
    stretch = lambda x: F.floor(x / F.greatest("span", F.lit(1.0)))
    reach = 0.72 * F.col("span")
    near = bars.filter("bar > 0").select("track_id", "bar", "span", F.col("x").alias("centre"), F.explode(F.sequence(stretch(F.col("x") - reach), stretch(F.col("x") + reach))).alias("stretch"))
    given = fitted.select("track_id", F.col("x").alias("at"), "y", "robust").join(decks.select("track_id", (F.col("beat") * F.col("per_bar")).alias("span")), "track_id").select("track_id", stretch(F.col("at")).alias("stretch"), "at", "y", "robust")
    seen = near.join(given, ["track_id", "stretch"]).filter("abs(at - centre) <= 0.72 * span")
    local = lower_median(seen, ["track_id", "bar"], "y", "robust", "local")
    k = bars.join(local, ["track_id", "bar"], "left")
    value = F.when(F.col("bar") == 0, F.col("intercept")).when(F.col("local").isNull(), clip("model", -widest, widest)).otherwise(clip(0.72 * F.col("local") + 0.28 * F.col("model"), -widest, widest))
    k = k.withColumn("y", value).withColumn("_n", F.count(F.lit(1)).over(by_track()))
    k = k.withColumn("y", F.when(F.col("_n") >= 3, median3("y", "bar")).otherwise(F.col("y"))).select("track_id", "bar", "x", "y")
    return slew_limit(k, "y", "bar", frames(STEP_MS, rate)).join(k.select("track_id", "bar", "x"), ["track_id", "bar"]).select("track_id", "bar", "x", "y")


def release(x: Column, length: Column, beat: Column) -> Column:
    """1 while both tracks sound, easing to 0 at the end, where the incoming one goes on unmoved."""
    n = F.greatest(F.lit(32), F.least(F.bround(F.least(1.25 * beat, 0.18 * length)), F.greatest(F.lit(32), length - 1)))
    start = F.greatest(F.lit(0), length - n)
    eased = 1.0 - smootherstep(clip((x - start) / F.greatest(length - 1 - start, F.lit(1))))
    return F.when(x >= length - 1, 0.0).when(start < length - 1, eased).otherwise(1.0)


def corrections(points: DataFrame, keys: DataFrame, decks: DataFrame) -> DataFrame:
    """(track_id, x, correction) at the points (track_id, x), whole samples."""
    at = interpolate(points.select("track_id", F.col("x").cast("double").alias("x")).distinct(), keys.select("track_id", "x", "y"))
    return at.join(decks, "track_id").select("track_id", "x", (F.col("y") * release(F.col("x"), F.col("length"), F.col("beat"))).alias("correction"))


def lock(beats: DataFrame, decks: DataFrame, rate: int) -> tuple[DataFrame, DataFrame]:
    """Keyframes of the shift, and per track_id how far the beats lay apart before and after it, and how sure that is."""
    # both are read several times below
    obs = cut(robust_fit(observations(beats, rate)), "phase")
    keys = cut(nudges(obs, decks, rate), "phase")
    o = obs.withColumn("below", F.floor("x").cast("double")).withColumn("above", F.col("below") + 1.0)
    points = o.select("track_id", F.col("below").alias("x")).unionAll(o.select("track_id", F.col("above").alias("x")))
    moved = corrections(points, keys, decks)
    at = lambda side: moved.select("track_id", F.col("x").alias(side), F.col("correction").alias(f"c_{side}"))
    o = o.join(at("below"), ["track_id", "below"]).join(at("above"), ["track_id", "above"]).join(decks, "track_id")
    shift = F.col("c_below") + (F.col("c_above") - F.col("c_below")) * (F.col("x") - F.col("below"))
    n = F.greatest(F.lit(32), F.least(F.bround(F.least(1.25 * F.col("beat"), 0.18 * F.col("length"))), F.greatest(F.lit(32), F.col("length") - 1)))
    early = F.col("x") <= F.greatest(F.lit(0.0), F.greatest(F.lit(0), F.col("length") - n) - 0.25 * F.col("beat"))
    o = o.withColumns({"before": F.abs("y"), "after": F.abs(F.col("y") - shift), "early": early, "v": F.greatest("robust", F.lit(1e-9))})
    o = o.withColumn("any_early", F.max("early").over(by_track())).filter("early OR NOT any_early")
    ms = lambda x, name: lower_median(o, ["track_id"], x, "v", name).withColumn(name, F.col(name) * 1000.0 / rate)
    attacks = obs.filter("attack").withColumn("_mid", F.percentile("y", F.lit(0.5)).over(by_track()))
    spread = attacks.groupBy("track_id").agg(F.percentile(F.abs(F.col("y") - F.col("_mid")), F.lit(0.5)).alias("spread"), F.avg(clip(F.col("w") / 3.0)).alias("prominent"))
    most = frames(MOST_MS, rate)
    m = ms("before", "pre_ms").join(ms("after", "post_ms"), "track_id").join(spread, "track_id", "left")
    sure = clip(0.35 + 0.40 * clip(1.0 - F.coalesce("spread", F.lit(most)) / most) + 0.25 * F.coalesce("prominent", F.lit(0.0)))
    m = m.withColumn("confidence", sure)
    return keys, m.select("track_id", "pre_ms", "post_ms", "confidence", clip(0.55 + 0.30 * F.col("confidence") + 0.15 * (1.0 - F.least(F.col("post_ms") / 35.0, F.lit(1.0)))).alias("score"))
