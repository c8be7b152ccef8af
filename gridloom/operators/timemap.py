"""Time maps: keyframes, interpolation, monotony, lag search, correlation, loops, weighted medians, replay of caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.scalar import clip, equal_power, smootherstep, soft_limit
from ..functions.windows import by_track


def interpolate(points: DataFrame, keyframes: DataFrame) -> DataFrame:
    """points (track_id, x) with y between the keyframes (track_id, x, y) around it, held at both ends. One window, no join."""
    k = keyframes.select("track_id", "x", F.lit(0).alias("kind"), F.struct("x", "y").alias("k"))
    p = points.select("track_id", "x", F.lit(1).alias("kind"), F.lit(None).cast("struct<x:double,y:double>").alias("k"))
    before = by_track().orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0)
    after = by_track().orderBy("x", "kind").rowsBetween(0, W.unboundedFollowing)
    u = k.unionByName(p).withColumn("a", F.last("k", True).over(before)).withColumn("b", F.first("k", True).over(after)).filter("kind = 1")
    span = F.col("b.x") - F.col("a.x")
    y = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (span <= 0), F.col("a.y")).otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")) / span)
    return u.select("track_id", "x", y.alias("y"))


def strictly_rising(keyframes: DataFrame, least: int = 1) -> DataFrame:
    """Targets y (whole numbers) raised so that each exceeds the one before by `least`: max(y - i) + i."""
    w = by_track().orderBy("x")
    i = (F.row_number().over(w) - 1) * least
    raised = keyframes.withColumn("_i", i).withColumn("_y", F.col("y") - F.col("_i"))
    return raised.withColumn("y", F.max("_y").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_i")).drop("_i", "_y")


def cumulative_max(df: DataFrame, x: str, order: str) -> DataFrame:
    return df.withColumn(x, F.max(x).over(by_track().orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def restore_keyframes(t: DataFrame, subdivisions: int = 16) -> DataFrame:
    """(track_id, i, source, target): an eased return from playback to original tempo.

    t: track_id, start, bar (samples per bar), bars, playback_bpm, original_bpm. Each step of a bar is stretched by the
    geometric tempo at its middle; targets are a running sum.
    """
    n = F.col("bars") * subdivisions
    steps = t.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("n", n)
    middle = (F.col("i") + 0.5) / F.col("n")
    ratio = F.col("playback_bpm") / F.col("original_bpm")
    step = F.col("bar") / float(subdivisions)
    length = step * F.exp(F.log(ratio) * smootherstep(middle))
    so_far = by_track().orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return steps.select("track_id", (F.col("i") + 1).alias("i"), (F.col("start") + (F.col("i") + 1) * step).alias("source"), (F.col("start") + F.sum(length).over(so_far)).alias("target"))


def correlation(samples: DataFrame) -> DataFrame:
    """(track_id, rho) of samples (track_id, a, b) at zero lag; 0 below 64 samples or with hardly any energy."""
    s = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    size = F.sqrt(F.col("aa") * F.col("bb"))
    return s.select("track_id", F.when((F.col("n") < 64) | (size <= 1e-9), 0.0).otherwise(clip(F.col("ab") / size, -1.0, 1.0)).alias("rho"))


def lag_search(envelopes: DataFrame, most: int) -> DataFrame:
    """(track_id, lag, score): the shift of b against a, within +-most, of the largest normalised product.

    envelopes (track_id, idx, a, b). Each row meets 2*most+1 shifted ones in an equi-join; the smaller shift wins ties.
    """
    shifted = envelopes.select("track_id", F.col("b"), "idx", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("idx", F.col("idx") - F.col("lag"))
    m = envelopes.select("track_id", "idx", "a").join(shifted, ["track_id", "idx"]).groupBy("track_id", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    m = m.withColumn("score", F.col("ab") / F.greatest(F.sqrt(F.col("aa") * F.col("bb")), F.lit(1e-12)))
    return m.groupBy("track_id").agg(F.max_by(F.struct("lag", "score"), F.struct("score", -F.abs("lag"), -F.col("lag"))).alias("b")).select("track_id", "b.lag", "b.score")


def micro_alignment(envelopes: DataFrame, most: int, guard: int, shortest: int = 128, least: int = 64) -> DataFrame:
    """(track_id, lag, confidence): the shift of b against a by the largest weighted likeness, and how sure it is.

    envelopes (track_id, idx, a, b). The beginning weighs 1.35, the end 0.75. Confidence is 0.65 of the likeness and 0.35 of how far
    the best shift stands above all more than `guard` away; below 0.18 nothing is shifted. Tracks below `shortest` rows or
    without any rise stay put; shifts that leave fewer than `least` rows are out. An equi-join of each row with its shifts.
    """
    e = envelopes.withColumns({"n": F.count(F.lit(1)).over(by_track()), "top": F.least(F.max("a").over(by_track()), F.max("b").over(by_track()))})
    e = e.withColumn("most", F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("n") / 5))).cast("int"))
    able = e.filter((F.col("n") >= shortest) & (F.col("top") >= 1e-6) & (F.col("most") >= 1))
    shifted = able.select("track_id", "b", "idx", "n", F.explode(F.sequence(-F.col("most"), F.col("most"))).alias("lag")).withColumn("idx", F.col("idx") - F.col("lag"))
    m = able.select("track_id", "idx", "a").join(shifted, ["track_id", "idx"])
    size, place = F.col("n") - F.abs("lag"), F.least("idx", F.col("idx") + F.col("lag"))
    w = 1.35 - 0.60 * place / F.greatest(size - 1, F.lit(1))
    s = m.groupBy("track_id", "lag").agg(*[F.sum(w * F.col(x) * F.col(y)).alias(x + y) for x, y in ("ab", "aa", "bb")], F.first(size).alias("size"))
    score = F.when(F.col("size") < least, -1.0).otherwise(F.col("ab") / (F.sqrt(F.col("aa") * F.col("bb")) + 1e-12))
    s = s.select("track_id", "lag", score.alias("score"))
    best = s.groupBy("track_id").agg(F.max_by(F.struct("lag", "score"), F.struct("score", -F.col("lag"))).alias("b"))
    away = s.join(best, "track_id").withColumn("other", F.when(F.abs(F.col("lag") - F.col("b.lag")) <= guard, -1.0).otherwise(F.col("score")))
    found = away.groupBy("track_id", "b").agg(F.max("other").alias("second"))
    unique = clip((F.col("b.score") - F.col("second")) / 0.18)
    found = found.select("track_id", "b.lag", clip(0.65 * clip(F.col("b.score")) + 0.35 * unique).alias("confidence"))
    every = e.select("track_id").distinct().join(found, "track_id", "left")
    sure = F.coalesce(F.col("confidence") >= 0.18, F.lit(False))
    return every.select("track_id", F.when(sure, F.col("lag")).otherwise(0).cast("int").alias("lag"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def best_pairing(a: DataFrame, b: DataFrame, most: int = 2) -> DataFrame:
    """(track_id, shift, cost): index shift of grid b against a with the least spread of residuals.

    cost = median |r| + 0.35*median |change of r|; the first shift of equals. a, b: (track_id, idx, t).
    """
    moved = b.select("track_id", F.col("t").alias("tb"), "idx", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("idx", F.col("idx") - F.col("shift"))
    r = a.join(moved, ["track_id", "idx"]).withColumn("r", F.col("tb") - F.col("t"))
    r = r.withColumn("d", F.abs(F.col("r") - F.lag("r").over(W.partitionBy("track_id", "shift").orderBy("idx"))))
    c = r.groupBy("track_id", "shift").agg((F.percentile(F.abs("r"), F.lit(0.5)) + 0.35 * F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(0.0))).alias("cost"))
    return c.groupBy("track_id").agg(F.min_by(F.struct("shift", "cost"), F.struct("cost", "shift")).alias("m")).select("track_id", "m.shift", "m.cost")


def weighted_median(df: DataFrame, x: str, w: str) -> DataFrame:
    """(track_id, median): the first x in order whose running weight reaches half of all."""
    run = df.filter(F.col(w) > 0).withColumn("_c", F.sum(w).over(by_track().orderBy(x).rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum(w).over(by_track()))
    return run.filter(F.col("_c") >= 0.5 * F.col("_t")).groupBy("track_id").agg(F.min(x).alias("median"))


def median3(x: str, order: str) -> Column:
    """Median of a value and its neighbours, zeros beyond both ends."""
    w = by_track().orderBy(order)
    a, b, c = F.lag(x, 1, 0.0).over(w), F.col(x), F.lead(x, 1, 0.0).over(w)
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def slew_limit(df: DataFrame, x: str, order: str, step: float) -> DataFrame:
    """Values whose change per row is at most step: a forward fold, then a backward one, over one track's array."""
    per = df.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x")))).alias("rows"))

    def fold(values: Column) -> Column:
        first = F.slice(values, F.lit(1), F.lit(1))
        return F.aggregate(F.slice(values, F.lit(2), F.size(values)), first, lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + F.greatest(F.lit(-step), F.least(F.lit(step), v - F.element_at(s, -1))))))

    v = F.transform("rows", lambda r: r["x"])
    limited = F.reverse(fold(F.reverse(fold(v))))
    out = per.select("track_id", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["o"]).alias("o"), limited.alias("x"))).alias("z"))
    return out.select("track_id", F.col("z.o").alias(order), F.col("z.x").alias(x))


def loop_gather(samples: DataFrame, cue: Column, loop: Column, length: Column) -> DataFrame:
    """(track_id, i, v): `length` samples of the loop that ends at the cue, repeated: an index by modulus, not a copy."""
    per = samples.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s"))
    i = F.explode(F.sequence(F.lit(0), length - 1))
    return per.select("track_id", "s", i.alias("i")).select("track_id", "i", F.get("s", (cue - loop + F.pmod(F.col("i"), loop)).cast("int"))["v"].alias("v"))


# Seconds and least samples of the seam at the end of a mix, and its largest share of the mix.
SEAM_SECONDS, SEAM_SAMPLES, SEAM_SHARE = 0.024, 64, 5


def end_seams(mixes: DataFrame, following: DataFrame, resumes: DataFrame, rate: int, wanted: int | None = None, least: int = 16) -> DataFrame:
    """(track_id, idx, raw, v, seam, resume, last): mixes whose last samples pass over to those before the track resumes.

    mixes, following: (track_id, idx, v) numbered from 0; resumes: (track_id, resume). A mix or seam below `least` samples, or a
    track of fewer than three, leaves the mix as it is (seam 0); so does a track without samples or without a place to resume.
    """
    seam = F.least(F.lit(wanted or max(SEAM_SAMPLES, round(SEAM_SECONDS * rate))), F.floor(F.col("last") / SEAM_SHARE), F.col("resume"))
    held = following.groupBy("track_id").agg(F.count(F.lit(1)).alias("total")).join(resumes, "track_id")
    held = held.select("track_id", "total", F.greatest(F.lit(1), F.least(F.col("resume"), F.col("total") - 1)).alias("resume"))
    m = mixes.withColumn("last", F.count(F.lit(1)).over(by_track())).join(held, "track_id", "left")
    m = m.withColumn("seam", F.when((F.col("last") >= least) & (F.col("total") >= 3) & (seam >= least), seam).otherwise(0).cast("long"))
    m = m.withColumns({"into": F.col("idx") - (F.col("last") - F.col("seam")), "at": F.when(F.col("idx") >= F.col("last") - F.col("seam"), F.col("resume") - F.col("last") + F.col("idx"))})
    m = m.join(following.select("track_id", F.col("idx").alias("at"), F.col("v").alias("target")), ["track_id", "at"], "left")
    out, into = equal_power(F.col("into") / F.greatest(F.col("seam") - 1, F.lit(1)))
    mixed = F.when(F.col("at").isNotNull(), F.col("v") * out + F.col("target") * into).otherwise(F.col("v"))
    return m.select("track_id", "idx", F.col("v").alias("raw"), mixed.alias("v"), "seam", "resume", (F.col("last") - 1 == F.col("idx")).alias("last"))


def seam_jumps(seamed: DataFrame, following: DataFrame) -> DataFrame:
    """(track_id, seam, jump_before, jump_after): steps from the last sample of a mix to the first after it."""
    first = following.select("track_id", F.col("idx").alias("resume"), F.col("v").alias("first"))
    ends = seamed.filter("last").join(first, ["track_id", "resume"])
    return ends.select("track_id", "seam", F.abs(F.col("raw") - F.col("first")).alias("jump_before"), F.abs(F.col("v") - F.col("first")).alias("jump_after"))


def envelope(samples: DataFrame, bins: int = 640) -> DataFrame:
    """(track_id, bin, rms) over equal bins of the samples (track_id, idx, v)."""
    n = F.count(F.lit(1)).over(by_track())
    b = samples.withColumn("n", n).withColumn("bin", F.least(F.floor(((F.col("idx") + 1) * bins - 1) / F.col("n")), F.lit(bins - 1)))
    return b.groupBy("track_id", "bin").agg(F.sqrt(F.avg(F.col("v") * F.col("v")) + 1e-12).alias("rms"))


def waveform(samples: DataFrame, bins: int = 640) -> DataFrame:
    """(track_id, bin, level) of all bins, empty ones at 0, over the 98th percentile of the track, at most 1."""
    every = samples.select("track_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    e = every.join(envelope(samples, bins), ["track_id", "bin"], "left").withColumn("rms", F.coalesce("rms", F.lit(0.0)))
    top = F.percentile("rms", F.lit(0.98)).over(by_track())
    return e.select("track_id", "bin", F.when(top > 1e-9, clip(F.col("rms") / top)).otherwise(F.col("rms")).alias("level"))


def sliding_frames(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """(track_id, frame, rms) of overlapping frames: every sample goes to the frames that hold it. Whole frames only."""
    n = F.max("idx").over(by_track()) + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / hop))
    last = F.least(F.floor(F.col("idx") / hop), F.floor((F.col("n") - size) / hop))
    s = samples.withColumn("n", n).filter(F.col("n") >= size).withColumn("a", first).withColumn("z", last).filter("a <= z")
    e = s.select("track_id", "v", F.explode(F.sequence("a", "z")).alias("frame"))
    return e.groupBy("track_id", "frame").agg(F.sqrt(F.avg(F.col("v") * F.col("v")) + 1e-12).alias("rms"))


def lru_replay(touches: DataFrame, budget: int) -> DataFrame:
    """(track_id, key, bytes, step): what a cache of `budget` bytes holds after all touches (track_id, step, key, bytes), each a store.

    A store replaces its key, evicts the oldest entries until it fits, and is not kept if it is larger than the budget. A
    fold over the steps of a track: what an entry evicted stays gone, however small the entry becomes.
    """
    entry = T.StructType([T.StructField("key", touches.schema["key"].dataType), T.StructField("bytes", T.LongType()), T.StructField("step", T.LongType())])
    rows = F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), "key", F.col("bytes").cast("long").alias("bytes"))))

    def store(held: Column, t: Column) -> Column:
        others = F.filter(held, lambda x: ~x["key"].eqNullSafe(t["key"]))
        newer = lambda i: F.aggregate(F.slice(others, i + 1, F.size(others)), F.lit(0).cast("long"), lambda n, y: n + y["bytes"])
        kept = F.filter(others, lambda x, i: newer(i) + t["bytes"] <= budget)
        new = F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"), t["step"].alias("step"))
        return F.concat(kept, F.when(t["bytes"] <= budget, F.array(new)).otherwise(F.array().cast(T.ArrayType(entry))))

    held = F.aggregate(rows, F.array().cast(T.ArrayType(entry)), store)
    return touches.groupBy("track_id").agg(held.alias("held")).select("track_id", F.inline("held"))


def clean_positions(positions: Column, length: Column) -> Column:
    """Distinct finite positions within [0, length), rising."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < length)
    return F.array_sort(F.array_distinct(F.filter(positions, ok)))


def limited(samples: DataFrame, block: int, drive: float = 1.08) -> DataFrame:
    """(track_id, idx, v) through the soft limiter, block by block."""
    of = W.partitionBy("track_id", F.floor(F.col("idx") / block))
    return samples.select("track_id", "idx", soft_limit("v", F.max(F.abs("v")).over(of), drive).alias("v"))


def missing_cues(queue: DataFrame, cues: DataFrame) -> DataFrame:
    """Tracks from `selected` on that have no cue: playback may begin where a queue has none of them."""
    return queue.filter(F.col("pos") >= F.col("selected")).join(cues.select("track_id").distinct(), "track_id", "left_anti")


def shared_jobs(requests: DataFrame, key: list[str]) -> DataFrame:
    """Requests (at, ...) with job, the first request of the same key, which does the work for all, and how many wait for it."""
    w = W.partitionBy(*key)
    return requests.withColumns({"job": F.min("at").over(w), "waiting": F.count(F.lit(1)).over(w) - 1})


def prefetch(queue: DataFrame, window: int = 3) -> DataFrame:
    """(queue_id, pos, a, b, tier) for the track at pos: the pair it begins is rendered, the next pairs of the window are planned only."""
    w = W.partitionBy("queue_id").orderBy("pos")
    pairs = [F.struct(F.lead("track_id", k).over(w).alias("a"), F.lead("track_id", k + 1).over(w).alias("b"), F.lit("render" if k == 0 else "plan").alias("tier")) for k in range(max(1, window - 1))]
    return queue.withColumn("pairs", F.array(*pairs)).select("queue_id", "pos", F.inline("pairs")).filter("b IS NOT NULL")


def bounded_fifo(puts: DataFrame, window: int) -> DataFrame:
    """puts (track_id, step, key, taken): keys still planned after all rows of a track. A put renews its key as the youngest, a row
    with `taken` removes it, and only the window - 1 (at least one) youngest stay.

    A put is gone once that many other keys were put after it: later takes do not bring it back.
    """
    most = max(1, window - 1)
    rows = F.array_sort(F.collect_list(F.struct("step", "key", "taken")))
    empty = F.array().cast(T.ArrayType(puts.schema["key"].dataType))

    def put(keys: Column, t: Column) -> Column:
        others = F.filter(keys, lambda k: k != t["key"])
        longer = F.concat(others, F.array(t["key"]))
        return F.when(t["taken"], others).otherwise(F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), F.lit(most)))

    held = puts.groupBy("track_id").agg(F.aggregate(rows, empty, put).alias("keys"))
    return held.select("track_id", F.posexplode("keys").alias("place", "key"))


def accept_current(results: DataFrame, versions: DataFrame) -> DataFrame:
    """Late results dropped: those whose generation is not the last one announced before they came."""
    v = versions.select("key", F.col("at"), F.col("generation").alias("now"), F.lit(None).cast("long").alias("generation"))
    r = results.select("key", F.col("at"), F.lit(None).cast("long").alias("now"), "generation")
    w = W.partitionBy("key").orderBy("at", F.col("now").isNull()).rowsBetween(W.unboundedPreceding, 0)
    return v.unionByName(r).withColumn("now", F.last("now", True).over(w)).filter("generation IS NOT NULL").select("key", "at", "generation", F.coalesce(F.col("generation") == F.col("now"), F.lit(False)).alias("accepted"))
