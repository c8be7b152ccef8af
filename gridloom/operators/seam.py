"""Crossfades along a seam: per frequency the time at which ownership changes, a least cut of the spectral difference of a pair.

The grid of a pair is planar, so its least cut between the first and the last frame is a shortest path between its faces, from
above the lowest frequency to below the highest. Paths of all pairs grow at once: a sweep lets distances run along strips and
then along columns, any distance at a time, as running minima of distances less a prefix sum of costs. Rows of a pair lie in one
partition, so that sweeps need no shuffle; lineage is cut after every few, until nothing changes. A grid holds 56 x 112 cells at
most, whatever the signals. Of equal cuts the earliest at each frequency is taken.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import clip
from ..functions.scratch import cut
from . import spectra

GRID_BINS, GRID_FRAMES = 56, 112
FAR = 1 << 50
SWEEPS = 6
"""Sweeps between two cuts of lineage."""

# Capacities of crossing in time and in frequency, widths of the smoothing, shares of local and even progress.
ACROSS, ALONG = (1, 2200.0), (40, 3100.0)
MEDIAN, SIGMA = 5, 1.1
LOCAL, EVEN = 0.78, 0.22


def decibels(spectrum: DataFrame) -> DataFrame:
    """(track_id, frame, k, db) below the peak of the track, 80 dB at most."""
    m = spectrum.withColumn("m", F.greatest(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1e-7, F.lit(1e-5)))
    db = 20 * F.log10("m") - 20 * F.log10(F.max("m").over(W.partitionBy("track_id")))
    return m.select("track_id", "frame", "k", F.greatest(db, F.lit(-80.0)).alias("db"))


def coarse(cells: DataFrame, bins: int, most: tuple[int, int] = (GRID_BINS, GRID_FRAMES)) -> DataFrame:
    """(pair_id, f, t, cost) on a grid of at most `most`, by linear interpolation of (pair_id, k, frame, cost) with n_frames."""
    n_f = min(bins, most[0])

    def weights(o: Column, n: Column | int, m: Column | int, at: str, to: str) -> Column:
        x = o * ((n - 1) / F.greatest(F.lit(m) - 1 if isinstance(m, int) else m - 1, F.lit(1)))
        low = F.least(F.floor(x), F.lit(n) - 1 if isinstance(n, int) else n - 1)
        some = F.array(F.struct(low.alias(at), o.alias(to), (1 - (x - low)).alias(f"w{to}")), F.struct((low + 1).alias(at), o.alias(to), (x - low).alias(f"w{to}")))
        return F.filter(some, lambda s: s[f"w{to}"] > 0)

    spark = cells.sparkSession
    by_bin = spark.range(n_f).select(F.explode(weights(F.col("id"), bins, n_f, "k", "f")).alias("s")).select(F.col("s.k").cast("int").alias("k"), "s.f", "s.wf")
    pairs = cells.select("pair_id", "n_frames").distinct().withColumn("n_t", F.least("n_frames", F.lit(most[1])))
    by_frame = pairs.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_t") - 1))).select("pair_id", F.explode(weights(F.col("o"), F.col("n_frames"), F.col("n_t"), "frame", "t")).alias("s")).select("pair_id", "s.frame", "s.t", "s.wt")
    met = cells.join(F.broadcast(by_bin), "k").join(by_frame, ["pair_id", "frame"])
    return met.groupBy("pair_id", F.col("f").cast("long").alias("f"), "t").agg(F.sum(F.col("cost") * F.col("wf") * F.col("wt")).alias("cost"))


def _faces(grid: DataFrame) -> DataFrame:
    """Faces (pair_id, s, t) between frequencies s and s+1 and times t and t+1, with the costs of leaving them."""
    pair = W.partitionBy("pair_id")
    low = grid.repartition("pair_id").withColumn("v", F.col("cost") - F.min("cost").over(pair))
    top = F.max("v").over(pair)
    unit = low.withColumn("v", F.when(top > 1e-12, F.col("v") / top).otherwise(F.col("v"))).withColumn("n_f", F.max("f").over(pair) + 1)
    row, column = W.partitionBy("pair_id", "f").orderBy("t"), W.partitionBy("pair_id", "t").orderBy("f")
    cap = lambda kind, other: (kind[0] + F.floor(kind[1] * (F.col("v") + other) / 2.0)).cast("long")
    # across: the edge (f, t)-(f, t+1); along: (f, t)-(f+1, t)
    e = unit.withColumns({"across": cap(ACROSS, F.lead("v").over(row)), "along": cap(ALONG, F.lead("v").over(column))})
    e = e.withColumns({"below": F.lead("across").over(column), "sideways": F.lead("along").over(row)})
    faces = e.filter((F.col("f") < F.col("n_f") - 1) & F.col("across").isNotNull())
    so_far = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    first, last = F.col("f") == 0, F.col("f") == F.col("n_f") - 2
    return faces.select(
        "pair_id", F.col("f").alias("s"), "t", "across", "below", last.alias("last"),
        # costs from the first face of the strip, and from the first face of the column
        so_far("sideways", row).alias("strip"), so_far("below", column).alias("column"),
        F.when(first, F.col("across")).otherwise(FAR).alias("down"), F.when(last, F.col("below")).otherwise(FAR).alias("up"),
    )


def _sweep(faces: DataFrame) -> DataFrame:
    """Distances from above (down) and from below (up), after running along strips and then along columns."""
    for c, w in (("strip", W.partitionBy("pair_id", "s").orderBy("t")), ("column", W.partitionBy("pair_id", "t").orderBy("s"))):
        before, after = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.currentRow, W.unboundedFollowing)
        faces = faces.withColumns({d: F.least(F.min(F.col(d) - F.col(c)).over(before) + F.col(c), F.min(F.col(d) + F.col(c)).over(after) - F.col(c)) for d in ("down", "up")})
    return faces


def least_cuts(grid: DataFrame) -> DataFrame:
    """(pair_id, f, seam, flow): the first time on the far side of the earliest least cut of each grid, and its value."""
    faces = cut(_faces(grid), "seam")
    while True:
        for _ in range(SWEEPS - 1):
            faces = _sweep(faces)
        was = faces.withColumns({"was_down": F.col("down"), "was_up": F.col("up")})
        faces = cut(_sweep(was.repartition("pair_id")), "seam")
        moved = faces.filter((F.col("down") != F.col("was_down")) | (F.col("up") != F.col("was_up"))).isEmpty()
        faces = faces.drop("was_down", "was_up").repartition("pair_id")
        if moved:
            break
    column = W.partitionBy("pair_id", "t").orderBy("s")
    flow = F.min(F.when(F.col("last"), F.col("down") + F.col("below"))).over(W.partitionBy("pair_id"))
    d = faces.withColumns({"flow": flow, "above_down": F.coalesce(F.lag("down").over(column), F.lit(0)), "above_up": F.lag("up").over(column)})
    crossed = (F.col("above_down") + F.col("across") + F.col("up") == F.col("flow")) | F.coalesce(F.col("down") + F.col("across") + F.col("above_up") == F.col("flow"), F.lit(False))
    rows = d.filter(crossed).select("pair_id", F.col("s").alias("f"), "t", "flow")
    bottom = d.filter(F.col("last") & (F.col("down") + F.col("below") == F.col("flow"))).select("pair_id", (F.col("s") + 1).alias("f"), "t", "flow")
    return rows.unionByName(bottom).groupBy("pair_id", "f").agg((F.min("t") + 1).cast("double").alias("seam"), F.min("flow").alias("flow"))


def smoothed(seams: DataFrame, bins: int) -> DataFrame:
    """(pair_id, flow, seam): the seam of each pair as an array over all bins: a running median, a Gaussian, interpolation; in grid times."""
    each = seams.groupBy("pair_id").agg(F.max("flow").alias("flow"), F.transform(F.array_sort(F.collect_list(F.struct("f", "seam"))), lambda s: s["seam"]).alias("raw"))
    n = F.size("raw")
    at = lambda a, i: F.get(a, F.greatest(F.lit(0), F.least(i, n - 1)))
    over = lambda f: F.transform(F.sequence(F.lit(0), n - 1), f)
    reach = int(4 * SIGMA + 0.5)
    bell = [math.exp(-0.5 * (o / SIGMA) ** 2) for o in range(-reach, reach + 1)]
    median = over(lambda i: F.get(F.array_sort(F.array(*[at(F.col("raw"), i + o) for o in range(-(MEDIAN // 2), MEDIAN // 2 + 1)])), F.lit(MEDIAN // 2)))
    soft = over(lambda i: reduce(lambda a, b: a + b, [at(F.col("mid"), i + o) * (w / sum(bell)) for o, w in zip(range(-reach, reach + 1), bell, strict=True)]))
    place = lambda k: k * ((n - 1) / F.lit(float(bins - 1)))

    def between(k: Column) -> Column:
        low = F.floor(place(k)).cast("int")
        return at(F.col("soft"), low) + (at(F.col("soft"), low + 1) - at(F.col("soft"), low)) * (place(k) - low)

    return each.withColumn("mid", median).withColumn("soft", soft).select("pair_id", "flow", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), between).alias("seam"))


def seam_crossfade(pairs: DataFrame, signals: DataFrame, size: int, hop: int, rate: float) -> tuple[DataFrame, DataFrame]:
    """pairs (pair_id, a_track, b_track) as (pair_id, i, x), and (pair_id, flow, seam_mean, seam_std) in seconds.

    Both sides are cut to the shorter one. Below two frames of samples the fade is an even one of equal power, with flow 0.
    """
    bins = size // 2 + 1
    n = signals.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(n.select(F.col("track_id").alias("a_track"), F.col("n").alias("na")), "a_track").join(n.select(F.col("track_id").alias("b_track"), F.col("n").alias("nb")), "b_track")
    both = both.select("pair_id", "a_track", "b_track", F.least("na", "nb").alias("length"))
    side = lambda t: both.select("pair_id", F.col(t).alias("track_id"), "length").join(signals, "track_id").filter("i < length").select(F.col("pair_id").alias("track_id"), "i", "x", "length")
    a, b = side("a_track"), side("b_track")
    long = F.col("length") >= 2 * size
    sa, sb = (spectra.spectrum(x.filter(long), size, hop) for x in (a, b))
    frames = (F.floor(F.col("length") / hop) + 1).alias("n_frames")
    db = decibels(sa).join(decibels(sb).withColumnRenamed("db", "other"), ["track_id", "frame", "k"])
    cells = db.select(F.col("track_id").alias("pair_id"), "frame", "k", F.abs(F.col("db") - F.col("other")).alias("cost")).join(both.select("pair_id", frames), "pair_id")
    seams = cut(smoothed(least_cuts(coarse(cells, bins)), bins), "seams").join(both.select("pair_id", "length", frames), "pair_id")
    scale = (F.col("n_frames") - 1) / F.greatest(F.least("n_frames", F.lit(GRID_FRAMES)) - 1, F.lit(1))
    by_bin = seams.select("pair_id", "flow", "n_frames", F.posexplode("seam").alias("k", "at")).withColumn("at", F.col("at") * scale)
    seconds = F.col("at") * (hop / rate)
    found = by_bin.groupBy("pair_id").agg(F.max("flow").cast("double").alias("flow"), F.avg(seconds).alias("seam_mean"), F.stddev_pop(seconds).alias("seam_std"))
    short = both.filter(~long)
    summary = found.unionByName(short.select("pair_id", F.lit(0.0).alias("flow"), (F.col("length") / rate / 2).alias("seam_mean"), F.lit(0.0).alias("seam_std")))
    # ownership of every bin and frame
    joined = sa.join(sb.withColumnsRenamed({"re": "re1", "im": "im1"}), ["track_id", "frame", "k"]).join(by_bin.select(F.col("pair_id").alias("track_id"), "k", "at", "n_frames"), ["track_id", "k"])
    local = 0.5 + 0.5 * F.tanh((F.col("frame") - F.col("at")) / F.greatest(F.lit(1.3), F.col("n_frames") * 0.014))
    even = F.col("frame") / F.greatest(F.col("n_frames") - 1, F.lit(1))
    p = F.when(F.col("frame") == 0, 0.0).when(F.col("frame") == F.col("n_frames") - 1, 1.0).otherwise(clip(LOCAL * local + EVEN * even)) * (math.pi / 2)
    mixed = joined.select("track_id", "frame", "k", (F.col("re") * F.cos(p) + F.col("re1") * F.sin(p)).alias("re"), (F.col("im") * F.cos(p) + F.col("im1") * F.sin(p)).alias("im"))
    y = spectra.resynthesis(mixed, both.filter(long).select(F.col("pair_id").alias("track_id"), "length"), size, hop)
    y = y.join(a.select("track_id", "i", F.col("x").alias("xa"), "length"), ["track_id", "i"]).join(b.select("track_id", "i", F.col("x").alias("xb")), ["track_id", "i"])
    edge = F.least(F.floor(F.col("length") / 8), F.lit(max(32, int(0.012 * rate))))
    end = F.col("i") - (F.col("length") - edge)
    fade = lambda at: at / (edge - 1)
    held = F.when((edge > 1) & (F.col("i") < edge), F.col("xa") * (1 - fade(F.col("i"))) + F.col("x") * fade(F.col("i"))).when((edge > 1) & (end >= 0), F.col("x") * (1 - fade(end)) + F.col("xb") * fade(end)).otherwise(F.col("x"))
    y = y.select("track_id", "i", held.alias("x"))
    peak = F.max(F.abs("x")).over(W.partitionBy("track_id")) + 1e-9
    y = y.withColumn("x", F.when(peak > 0.98, F.col("x") * 0.98 / peak).otherwise(F.col("x")))
    turn = F.col("i") / F.greatest(F.col("length") - 1, F.lit(1)) * (math.pi / 2)
    plain = a.filter(~long).join(b.filter(~long).select("track_id", "i", F.col("x").alias("xb")), ["track_id", "i"]).select("track_id", "i", (F.col("x") * F.cos(turn) + F.col("xb") * F.sin(turn)).alias("x"))
    return y.unionByName(plain).withColumnRenamed("track_id", "pair_id"), summary
