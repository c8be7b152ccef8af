"""Bar structure: normalisers, roles from energy, keys, functional segments, phrase grids, silence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..functions import arrays
from ..functions.scalar import clip
from ..functions.windows import by_bar, by_track


# Key profiles by pitch class from the tonic, and wheel names by pitch class.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
MAJOR_WHEEL = ("8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B")
MINOR_WHEEL = ("5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A")


def unit(x: Column, low: float = 0.05, high: float = 0.95, flat: float = 0.0, eps: float = 1e-12, over: WindowSpec | None = None) -> Column:
    """x between two exact percentiles of its track, clipped; `flat` where they coincide.

    Structure uses 5 and 95 %, matching 10 and 90 % with eps 1e-10, the phrase policy 5 and 95 % with flat 0.5.
    """
    over = over or by_track()
    a, b = F.percentile(x, F.lit(low)).over(over), F.percentile(x, F.lit(high)).over(over)
    return F.when(b > a + eps, clip((x - a) / (b - a))).otherwise(F.lit(float(flat)))


def _between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share with one rounding of the sum (a fused multiply-add), as compiled engines have it."""
    some = low.isNotNull() & high.isNotNull()
    sure = lambda x: F.coalesce(x, F.lit(0.0))
    return F.when(some, F.java_method(F.lit("java.lang.Math"), F.lit("fma"), sure(low), sure(1.0 - share), sure(high * share)).cast("double"))


def with_units(df: DataFrame, columns: dict[str, str], low: float = 0.05, high: float = 0.95, eps: float = 1e-12) -> DataFrame:
    """df with unit() of the columns, each under its new name, to the last bit of a percentile.

    Rules that compare sums of such values with round limits meet ties, which that bit decides. percentile() rounds both
    parts of an interpolation, and leaves equal neighbours alone; here the neighbours are looked up and meet in one rounding.
    """
    over, ends = by_track(), (low, high)
    x = {c: F.col(c) for c in columns}
    q = df.withColumns({f"_p_{c}": F.percentile(x[c], F.array(*map(F.lit, ends))).over(over) for c in columns} | {f"_n_{c}": F.count(x[c]).over(over) for c in columns})
    near = {}
    for c in columns:
        for k in range(2):
            v = F.get(f"_p_{c}", F.lit(k))
            near |= {f"_b_{c}{k}": F.max(F.when(x[c] <= v, x[c])).over(over), f"_a_{c}{k}": F.min(F.when(x[c] >= v, x[c])).over(over)}
    q = q.withColumns(near)

    def end(c: str, k: int) -> Column:
        at = (F.col(f"_n_{c}") - 1) * F.lit(ends[k])
        return _between(F.col(f"_b_{c}{k}"), F.col(f"_a_{c}{k}"), at - F.floor(at))

    q = q.withColumns({f"_e_{c}{k}": end(c, k) for c in columns for k in range(2)})
    scaled = {n: F.when(F.col(f"_e_{c}1") > F.col(f"_e_{c}0") + eps, clip((x[c] - F.col(f"_e_{c}0")) / (F.col(f"_e_{c}1") - F.col(f"_e_{c}0")))).otherwise(F.lit(0.0)) for c, n in columns.items()}
    return q.select(*[F.col(c) for c in df.columns], *[v.alias(n) for n, v in scaled.items()])


def min_max(x: Column, eps: float = 1e-9, over: WindowSpec | None = None) -> Column:
    over = over or by_track()
    a, b = F.min(x).over(over), F.max(x).over(over)
    return F.when(b > a + eps, (x - a) / (b - a)).otherwise(F.lit(0.0))


def z_score(x: Column, over: WindowSpec | None = None) -> Column:
    over = over or by_track()
    return (x - F.avg(x).over(over)) / F.greatest(F.stddev_pop(x).over(over), F.lit(1e-6))


def peak_normalized(x: Column, share: float = 0.98, over: WindowSpec | None = None) -> Column:
    over = over or by_track()
    p = F.percentile(x, F.lit(share)).over(over)
    return F.when(p > 1e-9, clip(x / p)).otherwise(x)


def ahead(x: Column, n: int = 4) -> Column:
    """Mean of this row and those after it, n in all."""
    return F.avg(x).over(by_bar().rowsBetween(0, n - 1))


def behind(x: Column, n: int = 4) -> Column:
    """Mean of the n rows before; 0 without any."""
    return F.coalesce(F.avg(x).over(by_bar().rowsBetween(-n, -1)), F.lit(0.0))


def gaussian(x: str, sigma: float = 0.7) -> Column:
    """Gaussian smoothing of a column along bars, mirrored at both ends. Short kernels only: a lag or lead per tap."""
    radius = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(radius + 1)]
    scale = taps[0] + 2 * sum(taps[1:])
    n, i = F.count(F.lit(1)).over(by_track()), F.col("bar")
    around = F.collect_list(x).over(by_bar().rowsBetween(-radius, radius))
    first = F.greatest(i - radius, F.lit(0))

    def tap(k: int) -> Column:
        at = i + k
        # d c b a | a b c d | d c b a, repeated for tracks shorter than the kernel
        m = F.pmod(at, 2 * n)
        mirrored = F.when(m < n, m).otherwise(2 * n - 1 - m)
        return F.get(around, (mirrored - first).cast("int")) * (taps[abs(k)] / scale)

    return sum((tap(k) for k in range(-radius + 1, radius + 1)), tap(-radius))


def local_roles(bars: DataFrame) -> DataFrame:
    """Energy curves and the first of eight ordered rules that names the role of a bar.

    Adds novelty, salience, energy, onset_u, low_u, vocal_u and local_role.
    """
    b = with_units(bars, {"rms": "energy", "onset": "onset_u", "low_ratio": "low_u", "brightness": "bright_u", "vocal": "vocal_u"})
    five = [F.col(c) for c in ("energy", "onset_u", "low_u", "bright_u", "vocal_u")]
    step = sum(((c - F.lag(c).over(by_bar())) * (c - F.lag(c).over(by_bar())) for c in five[1:]), (five[0] - F.lag(five[0]).over(by_bar())) * (five[0] - F.lag(five[0]).over(by_bar())))
    b = b.withColumn("delta", F.coalesce(F.sqrt(step), F.lit(0.0)))
    b = b.withColumns({"smooth": gaussian("delta"), "harmonic0": F.col("rms") * (1 - 0.25 * F.col("onset_u")), "percussive0": F.col("rms") * (0.15 + 0.85 * F.col("onset_u"))})
    b = with_units(b, {"smooth": "novelty", "harmonic0": "harmonic", "percussive0": "percussive"})
    b = b.withColumn("salience0", F.greatest(ahead(F.col("harmonic")), 0.86 * ahead(F.col("percussive"))))
    b = with_units(b, {"salience0": "salience"}).withColumns({
        "before": behind(F.col("energy")), "after": ahead(F.col("energy")),
        "vocal_4": ahead(F.col("vocal_u")), "drums_4": ahead(F.col("onset_u")), "low_4": ahead(F.col("low_u")), "n": F.count(F.lit(1)).over(by_track()),
    })
    i, n, before, after = (F.col(c) for c in ("bar", "n", "before", "after"))
    rise, boundary = after - before, F.col("novelty")
    role = (
        F.when(i <= F.greatest(F.lit(2), F.floor(0.10 * n)), "INTRO")
        .when(i >= F.floor(0.86 * n), "OUTRO")
        .when((rise > 0.16) & (after > 0.55) & ((boundary > 0.30) | (F.col("salience") > 0.55)), "BUILDUP")
        .when((-rise > 0.17) & (after < 0.55) & ((boundary > 0.25) | (F.col("drums_4") < 0.45)), "BREAKDOWN")
        .when((after > 0.62) & (F.col("drums_4") > 0.48) & (F.col("low_4") > 0.38) & ((rise > 0.10) | (boundary > 0.42)), "DROP")
        .when((F.col("energy") > after + 0.10) & (before > 0.55) & (after > 0.34), "COOLDOWN")
        .when(F.col("vocal_4") > 0.64, "VOCAL")
        .otherwise("SECTION")
    )
    return b.withColumn("local_role", role).drop("smooth", "harmonic0", "percussive0", "harmonic", "percussive", "salience0", "delta", "n", "bright_u")


def key_templates() -> list[tuple[int, str, list[float]]]:
    """The 24 standardised key profiles as (root, mode, profile), roots rising, major first."""
    out = []
    for root in range(12):
        for mode, profile in (("major", MAJOR), ("minor", MINOR)):
            p = [profile[(i - root) % 12] for i in range(12)]
            mean = sum(p) / 12
            sd = math.sqrt(sum((x - mean) ** 2 for x in p) / 12)
            out.append((root, mode, [(x - mean) / sd for x in p]))
    return out


def weighted_mean_vector(df: DataFrame, key: str, vector: str, weight: Column, dims: int = 12) -> DataFrame:
    """(key, vector) with the weighted mean of each dimension: so many sums in one pass, no row per dimension."""
    each = [F.sum(weight * F.get(vector, F.lit(i))) / F.sum(weight) for i in range(dims)]
    return df.groupBy(key).agg(F.array(*each).alias(vector))


def estimate_key(bars: DataFrame) -> DataFrame:
    """(track_id, key_index, mode, wheel, confidence) of the best of 24 templates against the weighted mean chroma.

    The templates are literals: no join with a table, one argmax over an array.
    """
    c = weighted_mean_vector(bars, "track_id", "chroma", F.greatest(F.col("rms"), F.lit(1e-5)))
    v = F.col("chroma")
    mean = arrays.total(v) / 12.0
    sd = F.sqrt(arrays.total(F.transform(v, lambda x: (x - mean) * (x - mean))) / 12.0)
    c = c.withColumn("z", F.transform(v, lambda x: (x - mean) / F.greatest(sd, F.lit(1e-6))))
    scores = [F.struct((arrays.dot(F.col("z"), F.array(*map(F.lit, t))) / 12.0).alias("s"), F.lit(-i).alias("i"), F.lit(r).alias("root"), F.lit(m).alias("mode")) for i, (r, m, t) in enumerate(key_templates())]
    ranked = F.reverse(F.array_sort(F.array(*scores)))
    c = c.withColumn("best", F.get(ranked, F.lit(0))).withColumn("second", F.get(ranked, F.lit(1)))
    wheel = F.when(F.col("best.mode") == "major", F.get(F.array(*map(F.lit, MAJOR_WHEEL)), F.col("best.root"))).otherwise(F.get(F.array(*map(F.lit, MINOR_WHEEL)), F.col("best.root")))
    known = arrays.norm(v) > 1e-9
    return c.select(
        "track_id", F.when(known, F.col("best.root")).otherwise(-1).alias("key_index"), F.when(known, F.col("best.mode")).otherwise("unknown").alias("mode"),
        F.when(known, wheel).otherwise("-").alias("wheel"), F.when(known, clip((F.col("best.s") - F.col("second.s")) * 2.5 + 0.45)).otherwise(0.0).alias("confidence"),
    )


def edm_confidence(roles: DataFrame, keys: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    """(track_id, edm_confidence) from meter, drums, dynamics and key confidence."""
    floor4 = clip(F.col("onset_u") * F.col("low_u") * 1.45)
    per = roles.groupBy("track_id").agg(clip(F.avg(floor4) * 1.45).alias("drums"), clip(F.stddev_pop("energy") * 2.2 + F.avg("novelty") * 0.8).alias("dynamics"))
    meter = 1.0 if beats_per_bar == 4 else 0.20
    return per.join(keys.select("track_id", "confidence"), "track_id", "left").select("track_id", clip(0.48 * meter + 0.34 * F.col("drums") + 0.10 * F.col("dynamics") + 0.08 * F.coalesce("confidence", F.lit(0.0))).alias("edm_confidence"))


def label_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (track_id, t) with `label`: that of the first segment [start, end) around t, after the last start
    the last label, else unknown. One as-of window over segments and points, segments being in order of start."""
    s = segments.select("track_id", F.col("start").alias("x"), F.lit(0).alias("kind"), F.struct("start", "end", "label", "seg").alias("s"), F.lit(None).cast("double").alias("t"))
    p = points.select("track_id", F.col("t").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast(s.schema["s"].dataType).alias("s"), F.col("t"))
    so_far = by_track().orderBy("x", "kind", F.col("s.seg")).rowsBetween(W.unboundedPreceding, 0)
    u = s.unionByName(p).withColumn("last", F.last("s", True).over(so_far)).withColumn("final", F.max(F.when(F.col("kind") == 0, F.struct("x", F.col("s.seg").alias("seg")))).over(by_track()))
    inside = (F.col("t") < F.col("last.end")) | (F.col("last.seg") == F.col("final.seg"))
    return u.filter("kind = 1").select("track_id", "t", F.when(F.coalesce(inside, F.lit(False)), F.lower("last.label")).otherwise("unknown").alias("label"))


def boundary_score(distance: Column, radius: Column) -> Column:
    near = 0.75 + 0.25 * clip(1.0 - distance / radius)
    q = distance / F.greatest(radius, F.lit(1e-6))
    return F.when(distance <= radius, near).otherwise(0.35 * F.exp(-0.5 * q * q))


def functional_roles(bars: DataFrame, label: str = "label", base: str = "role") -> DataFrame:
    """Adds fused_role: the role that a functional label implies, given local energies scaled by their range."""
    e = {f"m_{c}": min_max(F.col(c)) for c in ("rms", "onset", "low_ratio", "vocal")}
    b = bars.withColumns(e).withColumns({"m_before": F.coalesce(F.avg("m_rms").over(by_bar().rowsBetween(-3, -1)), F.lit(0.0)), "m_after": ahead(F.col("m_rms"))})
    x = F.lower(F.trim(F.col(label)))
    role = (
        F.when(x.isin("start", "intro"), "INTRO")
        .when(x.isin("end", "outro"), "OUTRO")
        .when(x == "break", "BREAKDOWN")
        .when(x == "bridge", F.when(F.col("m_after") > F.col("m_before") + 0.10, "BUILDUP").otherwise("BREAKDOWN"))
        .when(x == "chorus", F.when((F.col("m_rms") > 0.58) & (F.col("m_onset") > 0.46) & (F.col("m_low_ratio") > 0.30), "DROP").otherwise("CHORUS"))
        .when(x == "verse", F.when(F.col("m_vocal") > 0.48, "VOCAL").otherwise("VERSE"))
        .when(x == "solo", "SOLO")
        .when(x == "inst", F.when(F.col("m_onset") > 0.42, "PHRASE").otherwise("SECTION"))
        .otherwise(F.col(base))
    )
    return b.withColumn("fused_role", role).drop(*e, "m_before", "m_after")


def phrase_mask(bar: Column, phase: Column) -> Column:
    d = F.pmod(bar - phase, F.lit(16))
    return F.when(d == 0, 1.0).when(d == 8, 0.88).when(d % 4 == 0, 0.64).otherwise(0.0)


def period_phase(bars: DataFrame, x: str, period: int = 4) -> DataFrame:
    """(track_id, phase): the residue class of bars with the largest RMS of x, the first of equals."""
    r = bars.groupBy("track_id", F.pmod("bar", F.lit(period)).alias("phase")).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("v"))
    return r.groupBy("track_id").agg(F.max_by("phase", F.struct("v", -F.col("phase"))).cast("int").alias("phase"))


def peak_mask(x: str, radius: int = 4, share: float = 0.30) -> Column:
    local, whole = F.max(x).over(by_bar().rowsBetween(-radius, radius)), F.max(x).over(by_track())
    return (whole > 1e-9) & (F.col(x) >= local - 1e-8) & (F.col(x) >= share * whole)


def checkerboard_novelty(bars: DataFrame, features: list[str], half: int = 4) -> DataFrame:
    """(track_id, bar, novelty): mean distance across a boundary less the mean within both sides, then unit().

    The rows of a window of 2*half bars are collected per bar: work and memory grow with the window, not the track.
    """
    z = bars.withColumns({f"z_{c}": z_score(F.col(c)) for c in features})
    z = z.withColumn("v", F.array(*[F.col(f"z_{c}") for c in features])).withColumn("n", F.count(F.lit(1)).over(by_track()))
    near = z.select("track_id", "bar", "n", F.collect_list("v").over(by_bar().rowsBetween(-half, half - 1)).alias("w"))
    a, b = F.slice("w", 1, half), F.slice("w", half + 1, half)
    dist = lambda p, q: F.sqrt(arrays.total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y))))
    mean = lambda s, t: arrays.total(F.transform(s, lambda p: arrays.total(F.transform(t, lambda q: dist(p, q))))) / float(half * half)
    whole = (F.col("bar") >= half) & (F.col("bar") < F.col("n") - half) & (F.col("n") >= 2 * half + 1)
    raw = F.when(whole, F.greatest(F.lit(0.0), mean(a, b) - 0.5 * (mean(a, a) + mean(b, b)))).otherwise(0.0)
    return near.select("track_id", "bar", raw.alias("raw")).select("track_id", "bar", unit(F.col("raw")).alias("novelty"))


def silence_bounds(frames: DataFrame, hop: Column, frame: Column, rate: Column, total: Column) -> DataFrame:
    """frames (track_id, idx, rms): first and last sample of the frames within 42 dB of their 90th percentile."""
    t = F.greatest(F.lit(1e-5), F.percentile("rms", F.lit(0.9)).over(by_track()) * 10 ** (-42 / 20))
    active = frames.withColumn("threshold", t).filter("rms >= threshold").groupBy("track_id").agg(F.min("idx").alias("a"), F.max("idx").alias("z"))
    start = F.greatest(F.lit(0), F.floor(F.col("a") * hop - 0.02 * rate))
    end = F.least(total, F.floor(F.col("z") * hop + frame + 0.02 * rate))
    return active.select("track_id", start.cast("long").alias("start"), F.greatest(start + 1, end).cast("long").alias("end"))
