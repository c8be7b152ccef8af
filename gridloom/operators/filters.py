"""Recursive filters and resampling of signals (track_id, i, x) as rows.

A filter of second order carries a state of two numbers: over a block of samples the new state is an affine map of the old one,
with the same matrix for every full block. Blocks run once from rest; their end states are put together by doubling (each
round a lag over twice as many blocks, with the matrix squared), until the matrix has died away; then all blocks run from
their true states at once. So a long signal takes a logarithm of rounds instead of a walk from its first sample.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.windows import by_track

BLOCK = 32
Section = tuple[float, float, float, float, float]


def butterworth(kind: str, cutoff: float) -> list[Section]:
    """Two sections (b0, b1, b2, a1, a2) of a filter of fourth order; cutoff as a share of half the rate."""
    k = math.tan(math.pi * cutoff / 2)
    out = []
    for angle in (math.pi / 8, 3 * math.pi / 8):
        damping = 2 * math.cos(angle) * k
        scale = 1 / (1 + damping + k * k)
        b = (k * k * scale, 2 * k * k * scale, k * k * scale) if kind == "low" else (scale, -2 * scale, scale)
        out.append((*b, 2 * (k * k - 1) * scale, (1 - damping + k * k) * scale))
    return out


def blocks(signal: DataFrame, size: int = BLOCK) -> DataFrame:
    """(track_id, block, x): samples in arrays of `size`, all blocks of a track in one partition."""
    rows = signal.repartition("track_id").groupBy("track_id", F.floor(F.col("i") / size).alias("block"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))


def _moved(s: Column, x: Column, c: Section) -> tuple[Column, Column, Column]:
    """Output and next state of one sample."""
    b0, b1, b2, a1, a2 = c
    y = s["p"] + b0 * x
    return y, s["q"] + b1 * x - a1 * y, b2 * x - a2 * y


def section(blocked: DataFrame, x: str, c: Section, name: str, size: int = BLOCK, start: tuple[float, float] = (0.0, 0.0), of: str | None = None) -> DataFrame:
    """blocked with array column `name`: x through one section, which starts with the state `start` times column `of`."""
    p, q = f"{name}_p", f"{name}_q"
    state = "struct<p:double,q:double>"

    def rested(s: Column, v: Column) -> Column:
        _, a, b = _moved(s, v, c)
        return F.struct(a.alias("p"), b.alias("q"))

    def run(s: Column, v: Column) -> Column:
        y, a, b = _moved(s, v, c)
        return F.struct(a.alias("p"), b.alias("q"), F.concat(s["y"], F.array(y)).alias("y"))

    along = by_track().orderBy("block")
    given = [F.when(F.lag(F.lit(1)).over(along).isNull(), v * F.col(of)).otherwise(0.0) if of else F.lit(0.0) for v in start]
    blocked = blocked.withColumns({"_p": given[0], "_q": given[1]})
    rest = F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"))
    out = blocked.withColumn("_z", F.aggregate(x, rest, rested).cast(state)).withColumns({p: F.col("_z.p"), q: F.col("_z.q")}).drop("_z")
    m = np.linalg.matrix_power(np.array([[-c[3], 1.0], [-c[4], 0.0]]), size)
    span = 1
    while np.abs(m).max() > 1e-30:
        far = [F.coalesce(F.lag(v, span).over(along), F.lit(0.0)) for v in (p, q)]
        out = out.withColumns({"_p": far[0], "_q": far[1]}).withColumns({
            p: F.col(p) + float(m[0, 0]) * F.col("_p") + float(m[0, 1]) * F.col("_q"), q: F.col(q) + float(m[1, 0]) * F.col("_p") + float(m[1, 1]) * F.col("_q"),
        })
        m, span = m @ m, 2 * span
    before = [F.coalesce(F.lag(v).over(along), g) for v, g in zip((p, q), given, strict=True)]
    out = out.withColumns({"_p": before[0], "_q": before[1]})
    start = F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"), F.array().cast("array<double>").alias("y"))
    return out.withColumn(name, F.aggregate(x, start, run, lambda s: s["y"])).drop("_p", "_q", p, q)


def filtered(blocked: DataFrame, x: str, sections: list[Section], name: str) -> DataFrame:
    for n, c in enumerate(sections):
        blocked = section(blocked, x if n == 0 else f"_{name}{n - 1}", c, name if n == len(sections) - 1 else f"_{name}{n}")
    return blocked.drop(*[f"_{name}{n}" for n in range(len(sections) - 1)])


def bandpass(low: float, high: float) -> list[Section]:
    """Three sections of a filter of third order between two cutoffs, as shares of half the rate."""
    edges = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre = edges[1] - edges[0], math.sqrt(edges[0] * edges[1])
    half = -np.exp(1j * np.pi * np.array([-2, 0, 2]) / 6) * width / 2
    root = np.sqrt(half * half - centre * centre + 0j)
    analog = np.concatenate([half + root, half - root])
    gain = (width**3 * 4**3 / np.prod(4 - analog)).real
    poles = sorted((4 + analog) / (4 - analog), key=lambda v: (abs(v.imag) < 1e-12, round(abs(v), 12), v.real))
    upper = [v for v in poles if v.imag > 1e-12]
    real = sorted(v.real for v in poles if abs(v.imag) <= 1e-12)
    pairs = [(-2 * v.real, abs(v) ** 2) for v in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    return [((gain if n == 0 else 1.0), 0.0, -(gain if n == 0 else 1.0), a1, a2) for n, (a1, a2) in enumerate(pairs)]


def settled(sections: list[Section]) -> list[tuple[float, float]]:
    """State of each section after a constant input of one."""
    out, scale = [], 1.0
    for b0, b1, b2, a1, a2 in sections:
        p = ((b1 - a1 * b0) + (b2 - a2 * b0)) / (1 + a1 + a2)
        out.append((scale * p, scale * ((1 + a1) * p - (b1 - a1 * b0))))
        scale *= (b0 + b1 + b2) / (1 + a1 + a2)
    return out


def forth_and_back(signal: DataFrame, sections: list[Section]) -> DataFrame:
    """(track_id, i, x) without delay: once forwards and once backwards, each from rest on the first sample, with both ends turned
    over as far as the filter rings. Signals no longer than that stay as they are."""
    reach = 3 * (2 * len(sections) + 1)
    whole = by_track().orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = signal.select("track_id", "i", "x").withColumns({"n": F.count(F.lit(1)).over(by_track()), "left": F.first("x").over(whole), "right": F.last("x").over(whole)})
    ends = F.array(
        F.struct(F.col("i").alias("at"), F.col("x").alias("v")),
        F.when((F.col("i") >= 1) & (F.col("i") <= reach), F.struct((-F.col("i")).alias("at"), (2 * F.col("left") - F.col("x")).alias("v"))),
        F.when((F.col("i") >= F.col("n") - 1 - reach) & (F.col("i") <= F.col("n") - 2), F.struct((2 * (F.col("n") - 1) - F.col("i")).alias("at"), (2 * F.col("right") - F.col("x")).alias("v"))),
    )
    long = s.filter(F.col("n") > reach)
    turned = long.select("track_id", "n", F.inline(F.filter(ends, lambda e: e.isNotNull())))

    def once(rows: DataFrame) -> DataFrame:
        first = F.first(F.get("x", F.lit(0))).over(by_track().orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow))
        b = blocks(rows).withColumn("x0", first)
        for k, (c, state) in enumerate(zip(sections, settled(sections), strict=True)):
            b = section(b, "x" if k == 0 else f"y{k - 1}", c, f"y{k}", start=state, of="x0")
        each = b.select("track_id", "block", F.posexplode(f"y{len(sections) - 1}").alias("at", "x"))
        return each.select("track_id", (F.col("block") * BLOCK + F.col("at")).alias("i"), "x")

    last = long.select("track_id", (F.col("n") - 1 + 2 * reach).alias("last")).distinct()
    there = once(turned.select("track_id", (F.col("at") + reach).alias("i"), F.col("v").alias("x")))
    back = once(there.join(last, "track_id").select("track_id", (F.col("last") - F.col("i")).alias("i"), "x"))
    out = back.join(last, "track_id").select("track_id", (F.col("last") - F.col("i") - reach).alias("i"), "x", (F.col("last") - 2 * reach).alias("end"))
    return out.filter((F.col("i") >= 0) & (F.col("i") <= F.col("end"))).drop("end").unionByName(s.filter(F.col("n") <= reach).select("track_id", "i", "x")).repartition("track_id")


def struck(signal: DataFrame, rate: float, low: float = 25.0, high: float = 190.0, seconds: float = 0.008, most: float = 5.0) -> DataFrame:
    """(track_id, i, x): rises of the smoothed energy of a low band, over their 95th percentile, at most `most`."""
    lo, hi = max(low / (rate / 2), 1e-4), min(high / (rate / 2), 0.96)
    band = forth_and_back(signal, bandpass(lo, hi)) if hi > lo else signal
    k = max(1, round(seconds * rate))
    along = by_track().orderBy("i")
    around = along.rowsBetween(-(k - 1 - (k - 1) // 2), (k - 1) // 2)
    e = band.withColumn("e", F.sum(F.col("x") * F.col("x")).over(around) / k)
    rise = F.greatest(F.col("e") - F.coalesce(F.lag("e").over(along), F.col("e")), F.lit(0.0))
    r = e.withColumn("rise", rise)
    return r.select("track_id", "i", F.least(F.col("rise") / (F.percentile("rise", F.lit(0.95)).over(by_track()) + 1e-12), F.lit(most)).alias("x"))


def three_bands(signal: DataFrame, rate: float, bass_hz: float = 220.0, high_hz: float = 2600.0) -> DataFrame:
    """(track_id, i, x, low, mid, high): what passes below, what passes above of the rest, and the rest of that; they add up to x."""
    low = min(max(bass_hz / (rate / 2), 0.001), 0.90)
    high = min(max(high_hz / (rate / 2), low + 0.01), 0.98)
    less = lambda a, b: F.zip_with(a, b, lambda v, w: v - w)
    b = filtered(blocks(signal), "x", butterworth("low", low), "low").withColumn("rest", less("x", "low"))
    b = filtered(b, "rest", butterworth("high", high), "high").withColumn("mid", less("rest", "high"))
    each = b.select("track_id", "block", F.posexplode(F.arrays_zip("x", "low", "mid", "high")).alias("at", "s"))
    return each.select("track_id", (F.col("block") * BLOCK + F.col("at")).alias("i"), "s.x", "s.low", "s.mid", "s.high")


# resampling


def sinc_bank(up: int, down: int, half: int) -> list[tuple[int, int, float]]:
    """(phase, tap, weight): windowed sinc taps around each of `up` places between two samples; those of a place add up to 1."""
    cut = min(1.0, up / down)
    reach = half / cut
    bank = []
    for phase in range(up):
        taps = []
        for tap in range(-math.ceil(reach), math.ceil(reach) + 1):
            d = tap - phase / up
            if abs(d) < reach:
                x = d / reach
                window = 0.42 + 0.5 * math.cos(math.pi * x) + 0.08 * math.cos(2 * math.pi * x)
                taps.append((tap, window * (1.0 if d == 0 else math.sin(math.pi * cut * d) / (math.pi * cut * d))))
        total = sum(w for _, w in taps)
        bank += [(phase, tap, w / total) for tap, w in taps]
    return bank


def resampled(signal: DataFrame, rate: int, to: int, half: int = 16) -> DataFrame:
    """(track_id, i, x) at another rate: every sample meets the taps of the places it reaches, a join with a filter bank by phase.

    The bank has up to `to`/gcd phases of 2*half taps (more where the rate falls), whatever the data; one aggregate by place, which
    sums within a task first. As many samples as the same time holds, rounded up.
    """
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return signal.select("track_id", "i", "x")
    bank = signal.sparkSession.createDataFrame(sinc_bank(up, down, half), "phase int, tap int, w double")
    reach = half / min(1.0, up / down)
    n = F.count(F.lit(1)).over(by_track())
    first = F.greatest(F.ceil((F.col("i") - reach) * up / down), F.lit(0))
    last = F.least(F.floor((F.col("i") + reach) * up / down), F.ceil(F.col("n") * up / down) - 1)
    reached = signal.withColumn("n", n).withColumns({"first": first, "last": last}).filter("first <= last").withColumn("m", F.explode(F.sequence("first", "last")))
    place = F.col("m") * down
    each = reached.select("track_id", "m", "x", (place % up).cast("int").alias("phase"), (F.col("i") - F.floor(place / up)).cast("int").alias("tap"))
    sums = each.join(F.broadcast(bank), ["phase", "tap"]).groupBy("track_id", F.col("m").alias("i")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    return sums


def padded(signal: DataFrame, least: int) -> DataFrame:
    """Signals shorter than `least` samples go on with zeros."""
    lengths = signal.groupBy("track_id").agg((F.max("i") + 1).alias("n")).filter(F.col("n") < least)
    more = lengths.select("track_id", F.explode(F.sequence(F.col("n"), F.lit(least).cast("long") - 1)).alias("i"), F.lit(0.0).alias("x"))
    return signal.select("track_id", F.col("i").cast("long").alias("i"), "x").unionByName(more)


def mono(channels: DataFrame) -> DataFrame:
    """(track_id, i, x) as the mean of (track_id, i, channel, x)."""
    return channels.groupBy("track_id", "i").agg(F.avg("x").alias("x"))
