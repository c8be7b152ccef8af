"""Spectra of signals as rows: windowed Fourier transforms, features of frames and bars, medians of spectrograms, resynthesis.

A signal is (track_id, i, x), i from 0; a spectrum is (track_id, frame, k, re, im), k from 0 to size/2. A transform of n = a*b
points is two joins with small tables of turns, over a and over b points (a + b products per point instead of n), both behind
one exchange by (track_id, frame): the aggregates need no further one. The tables hold a*a and n*b/2 rows, whatever the data.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import clip
from ..functions.windows import by_track
from .structure import unit

FRAME = ("track_id", "frame")


# transforms


def hann(j: Column, size: int) -> Column:
    """Periodic Hann window."""
    return 0.5 - 0.5 * F.cos(j * (2 * math.pi / size))


def frames(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """(track_id, frame, j, x): frames centred on every hop-th sample; what lies outside of the signal is 0 and has no row."""
    half, i = size // 2, F.col("i")
    n = F.count(F.lit(1)).over(by_track())
    first = F.greatest(F.ceil((i + half - size + 1) / hop), F.lit(0))
    last = F.least(F.floor((i + half) / hop), F.floor(F.col("n") / hop))
    each = signal.withColumn("n", n).withColumn("frame", F.explode(F.sequence(first, last)))
    return each.select("track_id", "frame", (i + half - F.col("frame") * hop).cast("int").alias("j"), "x")


def _split(n: int) -> tuple[int, int]:
    a = max(d for d in range(1, int(math.isqrt(n)) + 1) if n % d == 0)
    return a, n // a


def _turns(spark: SparkSession, a: int, b: int, sign: int, half: bool) -> tuple[DataFrame, DataFrame]:
    """Tables of the two steps: (ja, c, cos, sin) over a points, and (jb, c, k, cos, sin) from a*b points to k."""
    n = a * b
    turn = lambda x, m: ((x % m) * (2 * math.pi * sign / m))
    one = spark.range(a * a).select(F.floor(F.col("id") / a).cast("int").alias("ja"), (F.col("id") % a).cast("int").alias("c"))
    two = spark.range(n * b).select(F.floor(F.col("id") / n).cast("int").alias("jb"), (F.col("id") % n).cast("int").alias("k")).withColumn("c", F.col("k") % a)
    if half:
        two = two.filter(F.col("k") <= n // 2)
    with_turn = lambda t, x, m: t.withColumn("w", turn(x, m)).withColumns({"cos": F.cos("w"), "sin": F.sin("w")}).drop("w")
    return with_turn(one, F.col("ja") * F.col("c"), a), with_turn(two, F.col("jb") * F.col("k"), n)


def transform(rows: DataFrame, n: int, sign: int = -1, half: bool = True) -> DataFrame:
    """Discrete Fourier transform of each frame: (track_id, frame, j, re, im) to (track_id, frame, k, re, im), unscaled."""
    a, b = _split(n)
    one, two = _turns(rows.sparkSession, a, b, sign, half)
    re, im, cos, sin = (F.col(c) for c in ("re", "im", "cos", "sin"))
    sums = (F.sum(re * cos - im * sin).alias("re"), F.sum(re * sin + im * cos).alias("im"))
    dealt = rows.repartition(*FRAME).select(*FRAME, F.floor(F.col("j") / b).cast("int").alias("ja"), (F.col("j") % b).cast("int").alias("jb"), "re", "im")
    step = dealt.join(F.broadcast(one), "ja").groupBy(*FRAME, "jb", "c").agg(*sums)
    return step.join(F.broadcast(two), ["jb", "c"]).groupBy(*FRAME, "k").agg(*sums)


def spectrum(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """Spectrum of every frame under a Hann window."""
    framed = frames(signal, size, hop)
    return transform(framed.select(*FRAME, "j", (F.col("x") * hann(F.col("j"), size)).alias("re"), F.lit(0.0).alias("im")), size)


def resynthesis(spectra: DataFrame, lengths: DataFrame, size: int, hop: int) -> DataFrame:
    """(track_id, i, x) of lengths (track_id, length): frames transformed back, windowed, overlapped and divided by the windows' weight."""
    whole = spectra.withColumn("side", F.explode(F.when((F.col("k") > 0) & (F.col("k") < size // 2), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))))
    mirrored = whole.select(*FRAME, F.when(F.col("side") == 1, F.col("k")).otherwise(size - F.col("k")).cast("int").alias("j"), "re", (F.col("im") * F.col("side")).alias("im"))
    back = transform(mirrored, size, sign=1, half=False).select(*FRAME, F.col("k").alias("j"), (F.col("re") / size).alias("y"))
    w = hann(F.col("j"), size)
    at = F.col("frame") * hop + F.col("j") - size // 2
    added = back.select("track_id", at.alias("i"), (F.col("y") * w).alias("y"), (w * w).alias("w")).filter("i >= 0").groupBy("track_id", "i").agg(F.sum("y").alias("y"), F.sum("w").alias("w"))
    full = lengths.filter("length > 0").select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("i"))
    x = F.when(F.col("w") > 1e-9, F.col("y") / F.col("w")).otherwise(F.coalesce("y", F.lit(0.0)))
    return full.join(added, ["track_id", "i"], "left").select("track_id", "i", x.alias("x"))


def limited(signal: DataFrame, most: float = 0.995) -> DataFrame:
    """Signals whose peak is above `most` scaled down to it."""
    peak = F.max(F.abs("x")).over(by_track())
    return signal.withColumn("x", F.when(peak > most, F.col("x") * most / peak).otherwise(F.col("x")))


# features


def chroma_bank(rate: float, size: int) -> list[list[float]]:
    """Weight of bin k in each of 12 pitch classes: bumps one bin wide, weighted by octave around the fifth."""
    pitch = [12 * math.log2(k * rate / size / 27.5) for k in range(1, size)]
    pitch.insert(0, pitch[0] - 18)
    bank = []
    for k in range(size // 2 + 1):
        width = max(pitch[k + 1] - pitch[k], 1.0) if k + 1 < size else 1.0
        bump = [math.exp(-0.5 * (2 * (((pitch[k] - c + 126) % 12) - 6) / width) ** 2) for c in range(12)]
        scale = math.exp(-0.5 * ((pitch[k] / 12 - 5) / 2) ** 2) / math.sqrt(sum(v * v for v in bump))
        bank.append([bump[(c + 3) % 12] * scale for c in range(12)])
    return bank


def mel_bank(rate: float, size: int, mels: int) -> list[list[tuple[int, float]]]:
    """Bins and weights of triangles of unit area, evenly spaced in mels: linear below 1 kHz, logarithmic above."""
    step = math.log(6.4) / 27
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * step)
    edge = [to_hz(to_mel(rate / 2) * i / (mels + 1)) for i in range(mels + 2)]
    out = []
    for low, mid, high in zip(edge, edge[1:], edge[2:], strict=False):
        rise = [(k, min((k * rate / size - low) / (mid - low), (high - k * rate / size) / (high - mid))) for k in range(size // 2 + 1)]
        out.append([(k, w * 2 / (high - low)) for k, w in rise if w > 0])
    return out


def frame_features(spectra: DataFrame, rate: float, size: int, hop: int, mels: int = 128) -> DataFrame:
    """Per frame: t, rms, onset strength, flatness, centroid, energy shares below 180 Hz and in 220..4500 Hz, 12 chroma.

    One aggregate per frame over its bins, then one window per track for the rises of the mel bands.
    """
    spark = spectra.sparkSession
    bank = spark.createDataFrame([(k, w) for k, w in enumerate(chroma_bank(rate, size))], "k int, chroma array<double>")
    power, hz = F.col("p"), F.col("k") * (rate / size)
    at_edge = (F.col("k") == 0) | (F.col("k") == size // 2)
    some = F.greatest(power, F.lit(1e-10))
    bins = spectra.withColumn("p", F.col("re") * F.col("re") + F.col("im") * F.col("im")).withColumn("m", F.sqrt("p")).join(F.broadcast(bank), "k")
    share = lambda inside: F.sum(F.when(inside, power).otherwise(0.0)) / (F.sum(power) + 1e-12)
    f = bins.groupBy(*FRAME).agg(
        (F.sqrt(2 * F.sum(F.when(at_edge, power / 2).otherwise(power))) / size).alias("rms"),
        (F.exp(F.avg(F.log(some))) / F.avg(some)).alias("flatness"),
        (F.sum(hz * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-30))).alias("centroid"),
        share(hz <= 180.0).alias("low"),
        share((hz >= 220.0) & (hz <= 4500.0)).alias("mid"),
        *[F.sum(F.col("m") * F.get("chroma", F.lit(c))).alias(f"c{c}") for c in range(12)],
        F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("powers"),
    )
    filters = F.from_json(F.lit(json.dumps([[{"k": k, "w": w} for k, w in m] for m in mel_bank(rate, size, mels)])), "array<array<struct<k:int,w:double>>>")
    energy = F.transform(filters, lambda m: F.aggregate(m, F.lit(0.0), lambda s, kw: s + kw["w"] * F.try_element_at("powers", kw["k"])))
    db = f.withColumn("db", F.transform(energy, lambda e: 10 * F.log10(F.greatest(e, F.lit(1e-10))))).drop("powers")
    floor = F.max(F.array_max("db")).over(by_track()) - 80.0
    db = db.withColumn("floor", floor).withColumn("db", F.transform("db", lambda v: F.greatest(v, F.col("floor")))).drop("floor")
    along = by_track().orderBy("frame")
    rise = F.aggregate(F.zip_with("db", F.lag("db").over(along), lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v) / mels
    risen = db.withColumn("rise", rise).drop("db").withColumn("onset", F.coalesce(F.lag("rise", size // (2 * hop)).over(along), F.lit(0.0))).drop("rise")
    top = F.greatest(*[F.col(f"c{c}") for c in range(12)])
    return risen.withColumns({f"c{c}": F.when(top > 1e-30, F.col(f"c{c}") / top).otherwise(F.col(f"c{c}")) for c in range(12)}).withColumn("t", F.col("frame") * (hop / rate))


def bar_features(features: DataFrame, bars: DataFrame, rate: float) -> DataFrame:
    """Per bar (track_id, bar, start, end): level, low share, onset, brightness, vocal share and chroma of unit length.

    Frames and bars meet in one window over the union of both; a bar without frames takes the nearest one.
    """
    cols = ["rms", "low", "onset", "centroid", "vocal", *(f"c{c}" for c in range(12))]
    f = features.withColumn("vocal", F.col("mid") * (1.0 - clip(F.col("flatness")))).select("track_id", "t", *cols)
    empty = [F.lit(None).cast("double").alias(c) for c in cols]
    b = bars.select("track_id", F.col("start").alias("t"), *empty, F.struct("bar", "start", "end").alias("b"))
    along = W.partitionBy("track_id").orderBy("t", F.col("b").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("track_id").orderBy("t", F.col("b").isNotNull()).rowsBetween(W.currentRow, W.unboundedFollowing)
    frame = F.when(F.col("b").isNull(), F.struct("t", *cols))
    both = f.withColumn("b", F.lit(None).cast(b.schema["b"].dataType)).unionByName(b).repartition("track_id")
    both = both.withColumns({"in": F.last("b", True).over(along), "before": F.last(frame, True).over(along), "after": F.first(frame, True).over(after)})
    inside = both.filter(F.col("b").isNull() & (F.col("t") < F.col("in.end")))
    means = inside.groupBy("track_id", F.col("in.bar").alias("bar")).agg(*[F.avg(c).alias(c) for c in cols])
    back = F.coalesce(F.abs(F.col("t") - F.col("before.t")), F.lit(float("inf")))
    forth = F.coalesce(F.abs(F.col("after.t") - F.col("t")), F.lit(float("inf")))
    near = both.filter(F.col("b").isNotNull()).select("track_id", F.col("b.bar").alias("bar"), F.when(back <= forth, F.col("before")).otherwise(F.col("after")).alias("f"))
    all_bars = near.join(means, ["track_id", "bar"], "left").select("track_id", "bar", *[F.coalesce(c, F.col(f"f.{c}")).alias(c) for c in cols])
    length = F.sqrt(sum((F.col(f"c{c}") * F.col(f"c{c}") for c in range(12)), F.lit(0.0)))
    scaled = all_bars.withColumns({"onset": unit(F.col("onset"), 0.1, 0.9, eps=1e-10), "vocal": unit(F.col("vocal"), 0.1, 0.9, eps=1e-10)} | {f"c{c}": F.when(length > 1e-9, F.col(f"c{c}") / length).otherwise(F.col(f"c{c}")) for c in range(12)})
    return scaled.select("track_id", "bar", "rms", clip(F.col("low")).alias("low_ratio"), "onset", clip(F.col("centroid") / (rate / 2)).alias("brightness"), clip(F.col("vocal") * (1.0 - 0.25 * F.col("onset"))).alias("vocal"), *[f"c{c}" for c in range(12)])


def acoustic_summary(features: DataFrame, rate: float) -> DataFrame:
    """Six numbers per track: level, onsets, brightness, flatness, low share, and the range of levels."""
    p = lambda share: F.percentile("rms", F.lit(share))
    return features.groupBy("track_id").agg(
        F.log10(F.avg("rms") + 1e-8).alias("level"), (F.avg("onset") / 10.0).alias("onset"), (F.avg("centroid") / (rate / 2)).alias("brightness"),
        F.avg("flatness").alias("flatness"), F.avg("low").alias("low_ratio"), (p(0.9) - p(0.1)).alias("dynamics"),
    )


# harmonic and percussive parts


def mirrored(rows: DataFrame, axis: str, n: Column, reach: int) -> DataFrame:
    """rows with copies on `axis` beyond both ends, up to `reach`, as if mirrors stood before the first and behind the last."""
    p, period = F.col(axis), 2 * n
    copies = lambda at: F.transform(F.filter(F.sequence(F.ceil((-reach - at) / period), F.floor((n - 1 + reach - at) / period)), lambda m: at + m * period >= -reach), lambda m: at + m * period)
    some = lambda at: F.when(F.floor((n - 1 + reach - at) / period) >= F.ceil((-reach - at) / period), copies(at)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("_at", F.explode(F.concat(some(p.cast("long")), some((-1 - p).cast("long")))))


def running_median(rows: DataFrame, axis: str, along: list[str], n: Column, width: int, value: str, name: str) -> DataFrame:
    """rows with the median of `value` over `width` neighbours on `axis`, mirrored at both ends."""
    reach = width // 2
    w = W.partitionBy(*along).orderBy("_at").rowsBetween(-reach, reach)
    return mirrored(rows, axis, n, reach).withColumn(name, F.percentile(value, F.lit(0.5)).over(w)).filter(F.col("_at") == F.col(axis)).drop("_at")


def soft_mask(x: Column, other: Column, split: bool, power: float = 2.0) -> Column:
    """Share of x against the other; where both vanish one half if they split, else none."""
    z = F.greatest(x, other)
    a, b = F.pow(x / z, F.lit(power)), F.pow(other / z, F.lit(power))
    return F.when(z < 1.1754943508222875e-38, F.lit(0.5 if split else 0.0)).otherwise(a / (a + b))


def harmonic_percussive(spectra: DataFrame, size: int, width: int = 31, margins: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """spectra with harmonic and percussive: soft masks from medians along time and along frequency. With margins of 1 they add up to 1."""
    n_frames = F.max("frame").over(by_track()) + 1
    m = spectra.withColumns({"m": F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), "n_frames": n_frames})
    flat = running_median(m, "k", ["track_id", "frame"], F.lit(size // 2 + 1), width, "m", "across")
    both = running_median(flat, "frame", ["track_id", "k"], F.col("n_frames"), width, "m", "along")
    split, (mh, mp) = margins == (1.0, 1.0), margins
    h, p = F.col("along"), F.col("across")
    return both.withColumns({"harmonic": soft_mask(h, p * mh, split), "percussive": soft_mask(p, h * mp, split)}).drop("along", "across", "n_frames")


# stretching along a time map


def valid_map(keyframes: DataFrame, lengths: DataFrame, strict: bool = False) -> DataFrame:
    """(track_id, source, target): from (0, 0) to the end of each signal, sources and targets rising.

    Keyframes outside of the signal are left out; of equal sources the least target counts; the map goes on to the end with its
    last slope; a target that does not rise is raised to one more than the one before. `strict` stops the job there.
    """
    known = keyframes.filter((F.col("source") >= 0) & (F.col("target") >= 0)).groupBy("track_id", F.col("source").cast("long").alias("source")).agg(F.min("target").cast("long").alias("target"))
    # the keyframes of one recording: an array that its two ends are added to
    maps = lengths.join(known.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("k")), "track_id", "left").filter("length > 0")
    point = lambda x, y: F.struct(x.cast("long").alias("source"), y.cast("long").alias("target"))
    inside = F.filter(F.coalesce("k", F.array().cast("array<struct<source:bigint,target:bigint>>")), lambda p: p["source"] <= F.col("length"))
    maps = maps.withColumn("k", inside)
    maps = maps.withColumn("k", F.when(F.coalesce(F.get("k", F.lit(0))["source"] == 0, F.lit(False)), F.col("k")).otherwise(F.concat(F.array(point(F.lit(0), F.lit(0))), "k")))
    last, before = F.element_at("k", -1), F.get("k", F.size("k") - 2)
    slope = F.coalesce((last["target"] - before["target"]) / F.greatest(last["source"] - before["source"], F.lit(1)), F.lit(1.0))
    end = point(F.col("length"), last["target"] + F.bround((F.col("length") - last["source"]) * slope))
    maps = maps.withColumn("k", F.when(last["source"] == F.col("length"), F.col("k")).otherwise(F.concat("k", F.array(end))))
    every = maps.select("track_id", F.posexplode("k").alias("i", "p")).select("track_id", "i", "p.source", "p.target")
    raised = (F.max(F.col("target") - F.col("i")).over(by_track().orderBy("i")) + F.col("i")).cast("long")
    stop = F.raise_error(F.concat(F.lit("time map turns back in track "), F.col("track_id").cast("string"))).cast("long")
    return every.withColumn("raised", raised).select("track_id", "source", F.when(F.col("raised") == F.col("target"), F.col("raised")).otherwise(stop if strict else F.col("raised")).alias("target"))


def stretched(signal: DataFrame, keyframes: DataFrame, size: int, strict: bool = False) -> DataFrame:
    """(track_id, i, x) along a time map by a phase vocoder: magnitudes between frames, wrapped phase steps summed by a window per bin."""
    from .timemap import interpolate

    hop = size // 4
    lengths = signal.groupBy("track_id").agg(F.count(F.lit(1)).alias("length"))
    tmap = valid_map(keyframes, lengths, strict)
    ends = tmap.groupBy("track_id").agg(F.max("target").alias("length"), F.max("source").alias("n"))
    grid = ends.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("length") + hop) / hop) - 1)))
    points = grid.select("track_id", "o", F.least(F.col("o") * hop, F.col("length")).cast("double").alias("x"), (F.floor(F.col("n") / hop) + 1).alias("n_frames"))
    keys = tmap.select("track_id", F.col("target").cast("double").alias("x"), F.col("source").cast("double").alias("y"))
    at = points.join(interpolate(points.select("track_id", "x").distinct(), keys), ["track_id", "x"])
    step = F.least(F.greatest(F.col("y") / hop, F.lit(0.0)), F.col("n_frames") - 0.001)
    at = at.select("track_id", "o", F.floor(step).alias("frame"), (step - F.floor(step)).alias("alpha"))
    return limited(resynthesis(vocoded(spectrum(signal, size, hop), at, size, hop), ends.select("track_id", "length"), size, hop))


def vocoded(spectra: DataFrame, at: DataFrame, size: int, hop: int, phase_first: bool = True) -> DataFrame:
    """Spectra of new frames o that lie `alpha` after `frame`, of at (track_id, o, frame, alpha).

    Each takes the step of its own place, or, not phase_first, the steps of those before.
    """
    bins = size // 2 + 1
    left = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(spectra, [*FRAME, "k"], "left")
    right = spectra.select("track_id", (F.col("frame") - 1).alias("frame"), "k", F.col("re").alias("re1"), F.col("im").alias("im1"))
    both = left.join(right, [*FRAME, "k"], "left").fillna(0.0, ["re", "im", "re1", "im1"])
    a, b = F.col("alpha"), 1.0 - F.col("alpha")
    size_of = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    angle = lambda x, y: F.atan2(F.col(y), F.col(x))
    advance = F.col("k") * (math.pi * hop / (bins - 1))
    moved = angle("re1", "im1") - angle("re", "im") - advance
    step = advance + moved - 2 * math.pi * F.bround(moved / (2 * math.pi))
    along = W.partitionBy("track_id", "k").orderBy("o")
    if phase_first:
        first = F.atan2(b * F.col("im") + a * F.col("im1"), b * F.col("re") + a * F.col("re1"))
        phase = F.sum(F.when(F.col("o") == 0, first).otherwise(step)).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    else:
        first = F.first(angle("re", "im")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
        phase = first + F.coalesce(F.sum(step).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    polar = both.withColumns({"m": b * size_of("re", "im") + a * size_of("re1", "im1"), "phase": phase})
    return polar.select("track_id", F.col("o").alias("frame"), "k", (F.col("m") * F.cos("phase")).alias("re"), (F.col("m") * F.sin("phase")).alias("im"))
