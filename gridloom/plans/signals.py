"""Queries on signals: the values of events, in time order, as samples of one signal per track."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, seam, spectra, stretch, timemap
from ..sources import projections as P
from . import oracle as O
from .catalog import query, r, r6

SIZE, HOP, RATE, MELS, WIDTH = 32, 8, 2048.0, 8, 31
BINS = SIZE // 2 + 1


def signal(spark: SparkSession, d: str) -> DataFrame:
    return P.events(spark, d).select("track_id", F.col("idx").alias("i"), (F.col("value") / 250.0 - 1).alias("x"))


def _spectrum(spark: SparkSession, d: str) -> DataFrame:
    return spectra.spectrum(signal(spark, d), SIZE, HOP)


SIGNAL = f"{O.EVENTS}, sig AS (SELECT track_id, idx AS i, value / 250.0::DOUBLE - 1 AS x FROM ev)"


def spectrum_sql(source: str = "sig", name: str = "sp", size: int = SIZE, hop: int = HOP) -> str:
    """Spectrum by the definition: every sample of a frame with every bin."""
    j = f"(i + {size // 2} - frame * {hop})"
    turn = f"2 * pi() * ((k * j) % {size}) / {size}"
    return f"""{name}n AS (SELECT track_id, count(*) AS n FROM {source} GROUP BY track_id),
{name}f AS (SELECT track_id, frame, {j} AS j, x * (0.5 - 0.5 * cos(2 * pi() * {j} / {size})) AS y FROM (SELECT track_id, i, x, unnest(range(CAST(greatest(0, ceil((i + {size // 2} - {size - 1}) / {hop}.0)) AS BIGINT), CAST(least((i + {size // 2}) // {hop}, n // {hop}) + 1 AS BIGINT))) AS frame FROM {source} JOIN {name}n USING (track_id))),
{name} AS (SELECT track_id, frame, k, sum(y * cos({turn})) AS re, -sum(y * sin({turn})) AS im FROM {name}f, range(0, {size // 2 + 1}) b(k) GROUP BY ALL)"""


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(f'{v!r}::DOUBLE' if isinstance(v, float) else str(v) for v in row) + ')' for row in rows)})"


FEATURES = f"""{_values("cb", "k, c, w", [(k, c, w) for k, ws in enumerate(spectra.chroma_bank(RATE, SIZE)) for c, w in enumerate(ws)])},
{_values("mb", "mel, k, w", [(m, k, w) for m, ws in enumerate(spectra.mel_bank(RATE, SIZE, MELS)) for k, w in ws])},
mels AS (SELECT unnest(range(0, {MELS})) AS mel),
pw AS (SELECT *, re * re + im * im AS p, k * {RATE / SIZE}::DOUBLE AS hz FROM sp),
base AS (SELECT track_id, frame, frame * {HOP} / {RATE}::DOUBLE AS t, sqrt(2 * sum(CASE WHEN k IN (0, {SIZE // 2}) THEN p / 2 ELSE p END) / {SIZE * SIZE}) AS rms, exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS flatness,
 sum(hz * sqrt(p)) / greatest(sum(sqrt(p)), 1e-30) AS centroid, coalesce(sum(p) FILTER (hz <= 180), 0) / (sum(p) + 1e-12) AS low, coalesce(sum(p) FILTER (hz BETWEEN 220 AND 4500), 0) / (sum(p) + 1e-12) AS mid FROM pw GROUP BY track_id, frame),
ch0 AS (SELECT track_id, frame, c, sum(sqrt(p) * w) AS v FROM pw JOIN cb USING (k) GROUP BY ALL),
ch AS (SELECT track_id, frame, list(CASE WHEN m > 1e-30 THEN v / m ELSE v END ORDER BY c) AS chroma FROM (SELECT *, max(v) OVER (PARTITION BY track_id, frame) AS m FROM ch0) GROUP BY ALL),
me AS (SELECT b.track_id, b.frame, m.mel, 10 * log10(greatest(1e-10, coalesce(sum(p * w), 0))) AS db FROM base b, mels m LEFT JOIN mb ON mb.mel = m.mel LEFT JOIN pw ON pw.track_id = b.track_id AND pw.frame = b.frame AND pw.k = mb.k GROUP BY ALL),
mc AS (SELECT track_id, frame, mel, greatest(db, max(db) OVER (PARTITION BY track_id) - 80) AS db FROM me),
ri AS (SELECT track_id, frame, sum(rise) / {MELS} AS rise FROM (SELECT track_id, frame, greatest(0.0, db - lag(db) OVER (PARTITION BY track_id, mel ORDER BY frame)) * CASE WHEN frame > 0 THEN 1 END AS rise FROM mc) GROUP BY ALL),
ff AS (SELECT base.*, chroma, coalesce(lag(rise, {SIZE // (2 * HOP)}) OVER (PARTITION BY track_id ORDER BY frame), 0.0) AS onset FROM base JOIN ch USING (track_id, frame) JOIN ri USING (track_id, frame))"""

CHROMA = ", ".join(f"round(chroma[{c + 1}], 6) + 0.0 AS c{c}" for c in range(12))


@query(f"WITH {SIGNAL}, {spectrum_sql()} SELECT track_id, frame, CAST(k AS INT) AS k, {r('re', 'im')} FROM sp")
def spectral_frames(spark, d):
    """Every bin of every frame of every track."""
    return r6(_spectrum(spark, d).select("track_id", "frame", "k", "re", "im"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return spectra.frame_features(_spectrum(spark, d), RATE, SIZE, HOP, MELS)


@query(f"WITH {SIGNAL}, {spectrum_sql()}, {FEATURES} SELECT track_id, frame, {r('t', 'rms', 'flatness', 'centroid', 'low', 'mid', 'onset')}, {CHROMA} FROM ff")
def frame_spectra(spark, d):
    return r6(_features(spark, d).select("track_id", "frame", "t", "rms", "flatness", "centroid", "low", "mid", "onset", *[f"c{c}" for c in range(12)]))


def signal_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of 5 to 18 samples by event, the shortest of which hold no frame."""
    e = P.events(spark, d).filter("(event_id + k) % 9 = 0 OR idx = 0")
    w = spectra.by_track().orderBy("idx")
    ends = F.coalesce(F.lead("idx").over(w), F.col("idx") + 16)
    return e.select("track_id", (F.row_number().over(w) - 1).cast("long").alias("bar"), (F.col("idx") / RATE).alias("start"), (ends / RATE).alias("end"))


BARS = f"""bb AS (SELECT track_id, row_number() OVER w - 1 AS bar, idx / {RATE}::DOUBLE AS s, coalesce(lead(idx) OVER w, idx + 16) / {RATE}::DOUBLE AS e FROM ev WHERE (event_id + k) % 9 = 0 OR idx = 0 WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
bi AS (SELECT track_id, bar, frame FROM bb JOIN ff USING (track_id) WHERE t >= s AND t < e),
bn AS (SELECT track_id, bar, arg_min(frame, (abs(t - s), t)) AS frame FROM bb JOIN ff USING (track_id) WHERE NOT EXISTS (SELECT 1 FROM bi WHERE bi.track_id = bb.track_id AND bi.bar = bb.bar) GROUP BY track_id, bar),
bm AS (SELECT track_id, bar, avg(rms) AS rms, avg(low) AS low, avg(onset) AS onset, avg(centroid) AS centroid, avg(mid * (1 - greatest(0.0, least(1.0, flatness)))) AS vocal, {', '.join(f'avg(chroma[{c + 1}]) AS c{c}' for c in range(12))} FROM (SELECT * FROM bi UNION ALL SELECT * FROM bn) JOIN ff USING (track_id, frame) GROUP BY track_id, bar),
bs AS (SELECT *, sqrt({' + '.join(f'c{c} * c{c}' for c in range(12))}) AS len, {O.unit('onset', 0.1, 0.9, 'PARTITION BY track_id')} AS ou, {O.unit('vocal', 0.1, 0.9, 'PARTITION BY track_id')} AS vu FROM bm)"""


@query(f"""WITH {SIGNAL}, {spectrum_sql()}, {FEATURES}, {BARS} SELECT track_id, bar, round(rms, 6) + 0.0 AS rms, round(greatest(0.0, least(1.0, low)), 6) + 0.0 AS low_ratio, round(ou, 6) + 0.0 AS onset, round(greatest(0.0, least(1.0, centroid / {RATE / 2})), 6) + 0.0 AS brightness,
round(greatest(0.0, least(1.0, vu * (1 - 0.25 * ou))), 6) + 0.0 AS vocal, {', '.join(f'round(CASE WHEN len > 1e-9 THEN c{c} / len ELSE c{c} END, 6) + 0.0 AS c{c}' for c in range(12))} FROM bs""")
def bar_spectra(spark, d):
    return r6(spectra.bar_features(_features(spark, d), signal_bars(spark, d), RATE))


@query(f"""WITH {SIGNAL}, {spectrum_sql()}, {FEATURES} SELECT track_id, round(log10(avg(rms) + 1e-8), 6) + 0.0 AS level, round(avg(onset) / 10, 6) + 0.0 AS onset, round(avg(centroid) / {RATE / 2}, 6) + 0.0 AS brightness, round(avg(flatness), 6) + 0.0 AS flatness,
round(avg(low), 6) + 0.0 AS low_ratio, round(quantile_cont(rms, 0.9) - quantile_cont(rms, 0.1), 6) + 0.0 AS dynamics FROM ff GROUP BY track_id""")
def acoustic_summary(spark, d):
    return r6(spectra.acoustic_summary(_features(spark, d), RATE))


@query(f"""WITH {O.TRACKS}, sig AS (SELECT track_id, unnest(range(0, 64)) AS i, unnest(g) AS x FROM tracks), {spectrum_sql()}, {FEATURES} SELECT track_id, round(log10(avg(rms) + 1e-8), 6) + 0.0 AS level, round(avg(onset) / 10, 6) + 0.0 AS onset, round(avg(centroid) / {RATE / 2}, 6) + 0.0 AS brightness, round(avg(flatness), 6) + 0.0 AS flatness,
round(avg(low), 6) + 0.0 AS low_ratio, round(quantile_cont(rms, 0.9) - quantile_cont(rms, 0.1), 6) + 0.0 AS dynamics FROM ff GROUP BY track_id""")
def clip_features(spark, d):
    """Six numbers of every embedding, read as a short clip."""
    s = P.tracks(spark, d).select("track_id", F.posexplode("global").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    return r6(spectra.acoustic_summary(spectra.frame_features(spectra.spectrum(s, SIZE, HOP), RATE, SIZE, HOP, MELS), RATE))


def _reflected(axis: str, n: str, along: str, value: str, name: str, source: str) -> str:
    reach = WIDTH // 2
    return f"""{name}0 AS (SELECT *, unnest(list_filter(range(-{reach}, {n} + {reach}), lambda q: (q % (2 * {n}) + 2 * {n}) % (2 * {n}) IN ({axis}, 2 * {n} - 1 - {axis}))) AS pos FROM {source}),
{name} AS (SELECT * EXCLUDE (pos) FROM (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY {along} ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS {name}m FROM {name}0) WHERE pos = {axis})"""


MASKS = f"""mg AS (SELECT track_id, frame, k, sqrt(re * re + im * im) AS m, max(frame) OVER (PARTITION BY track_id) + 1 AS nf FROM sp),
{_reflected("k", str(BINS), "track_id, frame", "m", "ac", "mg")}, {_reflected("frame", "nf", "track_id, k", "m", "al", "ac")},
mk AS (SELECT track_id, frame, k, m, alm AS h, acm AS p, greatest(alm, acm) AS z FROM al),
mq AS (SELECT *, CASE WHEN z < 1.1754943508222875e-38 THEN 0.5 ELSE (h / z) * (h / z) / ((h / z) * (h / z) + (p / z) * (p / z)) END AS hm FROM mk)"""


@query(f"WITH {SIGNAL}, {spectrum_sql()}, {MASKS} SELECT track_id, frame, CAST(k AS INT) AS k, round(m, 6) + 0.0 AS m, round(hm, 6) + 0.0 AS harmonic, round(CASE WHEN z < 1.1754943508222875e-38 THEN 0.5 ELSE (p / z) * (p / z) / ((h / z) * (h / z) + (p / z) * (p / z)) END, 6) + 0.0 AS percussive FROM mq")
def soft_masks(spark, d):
    """Shares of every bin that are steady in time or spread over frequency."""
    return r6(spectra.harmonic_percussive(_spectrum(spark, d), SIZE, WIDTH).select("track_id", "frame", "k", "m", "harmonic", "percussive"))


def resynthesis_sql(source: str, lengths: str, name: str, size: int = SIZE, hop: int = HOP) -> str:
    """Samples by the definition: every bin of a frame with every sample, windowed, overlapped, divided by the windows."""
    turn = f"2 * pi() * ((k * j) % {size}) / {size}"
    return f"""{name}t AS (SELECT track_id, frame, j, sum(CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END * (re * cos({turn}) - CASE WHEN k IN (0, {size // 2}) THEN 0 ELSE im END * sin({turn}))) / {size} AS y, 0.5 - 0.5 * cos(2 * pi() * j / {size}) AS w FROM {source}, range(0, {size}) b(j) GROUP BY ALL),
{name}o AS (SELECT track_id, frame * {hop} + j - {size // 2} AS i, sum(y * w) AS y, sum(w * w) AS w FROM {name}t GROUP BY ALL),
{name} AS (SELECT track_id, l.i, CASE WHEN w > 1e-9 THEN y / w ELSE coalesce(y, 0.0) END AS x FROM (SELECT track_id, unnest(range(0, length)) AS i FROM {lengths}) l LEFT JOIN {name}o o USING (track_id, i))"""


@query(f"""WITH {SIGNAL}, {spectrum_sql()}, {MASKS}, hs AS (SELECT track_id, frame, k, sp.re * hm AS re, sp.im * hm AS im FROM sp JOIN mq USING (track_id, frame, k)), ln AS (SELECT track_id, n AS length FROM spn), {resynthesis_sql("hs", "ln", "hx")}
SELECT track_id, i, round(hx.x, 6) + 0.0 AS harmonic, round(sig.x - hx.x, 6) + 0.0 AS percussive FROM hx JOIN sig USING (track_id, i)""")
def harmonic_parts(spark, d):
    """Both parts of every signal; they add up to it."""
    s = signal(spark, d)
    masked = spectra.harmonic_percussive(spectra.spectrum(s, SIZE, HOP), SIZE, WIDTH)
    h = masked.select("track_id", "frame", "k", (F.col("re") * F.col("harmonic")).alias("re"), (F.col("im") * F.col("harmonic")).alias("im"))
    y = spectra.resynthesis(h, s.groupBy("track_id").agg(F.count(F.lit(1)).alias("length")), SIZE, HOP).withColumnRenamed("x", "harmonic")
    return r6(y.join(s, ["track_id", "i"]).select("track_id", "i", "harmonic", (F.col("x") - F.col("harmonic")).alias("percussive")))


def _keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event is a keyframe; some turn back, some lie before the signal."""
    e = P.events(spark, d).filter("event_id % 10 = 3")
    return e.select("track_id", F.col("idx").alias("source"), (F.floor(F.col("idx") * 1.1) + F.col("k") % 7 - 4).alias("target"))


MAP = """kf AS (SELECT track_id, idx AS source, min(CAST(floor(idx * 1.1) AS BIGINT) + k % 7 - 4) AS target FROM ev WHERE event_id % 10 = 3 AND CAST(floor(idx * 1.1) AS BIGINT) + k % 7 - 4 >= 0 GROUP BY ALL),
tl AS (SELECT track_id, count(*) AS n FROM ev GROUP BY track_id),
k1 AS (SELECT * FROM kf UNION ALL SELECT track_id, 0, 0 FROM tl WHERE track_id NOT IN (SELECT track_id FROM kf WHERE source = 0)),
k2 AS (SELECT *, coalesce((target - lag(target) OVER w) / greatest(source - lag(source) OVER w, 1), 1.0) AS slope, lead(source) OVER w AS nx FROM k1 WINDOW w AS (PARTITION BY track_id ORDER BY source)),
k3 AS (SELECT track_id, source, target FROM k1 UNION ALL SELECT track_id, n, target + CAST(round_even((n - source) * slope, 0) AS BIGINT) FROM k2 JOIN tl USING (track_id) WHERE nx IS NULL AND source < n),
k4 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY source) AS i FROM k3),
tm AS (SELECT track_id, source, CAST(max(target - i) OVER (PARTITION BY track_id ORDER BY source) + i AS BIGINT) AS target FROM k4)"""


@query(f"WITH {O.EVENTS}, {MAP} SELECT track_id, source, target FROM tm")
def stretch_maps(spark, d):
    lengths = signal(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("length"))
    return spectra.valid_map(_keyframes(spark, d), lengths)


_WRAP = f"(atan2(im1, re1) - atan2(im, re) - k * pi() * {HOP} / {BINS - 1})"


@query(f"""WITH {SIGNAL}, {spectrum_sql()}, {MAP}, en AS (SELECT track_id, max(target) AS length, max(source) AS n FROM tm GROUP BY track_id),
gp AS (SELECT track_id, o, least(o * {HOP}, length)::DOUBLE AS x, n // {HOP} + 1 AS nf FROM (SELECT *, unnest(range(0, CAST(ceil((length + {HOP}) / {HOP}.0) AS BIGINT))) AS o FROM en)),
gj AS (SELECT g.track_id, o, any_value(g.x) AS x, any_value(nf) AS nf, max(m.target) FILTER (m.target <= x) AS x0, arg_max(m.source, m.target) FILTER (m.target <= x) AS y0, min(m.target) FILTER (m.target >= x) AS x1, arg_min(m.source, m.target) FILTER (m.target >= x) AS y1 FROM gp g JOIN tm m USING (track_id) GROUP BY g.track_id, o),
gs AS (SELECT track_id, o, least(greatest((CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 <= x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END) / {HOP}.0::DOUBLE, 0.0), nf - 0.001::DOUBLE) AS st FROM gj),
gl AS (SELECT track_id, o, CAST(floor(st) AS BIGINT) AS frame, st - floor(st) AS a, k FROM gs, range(0, {BINS}) b(k)),
gb AS (SELECT g.track_id, g.o, g.k, g.a, coalesce(l.re, 0) AS re, coalesce(l.im, 0) AS im, coalesce(q.re, 0) AS re1, coalesce(q.im, 0) AS im1 FROM gl g LEFT JOIN sp l ON l.track_id = g.track_id AND l.frame = g.frame AND l.k = g.k LEFT JOIN sp q ON q.track_id = g.track_id AND q.frame = g.frame + 1 AND q.k = g.k),
gh AS (SELECT track_id, o, k, (1 - a) * sqrt(re * re + im * im) + a * sqrt(re1 * re1 + im1 * im1) AS m, sum(CASE WHEN o = 0 THEN atan2((1 - a) * im + a * im1, (1 - a) * re + a * re1) ELSE k * pi() * {HOP} / {BINS - 1} + {_WRAP} - 2 * pi() * round_even({_WRAP} / (2 * pi()), 0) END) OVER (PARTITION BY track_id, k ORDER BY o ROWS UNBOUNDED PRECEDING) AS ph FROM gb),
go AS (SELECT track_id, o AS frame, k, m * cos(ph) AS re, m * sin(ph) AS im FROM gh), {resynthesis_sql("go", "en", "st")}
SELECT track_id, i, round(CASE WHEN pk > 0.995 THEN x * 0.995 / pk ELSE x END, 5) + 0.0 AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY track_id) AS pk FROM st)""")
def stretched_signals(spark, d):
    """Every signal along its time map."""
    out = spectra.stretched(signal(spark, d), _keyframes(spark, d), SIZE)
    return out.select("track_id", "i", (F.round("x", 5) + 0.0).alias("x"))


# filters and rates

FILTER_RATE, BASS, HIGH = 8192.0, 220.0, 2600.0


def _recursive_sql(bass: float = BASS / (FILTER_RATE / 2), top: float = HIGH / (FILTER_RATE / 2)) -> str:
    """All four sections of both filters, sample by sample."""
    low, high = filters.butterworth("low", bass), filters.butterworth("high", top)
    sections = [*low, *high]

    def step(old: str, state) -> str:
        # names of one step begin with its own letter, so that none means the step before
        out, x = [], "s.x"
        for n, (b0, b1, b2, a1, a2) in enumerate(sections, 1):
            p, q = state(n)
            out += [f"{b0!r} * {x} + {p} AS {old}y{n}", f"{b1!r} * {x} - ({a1!r}) * {old}y{n} + {q} AS {old}p{n}", f"{b2!r} * {x} - ({a2!r}) * {old}y{n} AS {old}q{n}"]
            x = {1: f"{old}y1", 2: f"(s.x - {old}y2)", 3: f"{old}y3", 4: ""}[n]
        return ", ".join(out)

    return f"""rf AS (SELECT s.track_id, s.i, s.x, {step("a", lambda n: ("0.0::DOUBLE", "0.0::DOUBLE"))} FROM sig s WHERE s.i = 0
UNION ALL SELECT s.track_id, s.i, s.x, {step("b", lambda n: (f"f.ap{n}", f"f.aq{n}"))} FROM rf f JOIN sig s ON s.track_id = f.track_id AND s.i = f.i + 1)"""


@query(f"WITH RECURSIVE {SIGNAL}, {_recursive_sql()} SELECT track_id, i, round(x, 6) + 0.0 AS x, round(ay2, 6) + 0.0 AS low, round(x - ay2 - ay4, 6) + 0.0 AS mid, round(ay4, 6) + 0.0 AS high FROM rf")
def band_split(spark, d):
    """Every signal in three bands that add up to it."""
    return r6(filters.three_bands(signal(spark, d), FILTER_RATE, BASS, HIGH))


def resampling_sql(source: str, name: str, rate: int, to: int, half: int = 16) -> str:
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    cut = f"{min(1.0, up / down)!r}::DOUBLE"
    reach = f"{half / min(1.0, up / down)!r}::DOUBLE"
    return f"""{name}w AS (SELECT phase, tap, tap - phase / {up}.0::DOUBLE AS d FROM range(0, {up}) a(phase), range(-{math.ceil(half * max(1.0, down / up))}, {math.ceil(half * max(1.0, down / up)) + 1}) b(tap)),
{name}v AS (SELECT phase, tap, (0.42 + 0.5 * cos(pi() * d / {reach}) + 0.08 * cos(2 * pi() * d / {reach})) * CASE WHEN d = 0 THEN 1.0 ELSE sin(pi() * {cut} * d) / (pi() * {cut} * d) END AS w FROM {name}w WHERE abs(d) < {reach}),
{name}b AS (SELECT phase, tap, w / sum(w) OVER (PARTITION BY phase) AS w FROM {name}v),
{name}m AS (SELECT track_id, unnest(range(0, CAST(ceil(n * {up} / {down}.0::DOUBLE) AS BIGINT))) AS m FROM (SELECT track_id, count(*) AS n FROM {source} GROUP BY track_id)),
{name} AS (SELECT t.track_id, t.m AS i, sum(s.x * b.w) AS x FROM {name}m t JOIN {name}b b ON b.phase = (t.m * {down}) % {up} JOIN {source} s ON s.track_id = t.track_id AND s.i = (t.m * {down}) // {up} + b.tap GROUP BY ALL)"""


MODEL_RATES = (44_100, 24_000, 22_050)


@query("WITH " + SIGNAL + ", " + ", ".join(resampling_sql("sig", f"r{to}", 32_000, to) for to in MODEL_RATES) + " " + " UNION ALL ".join(f"SELECT track_id, {to} AS rate, i, round(x, 6) + 0.0 AS x FROM r{to}" for to in MODEL_RATES))
def resampled_signals(spark, d):
    """Every signal, as if taken at 32 kHz, at the rates that models ask for."""
    s = signal(spark, d)
    out = None
    for to in MODEL_RATES:
        part = filters.resampled(s, 32_000, to).select("track_id", F.lit(to).alias("rate"), "i", "x")
        out = part if out is None else out.unionByName(part)
    return r6(out)


@query(f"""WITH {O.EVENTS}, sig AS (SELECT track_id, idx AS i, (value / 250.0::DOUBLE - 1 + k / 50.0::DOUBLE - 1) / 2 AS x FROM ev), {resampling_sql("sig", "rs", 80, 120)}, nn AS (SELECT track_id, max(i) + 1 AS n FROM rs GROUP BY track_id)
SELECT track_id, i, round(x, 6) + 0.0 AS x FROM rs UNION ALL SELECT track_id, unnest(range(n, 120)) AS i, 0.0 AS x FROM nn WHERE n < 120""")
def padded_scans(spark, d):
    """Two channels to one, from 80 to 120 samples a second, at least a second long."""
    e = P.events(spark, d)
    both = e.select("track_id", F.col("idx").alias("i"), F.explode(F.array(F.col("value") / 250.0 - 1, F.col("k") / 50.0 - 1)).alias("x"))
    return r6(filters.padded(filters.resampled(filters.mono(both), 80, 120), 120))


# seams


def _seams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = signal(spark, d)
    t = s.select("track_id").distinct()
    pairs = t.select(F.col("track_id").alias("pair_id"), F.col("track_id").alias("a_track"), (F.col("track_id") + 1).alias("b_track"))
    return seam.seam_crossfade(pairs, s, SIZE, HOP, RATE)


@query()
def spectral_seams(spark, d):
    """Least cut of every neighbouring pair, and where its seam lies."""
    return r6(_seams(spark, d)[1])


@query()
def seam_mixes(spark, d):
    """Samples of every neighbouring pair faded along its seam."""
    return r6(_seams(spark, d)[0])


# one rate

STEP, AROUND = 4, 8


def _overlap_sql(rate: float, name: str) -> str:
    """The chain of places as a recursion over lists, then frames added up."""
    frame = 4 * STEP
    clip = "greatest(0, least(ls, CAST(round_even(e, 0) AS BIGINT)))"
    centred = lambda a: f"list_transform({a}, lambda v: v - list_avg({a}))"
    norm = lambda a: f"(sqrt(list_dot_product({a}, {a})) + 1e-9)"
    return f"""{name}l AS (SELECT track_id, list(x ORDER BY i) || list_transform(range({frame}), lambda z: 0.0::DOUBLE) AS xs, count(*) AS n, greatest(0, count(*) - {frame}) AS ls, greatest(1, CAST(round_even(count(*) / {rate!r}::DOUBLE, 0) AS BIGINT)) AS length FROM sig GROUP BY track_id),
{name}c AS (SELECT track_id, 0 AS o, 0::BIGINT AS pl FROM {name}l UNION ALL
 SELECT track_id, o + 1, (SELECT arg_max(t, (list_dot_product(hd, tail) / ({norm('tail')} * {norm('hd')}), -t)) FROM (SELECT t, {centred(f'xs[t + 1:t + {frame - STEP}]')} AS hd FROM (SELECT unnest(range(greatest(0, p - {AROUND}), least(ls, p + {AROUND}) + 1)) AS t)))
 FROM (SELECT *, {clip} AS p, {centred(f'xs[pl + {STEP} + 1:pl + {frame}]')} AS tail FROM (SELECT c.track_id, o, pl, xs, ls, length, pl + {STEP * rate!r}::DOUBLE AS e FROM {name}c c JOIN {name}l USING (track_id) WHERE (o + 1) * {STEP} < length))),
{name}a AS (SELECT track_id, o * {STEP} + j AS i, sum(coalesce(xs[pl + j + 1], 0) * w) / greatest(sum(w), 1e-5) AS x FROM (SELECT *, sqrt(0.5 - 0.5 * cos(2 * pi() * j / {frame - 1}) + 1e-8) AS w FROM {name}c, range(0, {frame}) b(j)) JOIN {name}l USING (track_id) GROUP BY ALL),
{name} AS (SELECT track_id, i, coalesce(x, 0.0) AS x FROM (SELECT track_id, unnest(range(0, length)) AS i FROM {name}l) LEFT JOIN {name}a USING (track_id, i))"""


@query("WITH RECURSIVE " + SIGNAL + ", " + ", ".join(_overlap_sql(x, f"o{k}") for k, x in enumerate((1.25, 0.8))) + " SELECT track_id, 1.25::DOUBLE AS rate, i, round(x, 6) + 0.0 AS x FROM o0 UNION ALL SELECT track_id, 0.8::DOUBLE AS rate, i, round(x, 6) + 0.0 AS x FROM o1")
def overlap_stretch(spark, d):
    """Every signal faster and slower, by chained frames."""
    s = signal(spark, d)
    one = lambda rate: stretch.stretch(s, rate, "overlap", frame=4 * STEP, hop=STEP, radius=AROUND).withColumn("rate", F.lit(rate))
    return r6(one(1.25).unionByName(one(0.8)).select("track_id", "rate", "i", "x"))


@query()
def hybrid_stretch(spark, d):
    """Every signal a quarter faster: its steady part by the vocoder, its struck part by chained frames."""
    return r6(stretch.stretch(signal(spark, d), 1.25, size=SIZE, width=WIDTH, frame=4 * STEP, radius=AROUND))


# launch nudges

MOST, GUARD, SHORTEST, LEAST = 9, 2, 40, 32


@query(f"""WITH {O.EVENTS}, en AS (SELECT track_id, idx, value / 500.0::DOUBLE AS a, (value + 3 * k) / 800.0::DOUBLE AS b, count(*) OVER (PARTITION BY track_id) AS n FROM ev),
ab AS (SELECT *, CAST(least({MOST}, greatest(1, n // 5)) AS INT) AS most FROM en WHERE n >= {SHORTEST}),
la AS (SELECT x.track_id, x.n, g.lag, x.a, y.b, 1.35 - 0.60 * least(x.idx, x.idx + g.lag) / greatest(x.n - abs(g.lag) - 1, 1) AS w FROM ab x, (SELECT unnest(range(-{MOST}, {MOST + 1})) AS lag) g JOIN ab y ON TRUE WHERE y.track_id = x.track_id AND y.idx = x.idx + g.lag AND abs(g.lag) <= x.most),
sc AS (SELECT track_id, lag, CASE WHEN max(n) - abs(lag) < {LEAST} THEN -1.0 ELSE sum(w * a * b) / (sqrt(sum(w * a * a) * sum(w * b * b)) + 1e-12) END AS s FROM la GROUP BY track_id, lag),
be AS (SELECT track_id, arg_max(lag, (s, -lag)) AS lag, max(s) AS s FROM sc GROUP BY track_id),
se AS (SELECT be.track_id, any_value(be.lag) AS lag, any_value(be.s) AS s, max(CASE WHEN abs(sc.lag - be.lag) <= {GUARD} THEN -1.0 ELSE sc.s END) AS second FROM be JOIN sc USING (track_id) GROUP BY be.track_id),
co AS (SELECT track_id, lag, greatest(0.0, least(1.0, 0.65 * greatest(0.0, least(1.0, s)) + 0.35 * greatest(0.0, least(1.0, (s - second) / 0.18)))) AS confidence FROM se)
SELECT t.track_id, CAST(CASE WHEN confidence >= 0.18 THEN lag ELSE 0 END AS INT) AS lag, round(coalesce(confidence, 0.0), 6) + 0.0 AS confidence FROM (SELECT DISTINCT track_id FROM ev) t LEFT JOIN co USING (track_id)""")
def micro_alignment(spark, d):
    """Launch nudge of every track and how sure it is."""
    e = P.events(spark, d).select("track_id", "idx", (F.col("value") / 500.0).alias("a"), ((F.col("value") + 3 * F.col("k")) / 800.0).alias("b"))
    return r6(timemap.micro_alignment(e, MOST, GUARD, SHORTEST, LEAST))


@query()
def struck_envelopes(spark, d):
    """Rises of the low band of every signal, as if taken at 1,024 samples a second."""
    return r6(filters.struck(signal(spark, d), 1024.0))
