"""Queries on sinks, table functions, providers and assembled tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..functions.scratch import folder
from ..operators import grid, providers
from ..sources import assembly, sinks, wav
from ..sources import projections as P
from . import oracle as O
from .catalog import STEADY, query, r, r6
from .signals import FEATURES, HOP, MELS, RATE, SIGNAL, SIZE, _recursive_sql, signal, spectrum_sql


@query(f"WITH {SIGNAL} SELECT track_id, 8000 AS rate, i, CAST(round_even(greatest(-1.0, least(1.0, x)) * 32767, 0) AS INT) AS level FROM sig")
def pcm_files(spark, d):
    """Every signal written as a WAV file by the sink, in chunks, and read again."""
    chunk = 24
    s = signal(spark, d).groupBy("track_id", F.floor(F.col("i") / chunk).cast("int").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("samples"))
    path = folder(spark, "pcm")
    sinks.write_clips(s.select(F.col("track_id").cast("string").alias("clip"), F.lit(8000).alias("rate"), F.lit(1).alias("channels"), "chunk", "samples"), path)
    back = wav.read_files(spark, path, chunk=32)
    each = back.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("track_id"), "rate", "chunk", F.posexplode("samples").alias("at", "x"))
    # files of one channel come back as two equal ones
    return each.filter("at % 2 = 0").select("track_id", "rate", (F.col("chunk") * 32 + F.col("at") / 2).cast("long").alias("i"), F.round(F.col("x") * 32768).cast("int").alias("level"))


@query(f"WITH {O.TRACKS} SELECT sha256(concat('track::', track_id)) AS key, track_id, round(bpm, 6) + 0.0 AS bpm, mode, first_label FROM tracks")
def entry_files(spark, d):
    """Every track written as a cache entry of its own by the sink, and read again."""
    t = P.tracks(spark, d).select("track_id", "bpm", "mode", "first_label")
    path = folder(spark, "entries")
    entry = F.to_json(F.struct("track_id", "bpm", "mode", "first_label"))
    sinks.write_entries(t.select(F.sha2(F.concat(F.lit("track::"), F.col("track_id").cast("string")), 256).alias("key"), entry.alias("entry")), path)
    return r6(sinks.read_entries(spark, path, "track_id long, bpm double, mode string, first_label string").select("key", "entry.*"))


@query(f"""WITH {O.EVENTS}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY track_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM ev), g AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY idx) AS g FROM c)
SELECT track_id AS key, event_type AS value, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY track_id, g, event_type""")
def event_runs(spark, d):
    """Stretches of equal events of every track, by a table function called from SQL."""
    tables.register(spark)
    P.events(spark, d).select("track_id", "idx", "event_type").createOrReplaceTempView("gridloom_events")
    return spark.sql("SELECT * FROM runs(TABLE(gridloom_events), key => 'track_id', place => 'idx', value => 'event_type')")


@query(f"""WITH {O.EVENTS}, k AS (SELECT track_id, value * 0.99731::DOUBLE AS value, row_number() OVER (PARTITION BY track_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM ev)
SELECT track_id, round(avg(value), 6) + 0.0 AS middle FROM k WHERE r >= n // 10 AND r < n - n // 10 GROUP BY track_id""")
def trimmed_means(spark, d):
    """Mean of the middle values of every track, by an aggregate over Arrow arrays called from SQL."""
    tables.register(spark)
    P.events(spark, d).select("track_id", (F.col("value") * 0.99731).alias("value")).createOrReplaceTempView("gridloom_values")
    return r6(spark.sql("SELECT track_id, trimmed_mean(value) AS middle FROM gridloom_values GROUP BY track_id"))


# a model of beats: outputs of a stand-in whose weights are two numbers, in place of a network

SPAN, EVERY = 8, 2


def stand_in():
    """Two logistic outputs: of how far the middle of a window stands above its ends, and of its first half over its second."""
    import numpy as np

    def predict(x: np.ndarray) -> np.ndarray:
        middle = x[:, 2:6].mean(1) - (x[:, :2].mean(1) + x[:, 6:].mean(1)) / 2
        first = x[:, :4].mean(1) - x[:, 4:].mean(1)
        return 1 / (1 + np.exp(-np.stack([4 * middle, 6 * first], 1)))

    return predict


def _activations(spark, d):
    s = signal(spark, d)
    first = F.greatest(F.ceil((F.col("i") - SPAN + 1) / EVERY), F.lit(0))
    n = F.count(F.lit(1)).over(grid.by_track())
    last = F.least(F.floor(F.col("i") / EVERY), F.floor((F.col("n") - SPAN) / EVERY))
    each = s.withColumn("n", n).withColumns({"first": first, "last": last}).filter("first <= last").withColumn("frame", F.explode(F.sequence("first", "last")))
    windows = each.groupBy("track_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("x"))
    return providers.activations(windows, stand_in, SPAN)


ACTIVATIONS = f"""aw AS (SELECT a.track_id, frame, i - frame * {EVERY} AS j, x FROM (SELECT track_id, unnest(range(0, (count(*) - {SPAN}) // {EVERY} + 1)) AS frame FROM sig GROUP BY track_id) a JOIN sig ON sig.track_id = a.track_id AND i >= frame * {EVERY} AND i < frame * {EVERY} + {SPAN}),
ac AS (SELECT track_id, frame, 1 / (1 + exp(-4 * (avg(x) FILTER (j BETWEEN 2 AND 5) - (avg(x) FILTER (j < 2) + avg(x) FILTER (j > 5)) / 2))) AS beat, 1 / (1 + exp(-6 * (avg(x) FILTER (j < 4) - avg(x) FILTER (j > 3)))) AS down FROM aw GROUP BY track_id, frame)"""


@query(f"WITH {SIGNAL}, {ACTIVATIONS} SELECT track_id, frame, {r('beat', 'down')} FROM ac")
def beat_activations(spark, d):
    """Outputs of the stand-in for every window of every signal, six at a time."""
    return r6(_activations(spark, d))


PEAKS = """, bp AS (SELECT *, coalesce(max(beat) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), -1) AS bef, coalesce(max(beat) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), -1) AS aft FROM ac),
pk AS (SELECT track_id, frame * 0.17 AS t, beat AS score, down >= 0.5 AS down FROM bp WHERE beat >= 0.5 AND beat > bef AND beat >= aft)"""


@query(f"WITH {SIGNAL}, {ACTIVATIONS}{PEAKS} SELECT track_id, {r('t', 'score')}, down FROM pk")
def model_beats(spark, d):
    """Beats at the peaks of the stand-in's first output."""
    return r6(providers.beats(_activations(spark, d), 0.17))


@query(f"WITH {SIGNAL}, {ACTIVATIONS}{PEAKS}, sb AS (SELECT track_id, t FROM pk), q AS ({STEADY.split('q AS (', 1)[1]} SELECT track_id, {r('t')} FROM repaired")
def model_grid(spark, d):
    """Those beats as a repaired grid: the whole path from windows of samples to a grid."""
    return r6(grid.regularize(providers.beats(_activations(spark, d), 0.17).select("track_id", "t")).select("track_id", "t"))


# assembled tracks

BAR = 16
SETUP = assembly.Config(rate=RATE, size=SIZE, hop=HOP, mels=MELS, bar=BAR, bass_hz=55.0, high_hz=650.0)


def _assembled_sql() -> str:
    bands = _recursive_sql(55.0 / (RATE / 2), 650.0 / (RATE / 2))
    bars = f"""ba AS (SELECT track_id, unnest(range(0, (max(i) // {BAR}) + 1)) AS bar FROM sig GROUP BY track_id), bt AS (SELECT track_id, bar, bar * {BAR} / {RATE}::DOUBLE AS s, (bar + 1) * {BAR} / {RATE}::DOUBLE AS e FROM ba),
bi AS (SELECT track_id, bar, avg(rms) AS rms, avg(onset) AS onset FROM bt JOIN ff USING (track_id) WHERE t >= s AND t < e GROUP BY track_id, bar),
bu AS (SELECT *, {O.unit('onset', 0.1, 0.9, 'PARTITION BY track_id')} AS ou FROM bi), bz AS (SELECT track_id, count(*) AS bars, avg(rms) AS bar_rms, avg(ou) AS bar_onset, arg_max(bar, (rms, -bar)) AS loudest FROM bu GROUP BY track_id)"""
    summary = f"su AS (SELECT track_id, log10(avg(rms) + 1e-8) AS level, avg(onset) / 10 AS onset, avg(centroid) / {RATE / 2} AS brightness, avg(flatness) AS flatness, avg(low) AS low_ratio, quantile_cont(rms, 0.9) - quantile_cont(rms, 0.1) AS dynamics FROM ff GROUP BY track_id)"
    shares = "sh AS (SELECT track_id, count(*) AS samples, " + ", ".join(f"sum({e} * {e}) / greatest(sum(ay2 * ay2) + sum((x - ay2 - ay4) * (x - ay2 - ay4)) + sum(ay4 * ay4), 1e-12) AS {n}_share" for n, e in (("low", "ay2"), ("mid", "(x - ay2 - ay4)"), ("high", "ay4"))) + " FROM rf GROUP BY track_id)"
    whole = SIGNAL.replace("value / 250.0::DOUBLE - 1 AS x", "(value / 250.0::DOUBLE - 1) * CASE WHEN track_id % 50 = 7 THEN 0.5 ELSE 1.0 END AS x")
    numbers = r("low_share", "mid_share", "high_share", "level", "onset", "brightness", "flatness", "low_ratio", "dynamics", "bar_rms", "bar_onset")
    return f"WITH RECURSIVE {whole}, {bands}, {spectrum_sql()}, {FEATURES}, {bars}, {summary}, {shares} SELECT track_id, samples, bars, loudest, {numbers}, track_id % 50 = 7 AS computed FROM sh JOIN su USING (track_id) JOIN bz USING (track_id)"


@query(_assembled_sql())
def assembled_tracks(spark, d):
    """Every track assembled, then again after some have changed: `computed` says which ones the second run had to compute."""
    store = folder(spark, "assembled")
    s = signal(spark, d)
    assembly.assemble(s, store, SETUP)
    changed = s.withColumn("x", F.col("x") * F.when(F.col("track_id") % 50 == 7, 0.5).otherwise(1.0))
    rows, todo = assembly.assemble(changed, store, SETUP)
    flagged = rows.join(todo.select("track_id", F.lit(True).alias("computed")), "track_id", "left").withColumn("computed", F.coalesce("computed", F.lit(False)))
    return r6(flagged.drop("key"))
