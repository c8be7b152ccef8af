"""Queries of playback: queue snapshots, gates, settings, caches, prefetch, deadlines. Registered with those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, scalar
from ..operators import matching, planning, ranking, timemap
from ..sources import projections as P
from . import catalog as C
from . import oracle as O

query, r, r6 = C.query, C.r, C.r6


@query(f"WITH {C._edges_sql(12)} SELECT queue_id, src, CAST(row_number() OVER (PARTITION BY queue_id, src ORDER BY total DESC, dst) - 1 AS INT) AS rank, dst, {r('total')} FROM edges")
def sorted_neighbours(spark, d):
    """Where each item may go next, the best first."""
    return r6(ranking.sorted_neighbours(ranking.edge_scores(P.queue(spark, d, 12))))


_SUFFIX = C._paths_sql(8).replace("queue AS (", "queue8 AS (", 1).replace("AS r FROM tracks))", "AS r FROM tracks)), queue AS (SELECT * REPLACE (pos - 2 AS pos) FROM queue8 WHERE pos >= 2)", 1)


@query(f"""WITH RECURSIVE {_SUFFIX}, fin AS (SELECT * FROM walk JOIN cnt USING (queue_id) WHERE len(path) = n), bst AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY value DESC, weakest DESC, path DESC) AS rk FROM fin)
SELECT q.queue_id, track_id, q.pos, CAST(CASE WHEN q.pos <= 2 THEN q.pos ELSE 1 + list_position(path, q.pos - 2) END AS BIGINT) AS new_pos FROM queue8 q LEFT JOIN bst ON bst.queue_id = q.queue_id AND rk = 1""")
def snapshot_ranking(spark, d):
    """The third track plays: those before it stay, those after it are ranked from it on."""
    q = ranking.rank_snapshot(P.queue(spark, d, 8), F.lit(2))
    return q.select("queue_id", "track_id", "pos", F.col("new_pos").cast("long").alias("new_pos"))


@query()
def fallback_ranking(spark, d):
    """Queues of ten whose items have no vectors: tempo and structure rank them, by the exact search."""
    return ranking.rank_queue(ranking.without_vectors(P.queue(spark, d, 10))).select("queue_id", C._text(F.col("path")).alias("path"))


@query(f"WITH {O.EVENTS}, p AS (SELECT DISTINCT track_id, value - 100 AS x FROM ev WHERE value - 100 >= 0 AND value - 100 < 250) SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY x) - 1 AS INT) AS i, {r('x')} FROM p")
def clean_positions(spark, d):
    e = P.events(spark, d).groupBy("track_id").agg(F.collect_list(F.when(F.col("k") == 13, F.lit(float("nan"))).otherwise(F.col("value") - 100)).alias("x"), F.collect_list(F.col("value") - 100).alias("y"))
    return r6(e.select("track_id", F.posexplode(timemap.clean_positions(F.concat("x", "y"), F.lit(250.0))).alias("i", "x")))


@query(f"""WITH {O.queue(12)}, {O.EVENTS}, cue AS (SELECT DISTINCT track_id FROM ev WHERE event_type = 'purchase' AND value > 450) SELECT queue_id, track_id, pos FROM queue WHERE pos >= 3 AND track_id NOT IN (SELECT track_id FROM cue)""")
def playback_gate(spark, d):
    """Tracks that keep a queue from playing on from its fourth place: they have no cue."""
    cues = P.events(spark, d).filter("event_type = 'purchase' AND value > 450")
    return timemap.missing_cues(P.queue(spark, d, 12).withColumn("selected", F.lit(3)), cues).select("queue_id", "track_id", "pos")


_MODES = ["Natural Auto", "Adaptive Human", "Long Blend", "Bass Swap", "loud"]


@query(f"""WITH s AS (SELECT event_id, {_MODES}[event_id % 5 + 1] AS mode, [' harmonix-all ', 'other', ''][event_id % 3 + 1] AS model FROM events)
SELECT event_id, CASE mode WHEN 'Adaptive Human' THEN 'Natural Auto' WHEN 'Long Blend' THEN 'Short Blend' WHEN 'loud' THEN NULL ELSE mode END AS mode, CASE WHEN trim(model) LIKE 'harmonix-%' THEN trim(model) END AS model FROM s""")
def settings_migrated(spark, d):
    """Old names of settings become new ones; what is not allowed is null."""
    e = P.table(spark, d, "events").select("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    return e.select("event_id", scalar.style_mode(pick(_MODES)).alias("mode"), scalar.model_name(pick([" harmonix-all ", "other", ""])).alias("model"))


@query("""WITH m AS (SELECT event_id, value AS score, value * 44 AS pre, CAST(props ->> '$.k' AS INT) AS k, value * 66 + 1 AS n FROM events)
SELECT event_id, round(k / 100.0, 6) + 0.0 AS score, round(n * 120 / (60.0 * 44100), 6) + 0.0 AS transition_beats, round(pre * 120 / (60.0 * 44100), 6) + 0.0 AS pre_roll_beats, round(greatest(0.0, n * 120 / (60.0 * 44100) - pre * 120 / (60.0 * 44100)), 6) + 0.0 AS release_beats, round(pre / greatest(n, 1), 6) + 0.0 AS handoff_phase FROM m""")
def plan_metrics(spark, d):
    """Metrics of a plan: a map of scores, into which derived ones are merged; the later value of a name counts."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    scores = F.create_map(F.lit("score"), v, F.lit("handoff_phase"), F.lit(-1.0))
    e = P.table(spark, d, "events").select("event_id", planning.merge_metrics(scores, F.create_map(F.lit("score"), k / 100.0), planning.timing_metrics(v * 66 + 1, v * 44, F.lit(120.0), F.lit(44100))).alias("m"))
    return r6(e.select("event_id", *[F.element_at("m", n).alias(n) for n in ("score", "transition_beats", "pre_roll_beats", "release_beats", "handoff_phase")]))


@query(f"""WITH RECURSIVE {O.EVENTS}, u AS (SELECT track_id, idx AS step, k % 9 AS key, event_type = 'error' AS taken FROM ev),
c AS (SELECT DISTINCT track_id, -1::BIGINT AS step, []::INT[] AS keys FROM u UNION ALL
 SELECT c.track_id, u.step, CASE WHEN u.taken THEN list_filter(keys, lambda x: x <> u.key) ELSE list_concat(list_filter(keys, lambda x: x <> u.key), [u.key])[-3:] END FROM c JOIN u ON u.track_id = c.track_id AND u.step = c.step + 1),
z AS (SELECT track_id, keys FROM c WHERE (track_id, step) IN (SELECT track_id, max(step) FROM u GROUP BY track_id))
SELECT track_id, CAST(i AS INT) AS place, keys[i + 1] AS key FROM z, range(0, 3) x(i) WHERE i < len(keys)""")
def planned_pairs(spark, d):
    """Planned pairs of a window of four tracks: the three youngest stay, one that is taken leaves."""
    e = P.events(spark, d).select("track_id", F.col("idx").alias("step"), (F.col("k") % 9).alias("key"), (F.col("event_type") == "error").alias("taken"))
    return timemap.bounded_fifo(e, 4)


@query(f"WITH {O.EVENTS} SELECT track_id, idx AS at, CAST(min(idx) OVER w AS BIGINT) AS job, count(*) OVER w - 1 AS waiting FROM ev WINDOW w AS (PARTITION BY track_id, event_type, k // 10)")
def shared_jobs(spark, d):
    """One preparation for all requests of a track, tempo and configuration."""
    e = P.events(spark, d).select("track_id", "event_type", F.col("idx").alias("at"), F.floor(F.col("k") / 10).alias("tempo"))
    return timemap.shared_jobs(e, ["track_id", "event_type", "tempo"]).select("track_id", "at", "job", "waiting")


@query(f"""WITH {O.queue(12)}, l AS (SELECT queue_id, pos, lead(track_id, 1) OVER w AS t1, lead(track_id, 2) OVER w AS t2, track_id AS t0 FROM queue WINDOW w AS (PARTITION BY queue_id ORDER BY pos))
SELECT queue_id, pos, t0 AS a, t1 AS b, 'render' AS tier FROM l WHERE t1 IS NOT NULL UNION ALL SELECT queue_id, pos, t1, t2, 'plan' FROM l WHERE t2 IS NOT NULL""")
def prefetch_tiers(spark, d):
    return timemap.prefetch(P.queue(spark, d, 12), 3)


@query("""WITH e AS (SELECT event_id, value / 4 AS left_s, CAST(props ->> '$.k' AS INT) % 2 = 0 AS ok FROM events) SELECT event_id, CASE WHEN left_s <= 31.5 AND NOT ok THEN 'simple' WHEN left_s <= 90 THEN 'urgent' ELSE 'wait' END AS policy FROM e""")
def deadlines(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return P.table(spark, d, "events").select("event_id", scalar.deadline_policy(F.col("value") / 4, F.lit(90.0), k % 2 == 0).alias("policy"))


@query(f"""WITH {C.SAMPLES}, p AS (SELECT *, max(abs(a)) OVER (PARTITION BY track_id, idx // 8) AS peak FROM sm) SELECT track_id, idx, round(greatest(-1.0, least(1.0, CASE WHEN peak > 0.86 THEN tanh(a * 1.08) / tanh(1.08) ELSE a END)), 6) + 0.0 AS v FROM p""")
def limited_blocks(spark, d):
    return r6(timemap.limited(C.samples(spark, d).withColumnRenamed("a", "v"), 8))


@query(f"""WITH {O.TRACKS}, s AS (SELECT track_id, CASE WHEN abs(log2(124 * 0.5 / bpm)) <= abs(log2(124 / bpm)) AND abs(log2(124 * 0.5 / bpm)) <= abs(log2(124 * 2 / bpm)) THEN 62.0 WHEN abs(log2(124 / bpm)) <= abs(log2(124 * 2 / bpm)) THEN 124.0 ELSE 248.0 END / bpm AS rate FROM tracks)
SELECT track_id, round(CASE WHEN abs(rate - 1) <= 0.08 THEN rate ELSE 1.0 END, 6) + 0.0 AS rate FROM s""")
def stretch_rates(spark, d):
    """Tempos within 8 % of 124 are matched, others played as they are."""
    return r6(P.tracks(spark, d).select("track_id", scalar.stretch_rate("bpm", F.lit(124.0), 0.08).alias("rate")))


@query(f"""WITH {O.TRACKS}, v AS (SELECT track_id, CASE WHEN track_id % 7 = 0 THEN list_transform(g, lambda x: 0.0) ELSE g END AS v FROM tracks)
SELECT track_id, CAST(i AS INT) AS i, round(CASE WHEN sqrt(list_dot_product(v, v)) > 1e-9 THEN v[i + 1] / sqrt(list_dot_product(v, v)) ELSE 0.0 END, 6) + 0.0 AS x FROM v, range(0, 64) g(i)""")
def unit_vectors(spark, d):
    v = F.when(F.col("track_id") % 7 == 0, F.transform("global", lambda _: F.lit(0.0))).otherwise(F.col("global"))
    t = P.tracks(spark, d).select("track_id", v.alias("v"))
    return r6(t.select("track_id", F.posexplode(arrays.l2_normalize(F.col("v"))).alias("i", "x")))


@query(f"""WITH {C.MIXB.format(x=32, y=24)}, xx AS (SELECT track_id, max(exit) AS e FROM ex GROUP BY track_id), nn AS (SELECT track_id, min(entry) AS s FROM et GROUP BY track_id), few AS (SELECT * FROM cands WHERE bars = 16 AND exit % 23 = 7)
SELECT pair_id, a_track, b_track, exit, entry, bars FROM few UNION ALL SELECT pair_id, a_track, b_track, e, s, CAST(greatest(1, least(a.n - e, b.n - s, 4)) AS INT) FROM pairs JOIN xx ON xx.track_id = a_track JOIN nn ON nn.track_id = b_track JOIN ct a ON a.track_id = a_track JOIN ct b ON b.track_id = b_track WHERE pair_id NOT IN (SELECT pair_id FROM few)""")
def fallback_candidates(spark, d):
    """Candidates of 16 bars that leave at bars of one residue; a pair without any gets its last exit and first entry."""
    b = C.mix_bars(spark, d)
    pairs = C.neighbour_pairs(b)
    few = matching.candidates(pairs, b, (16,)).filter("exit % 23 = 7")
    leave, enter = matching.ends(b)
    return planning.or_fallback(few, leave, enter, pairs).select("pair_id", "a_track", "b_track", "exit", "entry", "bars")


@query(f"WITH {O.BARS} SELECT track_id, bar, round(0.86 * cue + 0.14 * rms, 6) + 0.0 AS score FROM bars")
def tail_scores(spark, d):
    return r6(P.bars(spark, d).select("track_id", "bar", planning.tail_blend(F.col("cue"), F.col("rms")).alias("score")))
