"""Queries of what surrounds models: their windows, pooled outputs, placed detections. Registered with those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import providers
from ..sources import projections as P
from . import catalog as C
from . import oracle as O

query, r, r6 = C.query, C.r, C.r6

_POINTS = ", ".join(f"greatest(0.0, least({0.05 + k * ((0.95 - 0.05) / 6)!r}::DOUBLE * (n - 1) - len / 2.0::DOUBLE, (n - len)::DOUBLE))" for k in range(7))


@query(f"""WITH a AS (SELECT event_id AS track_id, greatest(CAST(props ->> '$.k' AS INT) * 9000 + event_id % 977, 24000) AS n FROM events), b AS (SELECT *, least(n, 336000) AS len FROM a),
c AS (SELECT *, CASE WHEN n <= len THEN [0::BIGINT] ELSE list_sort(list_distinct(list_transform([{_POINTS}], lambda x: CAST(floor(x) AS BIGINT)))) END AS st FROM b)
SELECT track_id, CAST(i AS INT) AS "window", st[i + 1] AS start, CAST(len AS BIGINT) AS length, round(CASE WHEN n <= len THEN 0.5 ELSE (st[i + 1] + len / 2.0::DOUBLE) / n END, 6) + 0.0 AS position FROM c, range(0, 7) x(i) WHERE i < len(st)""")
def clip_windows(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    t = P.table(spark, d, "events").select(F.col("event_id").alias("track_id"), (k * 9000 + F.col("event_id") % 977).alias("n"))
    return r6(providers.clip_windows(t, 24000))


@query(f"""WITH {O.TRACKS}, h AS (SELECT track_id // 4 AS id, track_id % 4 AS layer4, g AS v FROM tracks), m AS (SELECT id, {', '.join(f'avg(v[{i}]) AS x{i}' for i in range(1, 65))} FROM h GROUP BY id),
u AS (SELECT id, [{', '.join(f'x{i}' for i in range(1, 65))}] AS x FROM m), q AS (SELECT id // 7 AS track_id, id % 7 AS "window", list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS v FROM u),
g AS (SELECT track_id, [{', '.join(f'avg(v[{i}])' for i in range(1, 65))}] AS a, arg_min(v, "window") AS b, arg_max(v, "window") AS c FROM q GROUP BY track_id)
SELECT track_id, CAST(i AS INT) AS i, round(a[i + 1] / sqrt(list_dot_product(a, a)), 6) + 0.0 AS global, round(b[i + 1], 6) + 0.0 AS intro, round(c[i + 1], 6) + 0.0 AS outro FROM g, range(0, 64) x(i)""")
def pooled_profiles(spark, d):
    """Four vectors are the last layers of a window, seven windows a track."""
    x = F.col("track_id")
    h = P.tracks(spark, d).select(F.floor(x / 28).alias("track_id"), (F.floor(x / 4) % 7).alias("window"), (x % 4 + 8).alias("layer"), F.lit(12).alias("n_layers"), F.lit(0).alias("frame"), F.col("global").alias("v"))
    early = h.withColumn("layer", F.lit(7)).withColumn("v", F.transform("v", lambda y: y * 100))
    p = providers.profiles(providers.pooled_layers(h.unionAll(early), 64), 64)
    return r6(p.select("track_id", F.posexplode(F.arrays_zip("global", "intro", "outro")).alias("i", "z")).select("track_id", "i", "z.*"))


IMAGES = f"{O.EVENTS}, im AS (SELECT track_id, count(*) * 40 AS n FROM ev GROUP BY track_id), cw AS (SELECT track_id, n, CAST(unnest(range(0, greatest(1, CAST(floor((n + 266) / 88.75) AS BIGINT)))) AS INT) AS \"window\" FROM im), cv AS (SELECT *, CAST(floor(\"window\" * 88.75) AS BIGINT) - 266 AS \"left\" FROM cw)"


def _images(spark, d):
    return P.events(spark, d).groupBy("track_id").agg((F.count(F.lit(1)) * 40).alias("n"))


@query(f'WITH {IMAGES} SELECT track_id, "window", "left", "left" + 355 AS "right" FROM cv')
def cue_image_windows(spark, d):
    return providers.cue_windows(_images(spark, d))


@query(f"""WITH {IMAGES}, dt AS (SELECT e.track_id, "left" + k * 3 AS position, value AS score, n FROM ev e JOIN cv c ON c.track_id = e.track_id AND c."window" = e.idx % 20)
SELECT track_id, position, round(max(score), 6) + 0.0 AS score FROM dt WHERE position >= 0 AND position < n GROUP BY ALL""")
def placed_detections(spark, d):
    """Detections of overlapping windows in frames of their track, the largest score of each frame."""
    det = P.events(spark, d).select("track_id", (F.col("idx") % 20).cast("int").alias("window"), (F.col("k") * 3).alias("at"), F.col("value").alias("score"))
    return r6(providers.placed(det, _images(spark, d)))


@query(f"WITH {O.EVENTS}, l AS (SELECT track_id, idx AS frame, exp(-abs(idx - 30) / 4.0) * (1 + k / 100.0) AS rms FROM ev), t AS (SELECT track_id, max(rms) AS top FROM l GROUP BY track_id) SELECT track_id, min(frame) AS first, max(frame) AS last FROM l JOIN t USING (track_id) WHERE 20 * log10(greatest(rms, 1e-5) / greatest(top, 1e-5)) > -48 GROUP BY track_id")
def trimmed_bounds(spark, d):
    l = P.events(spark, d).select("track_id", F.col("idx").alias("frame"), (F.exp(-F.abs(F.col("idx") - 30) / 4.0) * (1 + F.col("k") / 100.0)).alias("rms"))  # noqa: E741
    return providers.trim_bounds(l)


@query(f"""WITH {O.SEGMENTS} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seg) - 1 AS INT) AS seg, round("start", 6) + 0.0 AS "start", round("end", 6) + 0.0 AS "end", lower(label) AS label, 1.0::DOUBLE AS confidence FROM segments""")
def functional_segments(spark, d):
    s = P.segments(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seg", "start", "end", F.upper("label").alias("label")))).alias("segments"))
    return r6(providers.segments(s))
