"""The same views as DuckDB common table expressions, for the queries that check results."""

from __future__ import annotations

EVENTS = """
events0 AS (SELECT user_id AS track_id, event_id, epoch_us(ts) / 1e6 AS s, event_type, value, CAST(props ->> '$.k' AS INT) AS k FROM events),
ev AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s, event_id) - 1 AS idx FROM events0)"""

BEATS = (
    EVENTS
    + """,
gaps AS (SELECT track_id, idx, s, s - lag(s) OVER (PARTITION BY track_id ORDER BY idx) AS gap FROM ev),
scale AS (SELECT track_id, min(s) AS s0, quantile_cont(gap, 0.5) AS m FROM gaps GROUP BY track_id),
beats AS (SELECT track_id, idx, (s - s0) / m * 0.5 AS t FROM gaps JOIN scale USING (track_id))"""
)

_LABELS = "['start','intro','verse','chorus','break','bridge','inst','solo','outro','end']"

BARS = (
    EVENTS
    + f""",
bars AS (SELECT track_id, idx AS bar, value / 500.0::DOUBLE AS rms, k / 100.0::DOUBLE AS low_ratio,
  ((event_id * 7 + k) % 101) / 100.0::DOUBLE AS onset, ((event_id * 13 + k * 3) % 97) / 96.0::DOUBLE AS brightness,
  ((event_id * 29 + k * 5) % 89) / 88.0::DOUBLE AS vocal,
  list_transform(range(1, 13), lambda j: ((event_id * j + k * (j + 2)) % 83) / 82.0::DOUBLE) AS chroma,
  CASE event_type WHEN 'signup' THEN 'INTRO' WHEN 'view' THEN 'BUILDUP' WHEN 'purchase' THEN 'DROP' WHEN 'click' THEN 'SECTION' ELSE 'BREAKDOWN' END AS role,
  upper({_LABELS}[((idx // 8 + track_id) % 10) + 1]) AS function,
  ((event_id * 31 + k) % 97) / 96.0::DOUBLE AS cue, idx * 88200 AS start_sample, (idx + 1) * 88200 AS end_sample FROM ev)"""
)

SEGMENTS = f"""
segments AS (SELECT conv_id AS track_id, turn AS seg,
  coalesce(sum(length(text) / 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "start",
  coalesce(sum(length(text) / 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + length(text) / 10.0::DOUBLE AS "end",
  {_LABELS}[((conv_id * 3 + turn) % 10) + 1] AS label FROM conversations)"""

TRACKS = f"""
tracks AS (SELECT vec_id AS track_id, label, 70 + ((vec_id * 7919) % 12000) / 100.0::DOUBLE AS bpm, CAST((vec_id * 5) % 12 AS INT) AS key_index,
  CASE WHEN vec_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, CAST(embedding AS DOUBLE[]) AS g,
  CAST(embedding[1:32] AS DOUBLE[]) AS intro, CAST(embedding[33:64] AS DOUBLE[]) AS outro,
  [CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]), CAST(embedding[33:48] AS DOUBLE[]), CAST(embedding[49:64] AS DOUBLE[])] AS timeline,
  CAST(embedding[1:6] AS DOUBLE[]) AS acoustic, {_LABELS}[((vec_id * 3) % 10) + 1] AS first_label, {_LABELS}[((vec_id * 7 + 4) % 10) + 1] AS last_label
  FROM embeddings)"""


def queue(n: int) -> str:
    row = "row_number() OVER (PARTITION BY label ORDER BY track_id) - 1"
    return TRACKS + f""",
queue AS (SELECT *, concat(label, '/', r // {n}) AS queue_id, r % {n} AS pos FROM (SELECT *, {row} AS r FROM tracks))"""


DETECTIONS = (
    BEATS
    + """,
detections AS (SELECT track_id, t, value / max(value) OVER (PARTITION BY track_id) AS score FROM (SELECT * FROM ev WHERE event_type = 'purchase') p JOIN beats USING (track_id, idx))"""
)


def cosine(a: str, b: str) -> str:
    """Cosine mapped to [0, 1] for vectors of one size."""
    return f"greatest(0.0, least(1.0, CASE WHEN sqrt(list_dot_product({a}, {a})) > 1e-9 AND sqrt(list_dot_product({b}, {b})) > 1e-9 THEN 0.5 + 0.5 * list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END))"


def unit(x: str, low: float, high: float, over: str, flat: float = 0.0) -> str:
    """x scaled between two exact percentiles."""
    a, b = f"quantile_cont({x}, {low}) OVER ({over})", f"quantile_cont({x}, {high}) OVER ({over})"
    return f"(CASE WHEN {b} > {a} + 1e-10 THEN greatest(0.0, least(1.0, ({x} - {a}) / ({b} - {a}))) ELSE {flat}::DOUBLE END)"
