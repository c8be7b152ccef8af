"""Queries of rendered hand-overs: ownership curves, mixes and their quality. Registered with those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, phase, planning, rendering
from ..sources import projections as P
from . import catalog as C
from . import oracle as O

query, r, r6 = C.query, C.r, C.r6

STYLES = ["Short Blend", "Bass Swap", "Echo Out"]


def _style(x):
    return F.element_at(F.array(*map(F.lit, STYLES)), (x % 3 + 1).cast("int"))


def _ramp(p: str, a: str, b: str) -> str:
    x = f"greatest(0.0, least(1.0, ({p} - ({a})) / greatest({b} - ({a}), 1e-6)))"
    return f"(CASE WHEN {b} <= {a} + 1e-6 THEN CASE WHEN {p} >= {a} THEN 1.0 ELSE 0.0 END ELSE pow({x}, 3) * ({x} * ({x} * 6 - 15) + 10) END)"


def _curves_sql(source: str) -> str:
    """c: `source` (pair_id, i, phase, style, handoff, beats, vocal_risk, ...) with the ownership curves."""
    around = lambda a, b: _ramp("phase", f"h - ({a}) * w", f"h + ({b}) * w")
    early, late = (" ".join(f"WHEN '{s}' THEN {v[k]}" for s, v in rendering.BASS_BEATS.items()) for k in (0, 1))
    duck = "(1 - 0.10 * vocal_risk * exp(-0.5 * pow((phase - h) / greatest(0.42 * w, 1e-4), 2)))"
    send = f"{_ramp('phase', 'greatest(0.0, h - 0.75 * w)', 'least(1.0, h + 0.25 * w)')} * (1 - {_ramp('phase', 'h + 0.85 * w', 'h + 1.45 * w')})"
    return f"""b0 AS (SELECT *, greatest(0.2, least(0.8, handoff)) AS h, 1.0 / greatest(beats, 1.0) AS w FROM {source}),
b1 AS (SELECT *, {around(f'CASE style {early} END', f'CASE style {late} END')} AS bass_b, 0.24 * sqrt({_ramp('phase', '0.0', 'least(greatest(0.5 * w, 0.04), greatest(0.0, h - 1.75 * w))')}) * (1 - {around('1.25', '0.05')}) AS drum_loop,
 {around('1.50', '0.85')} AS dp, {around('1.45 - 0.35 * vocal_risk', '1.15 - 0.35 * vocal_risk')} AS hp, CASE WHEN style = 'Echo Out' THEN {send} ELSE 0.0 END AS echo_send FROM b0),
c AS (SELECT *, 1 - bass_b AS bass_a, cos(dp * pi() / 2) AS drum_a, greatest(drum_loop, sin(dp * pi() / 2)) AS drum_b, cos(hp * pi() / 2) * {duck} AS harm_a, sin(hp * pi() / 2) * {duck} AS harm_b FROM b1)"""


@query(f"""WITH s AS (SELECT event_id AS pair_id, i, i / 16.0::DOUBLE AS phase, {STYLES}[event_id % 3 + 1] AS style, value / 500 AS handoff, 1 + CAST(props ->> '$.k' AS INT) % 9 AS beats, CAST(props ->> '$.k' AS INT) / 100.0::DOUBLE AS vocal_risk FROM events, range(0, 17) x(i)),
{_curves_sql('s')} SELECT pair_id, i, {r(*rendering.CURVES)} FROM c""")
def ownership_curves(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = P.table(spark, d, "events").select(F.col("event_id").alias("pair_id"), _style(F.col("event_id")).alias("style"), (F.col("value") / 500).alias("handoff"), (1 + k % 9).cast("double").alias("beats"), (k / 100.0).alias("vocal_risk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(16).cast("long"))).alias("i"))
    c = rendering.ownership(F.col("i") / 16.0, F.col("style"), F.col("handoff"), F.col("beats"), F.col("vocal_risk"))
    return r6(e.select("pair_id", "i", *[v.alias(n) for n, v in c.items()]))


def stems(spark, d):
    """Each user's events as one hand-over: six stems of as many samples."""
    v, k = F.col("value") / 500, F.col("k")
    wave = lambda a, b: (F.pmod(k * a + F.col("idx") * b, F.lit(41)) / 40.0 - 0.5)
    return P.events(spark, d).select(F.col("track_id").alias("pair_id"), F.col("idx").alias("i"), (v - 0.5).alias("a_low"), *[wave(a, b).alias(n) for n, a, b in (("a_harm", 3, 7), ("a_perc", 5, 11), ("b_low", 7, 3), ("b_harm", 11, 5), ("b_perc", 2, 13))])


def plans(spark, d):
    t, x = P.events(spark, d).select(F.col("track_id").alias("pair_id")).distinct(), F.col("pair_id")
    return t.select("pair_id", _style(x).alias("style"), (0.3 + x % 5 * 0.1).alias("handoff"), (2.0 + x % 4).alias("beats"), (x % 11 / 10.0).alias("vocal_risk"), (0.7 + x % 7 * 0.1).alias("gain"), (x % 3 * 0.4).alias("strength"), (8 + x % 9).alias("beat"))


MIX = f"""{O.EVENTS}, nn AS (SELECT track_id, count(*) AS n FROM ev GROUP BY track_id),
st AS (SELECT track_id AS pair_id, idx AS i, value / 500 - 0.5 AS a_low, {', '.join(f"(k * {a} + idx * {b}) % 41 / 40.0::DOUBLE - 0.5 AS {n}" for n, a, b in (("a_harm", 3, 7), ("a_perc", 5, 11), ("b_low", 7, 3), ("b_harm", 11, 5), ("b_perc0", 2, 13)))}, n,
 {STYLES}[track_id % 3 + 1] AS style, 0.3 + track_id % 5 * 0.1::DOUBLE AS handoff, 2.0 + track_id % 4 AS beats, track_id % 11 / 10.0::DOUBLE AS vocal_risk, 0.7 + track_id % 7 * 0.1::DOUBLE AS gain, track_id % 3 * 0.4::DOUBLE AS strength, 8 + track_id % 9 AS beat, idx / greatest(n - 1, 1)::DOUBLE AS phase FROM ev JOIN nn USING (track_id)),
ho AS (SELECT *, greatest(0, least(CAST(round_even(greatest(0.2, least(0.8, handoff)) * n, 0) AS BIGINT), n - 1)) AS at_ FROM st),
lw AS (SELECT *, least(2 * beat, n - at_) AS wanted, least(n - at_, greatest(1, least(2 * beat, n - at_) // beat) * beat) AS whole FROM ho),
ls AS (SELECT *, CASE WHEN wanted >= greatest(32, round_even(0.8 * beat, 0)) AND whole >= 8 AND i < at_ THEN at_ + (((i - at_) % whole) + whole) % whole ELSE i END AS src FROM lw),
dr AS (SELECT a.*, b.b_perc0 AS b_perc FROM ls a JOIN st b ON a.pair_id = b.pair_id AND b.i = a.src), {_curves_sql('dr')},
tp AS (SELECT pair_id, i, n, a_harm * echo_send AS send, unnest([{{'t': beat // 2, 'g': 0.72 * (0.18 + 0.10 * strength)}}, {{'t': beat, 'g': 0.18 + 0.10 * strength}}, {{'t': 2 * beat, 'g': 0.72 * pow(0.18 + 0.10 * strength, 2)}}]) AS tap FROM c),
ec AS (SELECT pair_id, i + tap.t AS i, sum(send * tap.g) AS echo FROM tp WHERE i + tap.t < n GROUP BY ALL),
dk AS (SELECT *, a_low * bass_a + a_harm * harm_a + a_perc * drum_a AS deck_a, (b_low * bass_b + b_harm * harm_b + b_perc * drum_b) * (gain + (1 - gain) * (phase * phase * phase * (phase * (phase * 6 - 15) + 10))) AS deck_b, 1 - (0.06 + 0.05 * strength) * exp(-0.5 * pow((phase - h) / greatest(0.55 * w, 1e-4), 2)) AS space FROM c),
mx AS (SELECT dk.*, (deck_a + deck_b) * space + coalesce(echo, 0.0) AS raw FROM dk LEFT JOIN ec USING (pair_id, i)),
bd AS (SELECT *, CASE WHEN max(abs(raw)) OVER (PARTITION BY pair_id) > 0.86 THEN tanh(raw * 1.16) / tanh(1.16) ELSE raw END AS bent FROM mx),
pk AS (SELECT *, max(abs(bent)) OVER (PARTITION BY pair_id) AS peak FROM bd), fin AS (SELECT *, CASE WHEN peak > 0.89 THEN bent * (0.89 / peak) ELSE bent END AS mixed FROM pk)"""


@query(f"WITH {MIX} SELECT pair_id, i, {r('deck_a', 'deck_b', 'mixed')} FROM fin")
def transition_mix(spark, d):
    return r6(rendering.render(stems(spark, d), plans(spark, d)).select("pair_id", "i", "deck_a", "deck_b", "mixed"))


def _frames(spark, d):
    e, k = P.events(spark, d), F.col("k")
    bands = lambda a: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: (F.pmod(F.col("idx") * a + k * j, F.lit(53)) + 1) / 60.0)
    part = lambda a, m: (F.pmod(F.col("idx") * a + k, F.lit(m)) + 1) / float(m)
    return e.select(F.col("track_id").alias("pair_id"), F.col("idx").alias("frame"), (F.col("value") / 700 + 0.05).alias("peak"), part(3, 31).alias("rms_m"), part(5, 37).alias("rms_a"), part(7, 29).alias("rms_b"), part(2, 23).alias("width_m"), part(4, 19).alias("width_a"), part(6, 17).alias("width_b"), part(11, 43).alias("onset_a"), part(13, 47).alias("onset_b"), *[bands(a).alias(f"bands_{s}") for s, a in (("m", 3), ("a", 5), ("b", 8))])


_DIFFS = ", ".join(f"abs(lead({n}, 2) OVER z - 2 * lead({n}, 1) OVER z + {n}) AS d_{n}" for n in (*rendering.CURVES, "drum_overlap"))
_ROUGH = " + ".join(f"avg(d_{n})" for n in (*rendering.CURVES, "drum_overlap"))
QUALITY = f"""{MIX}, fr AS (SELECT track_id AS pair_id, idx, value / 700 + 0.05 AS peak, {', '.join(f"((idx * {a} + k) % {m} + 1) / {m}.0::DOUBLE AS {n}" for n, a, m in (("rms_m", 3, 31), ("rms_a", 5, 37), ("rms_b", 7, 29), ("width_m", 2, 23), ("width_a", 4, 19), ("width_b", 6, 17), ("onset_a", 11, 43), ("onset_b", 13, 47)))}, {', '.join(f"list_transform([1, 2, 3, 4], lambda j: ((idx * {a} + k * j) % 53 + 1) / 60.0::DOUBLE) AS bands_{s}" for s, a in (("m", 3), ("a", 5), ("b", 8)))} FROM ev),
f1 AS (SELECT *, list_sum(bands_a) AS sa, list_sum(bands_b) AS sb FROM fr),
f2 AS (SELECT *, least(sa / quantile_cont(sa, 0.85) OVER (PARTITION BY pair_id), sb / quantile_cont(sb, 0.85) OVER (PARTITION BY pair_id)) AS active, sb / (sa + sb) AS alpha, 20 * log10(rms_m) - 20 * log10(greatest(rms_a, rms_b)) AS over_ FROM f1),
fq AS (SELECT pair_id, exp(-(avg(greatest(0.0, over_ - 1.25)) + 0.35 * avg(greatest(0.0, -4.5 - over_)) + 1.8 * greatest(0.0, 20 * log10(max(peak) + 1e-9) + 1)) / 2.2) AS loudness,
 exp(-4.6 * avg(({' + '.join(f'active * least(bands_a[{i + 1}] / sa, bands_b[{i + 1}] / sb) * {w}' for i, w in enumerate(rendering.BAND_WEIGHTS))}) / 4)) AS collision,
 exp(-avg(({' + '.join(f'abs(ln(bands_m[{i}]) - ((1 - alpha) * ln(bands_a[{i}]) + alpha * ln(bands_b[{i}])))' for i in range(1, 5))}) / 4) / 2) AS continuity,
 exp(-avg(abs(width_m - ((1 - alpha) * width_a + alpha * width_b))) / 0.34) AS stereo,
 CASE WHEN count(*) < 4 THEN 0.55 ELSE greatest(0.0, least(1.0, 0.5 + 0.5 * (avg(onset_a * onset_b) - avg(onset_a) * avg(onset_b)) / (greatest(stddev_pop(onset_a), 1e-6) * greatest(stddev_pop(onset_b), 1e-6)))) END AS beat FROM f2 GROUP BY pair_id),
c1 AS (SELECT *, least(drum_a, drum_b) AS drum_overlap FROM c), c2 AS (SELECT *, {_DIFFS} FROM c1 WINDOW z AS (PARTITION BY pair_id ORDER BY i)),
cq AS (SELECT pair_id, max(style) AS style, max(vocal_risk) AS vocal_risk, exp(-coalesce(({_ROUGH}) / 9, 0.0) / 0.0045) AS smoothness, avg(CASE WHEN drum_overlap > 0.42 THEN 1.0 ELSE 0.0 END) AS ratio, avg(least(harm_a, harm_b)) AS ho2 FROM c2 GROUP BY pair_id),
q1 AS (SELECT *, greatest(0.0, least(1.0, (0.58 + 0.42 * beat) * exp(-abs(ratio - 0.13) / 0.16))) AS drum_handover, greatest(0.0, least(1.0, 1 - vocal_risk * ho2 * 1.45)) AS vocal, 0.25 * loudness + 0.25 * collision + 0.20 * continuity + 0.15 * smoothness + 0.10 * stereo + 0.05 * beat AS eng FROM fq JOIN cq USING (pair_id)),
q2 AS (SELECT *, greatest(0.0, least(1.0, 0.72 * eng + 0.14 * (pair_id % 13 / 12.0) + 0.10 * vocal + 0.04 * drum_handover)) AS score FROM q1)"""


def _quality(spark, d):
    p = plans(spark, d)
    curves = rendering.render(stems(spark, d), p)
    return rendering.quality(_frames(spark, d), curves, p.select("pair_id", (F.col("pair_id") % 13 / 12.0).alias("context"), "vocal_risk"))


@query(f"WITH {QUALITY} SELECT pair_id, {r('loudness', 'collision', 'continuity', 'smoothness', 'stereo', 'beat', 'drum_handover', 'vocal', 'score')} FROM q2")
def transition_quality(spark, d):
    """All terms of the quality of each user's hand-over, and the score that selects a rendering."""
    return r6(_quality(spark, d))


VARIANTS = 3
"""Renderings of one pair: one in each style, named by pair_id * VARIANTS + place."""


def _variants(df, place=None):
    """df once for each style; with `place`, the style too."""
    each = df.withColumn("v", F.explode(F.array(*map(F.lit, range(VARIANTS)))))
    if place:
        each = each.withColumn("style", F.element_at(F.array(*map(F.lit, rendering.BASS_BEATS)), F.col("v") + 1))
    return each.withColumn("pair_id", F.col("pair_id") * VARIANTS + F.col("v")).drop("v")


def _best_sql() -> str:
    """The terms again, for every pair in every style."""
    q = QUALITY.replace("FROM ev JOIN nn USING (track_id)),", "FROM ev JOIN nn USING (track_id)), one_ AS (SELECT * FROM st1),", 1)
    q = q.replace("st AS (SELECT track_id AS pair_id,", "st1 AS (SELECT track_id AS pair_id,", 1)
    many = f"one_ AS (SELECT 1), st AS (SELECT s.* EXCLUDE (pair_id, style), s.pair_id * {VARIANTS} + v AS pair_id, {list(rendering.BASS_BEATS)}[v + 1] AS style FROM st1 s, range(0, {VARIANTS}) x(v)),"
    q = q.replace("one_ AS (SELECT * FROM st1),", many, 1)
    q = q.replace("fr AS (SELECT track_id AS pair_id,", "fr1 AS (SELECT track_id AS pair_id,", 1).replace(" FROM ev),\nf1 AS", f" FROM ev), fr AS (SELECT f.* EXCLUDE (pair_id), f.pair_id * {VARIANTS} + v AS pair_id FROM fr1 f, range(0, {VARIANTS}) x(v)),\nf1 AS", 1)
    return q.replace("(pair_id % 13 / 12.0)", f"(pair_id // {VARIANTS} % 13 / 12.0)", 1)


@query(f"WITH {_best_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id // {VARIANTS} ORDER BY score DESC, pair_id) AS rk FROM q2) SELECT pair_id // {VARIANTS} AS pair_id, style, {r('score')} FROM k WHERE rk = 1")
def best_rendering(spark, d):
    """Of three renderings of each pair, one in each style, the best."""
    p = _variants(plans(spark, d), place=True)
    curves = rendering.render(_variants(stems(spark, d)), p)
    context = p.select("pair_id", (F.floor(F.col("pair_id") / VARIANTS) % 13 / 12.0).alias("context"), "vocal_risk")
    s = rendering.quality(_variants(_frames(spark, d)), curves, context).join(p.select("pair_id", "style"), "pair_id")
    return r6(rendering.best_style(s.select(F.floor(F.col("pair_id") / VARIANTS).alias("pair_id"), (F.col("pair_id") % VARIANTS).alias("place"), "style", "score")))


# phase lock: a user's events are the beats of one hand-over at 4 kHz

RATE = 4000


def _beats(spark, d):
    e, k = P.events(spark, d), F.col("k")
    pa = F.col("idx") * 2000 + k % 7
    jitter = F.when(k % 10 == 0, 400).otherwise(k % 40 - 12)
    beats = e.select(F.col("track_id"), pa.alias("pa"), (pa + 30 + F.floor(F.col("idx") / 4) + k % 23 - 11).alias("pb"), (F.col("idx") % 4 == 0).alias("down"), pa.alias("peak_a"), (pa + 34 + F.floor(F.col("idx") / 4) + jitter).alias("peak_b"), (F.pmod(k * 7, F.lit(50)) / 50.0).alias("prominence"))
    decks = e.groupBy("track_id").agg((F.count(F.lit(1)) * 2000 + 500).alias("length")).select("track_id", "length", F.lit(2000.0).alias("beat"), F.lit(4).alias("per_bar"))
    return beats, decks


def _fit_sql(rounds: int = 4) -> str:
    out, last = [], "o0"
    for i in range(rounds):
        out.append(f"""m{i} AS (SELECT track_id, x, y, w, attack, rb, sum(rb * x) OVER p / sum(rb) OVER p AS mx, sum(rb * y) OVER p / sum(rb) OVER p AS my FROM {last} WINDOW p AS (PARTITION BY track_id)),
s{i} AS (SELECT *, sum(rb * (x - mx) * (x - mx)) OVER p AS sxx, sum(rb * (x - mx) * (y - my)) OVER p AS sxy FROM m{i} WINDOW p AS (PARTITION BY track_id)),
l{i} AS (SELECT *, CASE WHEN sxx > 1e-9 THEN sxy / sxx ELSE 0.0 END AS slope FROM s{i}), r{i} AS (SELECT *, my - slope * mx AS intercept, y - (my - slope * mx) - slope * x AS rs FROM l{i}),
c{i} AS (SELECT *, median(rs) OVER (PARTITION BY track_id) AS mid FROM r{i}), k{i} AS (SELECT *, 2.5 * 1.4826 * (median(abs(rs - mid)) OVER (PARTITION BY track_id) + 1e-9) + 1 AS cut FROM c{i}),
o{i + 1} AS (SELECT track_id, x, y, w, attack, slope, intercept, w * CASE WHEN abs(rs) > cut THEN cut / greatest(abs(rs), 1e-9) ELSE 1.0 END AS rb FROM k{i})""")
        last = f"o{i + 1}"
    return ",\n".join(out)


_MOST, _WIDE, _STEP = 192.0, 352.0, 56.0
LOCK = f"""{O.EVENTS}, be AS (SELECT track_id, idx * 2000 + k % 7 AS pa, idx * 2000 + k % 7 + 30 + idx // 4 + k % 23 - 11 AS pb, CASE WHEN idx % 4 = 0 THEN 1.8 ELSE 1.0 END AS hv, idx * 2000 + k % 7 + 34 + idx // 4 + CASE WHEN k % 10 = 0 THEN 400 ELSE k % 40 - 12 END AS pk, (k * 7 % 50) / 50.0::DOUBLE AS pr FROM ev),
dk AS (SELECT track_id, count(*) * 2000 + 500 AS n FROM ev GROUP BY track_id),
o0 AS (SELECT track_id, (pa + pb) / 2.0::DOUBLE AS x, greatest(-{_MOST}, least({_MOST}, pb - pa))::DOUBLE AS y, (0.38 * hv)::DOUBLE AS w, false AS attack, (0.38 * hv)::DOUBLE AS rb FROM be
 UNION ALL SELECT track_id, (pa + pb) / 2.0::DOUBLE, greatest(-{_MOST}, least({_MOST}, pk - pa))::DOUBLE, (0.75 + 1.45 * pr) * hv, true, (0.75 + 1.45 * pr) * hv FROM be WHERE pr >= 0.16),
{_fit_sql()},
l1_ AS (SELECT DISTINCT track_id, greatest(-{_MOST}, least({_MOST}, intercept)) AS a, slope AS s0, n FROM o4 JOIN dk USING (track_id)),
ln_ AS (SELECT track_id, a, n, (greatest(-{_WIDE}, least({_WIDE}, a + s0 * (n - 1))) - a) / (n - 1) AS s FROM l1_),
br AS (SELECT track_id, a, s, n, unnest(range(0, CAST(ceil(n / 8000.0) AS BIGINT) + 1)) AS bar FROM ln_), bx AS (SELECT *, least(n - 1.0::DOUBLE, bar * 8000.0::DOUBLE) AS x FROM br),
se AS (SELECT b.track_id, bar, o.y, sum(o.rb) OVER (PARTITION BY b.track_id, bar ORDER BY o.y, o.rb ROWS UNBOUNDED PRECEDING) AS c, sum(o.rb) OVER (PARTITION BY b.track_id, bar) AS t FROM bx b JOIN o4 o ON o.track_id = b.track_id AND abs(o.x - b.x) <= 0.72 * 8000 WHERE bar > 0),
lo AS (SELECT track_id, bar, min(y) AS loc FROM se WHERE c >= 0.5 * t GROUP BY ALL),
v1 AS (SELECT bx.*, CASE WHEN bar = 0 THEN a WHEN loc IS NULL THEN greatest(-{_WIDE}, least({_WIDE}, a + s * x)) ELSE greatest(-{_WIDE}, least({_WIDE}, 0.72 * loc + 0.28 * (a + s * x))) END AS v, count(*) OVER (PARTITION BY track_id) AS nb FROM bx LEFT JOIN lo USING (track_id, bar)),
v2 AS (SELECT track_id, bar, x, nb, CASE WHEN nb >= 3 THEN greatest(least(coalesce(lag(v) OVER z, 0.0), v), least(greatest(coalesce(lag(v) OVER z, 0.0), v), coalesce(lead(v) OVER z, 0.0))) ELSE v END AS m FROM v1 WINDOW z AS (PARTITION BY track_id ORDER BY bar)),
f AS (SELECT track_id, bar, x, m AS y, nb FROM v2 WHERE bar = 0 UNION ALL SELECT d.track_id, d.bar, d.x, f.y + greatest(-{_STEP}, least({_STEP}, d.m - f.y)), d.nb FROM f JOIN v2 d ON d.track_id = f.track_id AND d.bar = f.bar + 1),
kf AS (SELECT track_id, bar, x, y, nb FROM f WHERE bar = nb - 1 UNION ALL SELECT f.track_id, f.bar, f.x, kf.y + greatest(-{_STEP}, least({_STEP}, f.y - kf.y)), f.nb FROM kf JOIN f ON f.track_id = kf.track_id AND f.bar = kf.bar - 1)"""


@query(f"WITH RECURSIVE {LOCK} SELECT track_id, CAST(bar AS INT) AS bar, {r('x')}, round(y / 1764.0, 6) + 0.0 AS y FROM kf")
def phase_keyframes(spark, d):
    """Where, bar by bar, the incoming track is moved to, for the hand-over of each user."""
    beats, decks = _beats(spark, d)
    keys = phase.lock(beats, decks, RATE)[0]
    # in frames of 1764 samples: such quotients do not end, so that no rounding falls on a tie
    return r6(keys.withColumn("y", F.col("y") / 1764.0))


def _at(x: str) -> str:
    """The correction at a whole sample: between keyframes, released at the end."""
    return f"""(SELECT p.track_id, p.x, CASE WHEN p.x >= n - 1 THEN 0.0 ELSE (CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 <= x0 THEN y0 ELSE y0 + (y1 - y0) * (p.x - x0) / (x1 - x0) END) * (1 - e * e * e * (e * (e * 6 - 15) + 10)) END AS c
FROM (SELECT q.track_id, q.x, n, greatest(0.0, least(1.0, (q.x - (n - rl)) / greatest(rl - 1, 1))) AS e, arg_max(k.x, (k.x, k.bar)) FILTER (k.x <= q.x) AS x0, arg_max(k.y, (k.x, k.bar)) FILTER (k.x <= q.x) AS y0, arg_min(k.x, (k.x, k.bar)) FILTER (k.x >= q.x) AS x1, arg_min(k.y, (k.x, k.bar)) FILTER (k.x >= q.x) AS y1
 FROM (SELECT DISTINCT track_id, {x} AS x FROM o4) q JOIN rl USING (track_id) JOIN kf k USING (track_id) GROUP BY q.track_id, q.x, n, rl) p)"""


@query(f"""WITH RECURSIVE {LOCK}, rl AS (SELECT track_id, n, greatest(32, least(round_even(least(2500.0, 0.18 * n), 0), greatest(32, n - 1))) AS rl FROM dk),
e1 AS (SELECT o.*, n, rl, lo_.c + (hi_.c - lo_.c) * (o.x - floor(o.x)) AS c FROM o4 o JOIN rl USING (track_id) JOIN {_at('floor(x)')} lo_ ON lo_.track_id = o.track_id AND lo_.x = floor(o.x) JOIN {_at('floor(x) + 1')} hi_ ON hi_.track_id = o.track_id AND hi_.x = floor(o.x) + 1),
e2 AS (SELECT *, abs(y) AS bf, abs(y - c) AS af, greatest(rb, 1e-9) AS v, x <= greatest(0.0, n - rl - 500) AS early FROM e1), e3 AS (SELECT * FROM (SELECT *, bool_or(early) OVER (PARTITION BY track_id) AS any_ FROM e2) WHERE early OR NOT any_),
w1 AS (SELECT track_id, bf, af, sum(v) OVER (PARTITION BY track_id ORDER BY bf, v ROWS UNBOUNDED PRECEDING) AS cb, sum(v) OVER (PARTITION BY track_id ORDER BY af, v ROWS UNBOUNDED PRECEDING) AS ca, sum(v) OVER (PARTITION BY track_id) AS t FROM e3),
w2 AS (SELECT track_id, min(bf) FILTER (cb >= 0.5 * t) / 4 AS pre_ms, min(af) FILTER (ca >= 0.5 * t) / 4 AS post_ms FROM w1 GROUP BY track_id),
a1 AS (SELECT *, median(y) OVER (PARTITION BY track_id) AS mid FROM o0 WHERE attack), a2 AS (SELECT track_id, median(abs(y - mid)) AS sp, avg(least(1.0, w / 3)) AS pm FROM a1 GROUP BY track_id),
cf AS (SELECT w2.*, greatest(0.0, least(1.0, 0.35 + 0.40 * greatest(0.0, least(1.0, 1 - coalesce(sp, {_MOST}) / {_MOST})) + 0.25 * coalesce(pm, 0.0))) AS confidence FROM w2 LEFT JOIN a2 USING (track_id))
SELECT track_id, round(pre_ms, 4) + 0.0 AS pre_ms, round(post_ms, 4) + 0.0 AS post_ms, {r('confidence')}, round(greatest(0.0, least(1.0, 0.55 + 0.30 * confidence + 0.15 * (1 - least(post_ms / 35, 1.0)))), 5) + 0.0 AS score FROM cf""")
def phase_quality(spark, d):
    """How far the beats of each user's hand-over lie apart before and after the shift, and how sure it is."""
    beats, decks = _beats(spark, d)
    m = phase.lock(beats, decks, RATE)[1]
    fine = lambda n, k: F.round(n, k) + 0.0
    return m.select("track_id", fine("pre_ms", 4).alias("pre_ms"), fine("post_ms", 4).alias("post_ms"), fine("confidence", 6).alias("confidence"), fine("score", 5).alias("score"))


_NAMES, _COSTS = (" ".join(f"WHEN '{m}' THEN {v[k]!r}" for m, v in planning.SIMPLE.items()) for k in (0, 1))


@query(f"""{C.PLANS}, st AS (SELECT *, unnest(['structure', 'crossfade']) AS setting, ac - pre AS a_start, bc - pre AS b_start FROM pq),
md AS (SELECT *, CASE setting WHEN 'crossfade' THEN setting ELSE {C.MODE} END AS mode, greatest(1, least(pre + post, greatest(1, tota - a_start), greatest(1, totb - b_start))) AS held FROM st)
SELECT pair_id, setting, mode, CASE mode {_NAMES} END AS policy_name, CASE mode {_COSTS} END::DOUBLE AS complexity, CAST(a_start AS BIGINT) AS a_start, CAST(b_start AS BIGINT) AS b_start, CAST(held AS BIGINT) AS length, CAST(a_start + held AS BIGINT) AS a_end, CAST(b_start + held AS BIGINT) AS b_resume FROM md WHERE mode <> 'creative'""")
def simple_plans(spark, d):
    """The plain hand-overs of all pairs under two settings: what the structure does not carry, and crossfades throughout."""
    plans = C.assembled(spark, d).withColumn("setting", F.explode(F.array(F.lit("structure"), F.lit("crossfade"))))
    simple = planning.simple_plans(planning.automix(plans, F.col("setting")))
    return r6(simple.select("pair_id", "setting", "mode", "policy_name", "complexity", *[F.col(c).cast("long").alias(c) for c in ("a_start", "b_start", "length", "a_end", "b_resume")]))


def _around(before: float, after: float) -> str:
    a, b = f"greatest(0.0, least(1.0, sw - {before} * w))", f"greatest(0.0, least(1.0, sw + {after} * w))"
    x = f"greatest(0.0, least(1.0, (ph - {a}) / greatest({b} - {a}, 1e-6)))"
    return f"CASE WHEN {b} <= {a} + 1e-6 THEN CASE WHEN ph >= {a} THEN 1.0 ELSE 0.0 END ELSE {x} * {x} * (3 - 2 * {x}) END"


@query(f"""WITH {C.SAMPLES}, bd AS (SELECT track_id, CASE idx % 2 WHEN 0 THEN 'low' ELSE 'high' END AS band, a, b FROM sm UNION ALL SELECT track_id, 'mid', a, b FROM sm),
co AS (SELECT track_id, band, CASE WHEN count(*) < 64 OR sqrt(sum(a * a) * sum(b * b)) <= 1e-9 THEN 0.0 ELSE sum(a * b) / sqrt(sum(a * a) * sum(b * b)) END AS rho FROM bd GROUP BY ALL),
pt AS (SELECT track_id, i, i / 16.0::DOUBLE AS ph, 0.3 + track_id % 5 * 0.1::DOUBLE AS sw, 1.0::DOUBLE / (2 + track_id % 4) AS w, 0.7 + track_id % 7 * 0.1::DOUBLE AS g FROM (SELECT DISTINCT track_id FROM ev), range(0, 17) x(i)),
rm AS (SELECT *, {_around(*matching.CUE_RAMPS['decks'])} AS mn, {_around(*matching.CUE_RAMPS['bass'])} AS bs, g + (1 - g) * ph * ph * (3 - 2 * ph) AS lv FROM pt),
lg AS (SELECT track_id, 'low' AS band, i, 1 - bs AS o, bs * lv AS n FROM rm UNION ALL SELECT track_id, unnest(['mid', 'high']), i, cos(mn * pi() / 2), sin(mn * pi() / 2) * lv FROM rm),
s AS (SELECT lg.*, greatest(0.70, least(1.0, sqrt((o * o + n * n) / greatest(o * o + n * n + 2 * greatest(0.0, least(0.97, coalesce(rho, 0.0))) * o * n, 1e-12)))) AS sc FROM lg LEFT JOIN co USING (track_id, band))
SELECT track_id AS pair_id, band, i, round(o * sc, 6) + 0.0 AS gain_out, round(n * sc, 6) + 0.0 AS gain_in, round(-20 * log10(min(sc) OVER (PARTITION BY track_id, band)), 6) + 0.0 AS reduction FROM s""")
def simple_curves(spark, d):
    """Crossfades around the cue of each user's hand-over, each band scaled by how alike both sides are there."""
    p = plans(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(16).cast("long"))))
    c = matching.cue_curves(F.col("i") / 16.0, F.col("handoff"), F.col("beats"), F.col("gain"))
    sides = [F.struct(F.lit(band).alias("band"), c[f"{name}_out"].alias("gain_out"), c[f"{name}_in"].alias("gain_in")) for band, name in (("low", "bass"), ("mid", "fade"), ("high", "high"))]
    curves = p.select(F.col("pair_id").alias("track_id"), "i", F.inline(F.array(*sides)))
    s = C.samples(spark, d)
    bands = s.select("track_id", F.when(F.col("idx") % 2 == 0, "low").otherwise("high").alias("band"), "a", "b").unionAll(s.select("track_id", F.lit("mid").alias("band"), "a", "b"))
    return r6(planning.adapted_gains(curves, bands).withColumnRenamed("track_id", "pair_id"))
