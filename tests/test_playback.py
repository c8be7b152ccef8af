"""Orders, clusters and rankings against plain enumeration, and plans that hold at scale."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import scalar, search
from gridloom.operators import matching, planning, ranking, rendering
from gridloom.plans import catalog
from gridloom.sources import projections as P

from .conftest import SMALL


def all_orders(n: int) -> np.ndarray:
    return np.array([(0, *p) for p in permutations(range(1, n))])


def test_ten_items_are_ordered_exactly():
    rng = np.random.default_rng(4)
    m, en = rng.random((10, 10)), rng.random(10)
    f = search.scored(all_orders(10), m, en)
    best = f.order(f.value, f.weakest)[0]
    assert search.order(m, en) == tuple(f.paths[best].tolist())


def test_beams_come_near_the_best_order():
    rng = np.random.default_rng(5)
    for n in (7, 8):
        m, en = rng.random((n, n)), rng.random(n)
        f = search.scored(all_orders(n), m, en)
        assert search.objective(search.polish(search.beam(m, en, 0), m, en), m, en)[0] >= np.sort(f.value)[-3]
    m, en = rng.random((11, 11)), rng.random(11)
    assert sorted(search.order(m, en)) == list(range(11)) == sorted(search.beam(m, en, 0, 12))


def test_variations_are_all_swaps_and_moves():
    want = set()
    for i in range(1, 5):
        for j in range(1, 5):
            s = list("abcde")
            s[i], s[j] = s[j], s[i]
            t = [x for k, x in enumerate("abcde") if k != i]
            t.insert(j, "abcde"[i])
            want |= {"".join(s), "".join(t)}
    assert {"".join(r) for r in search.variations(np.array(list("abcde")))} == want


def test_fallback_ranking_equals_enumeration(spark):
    q = ranking.without_vectors(P.queue(spark, SMALL, 6))
    got = {r.queue_id: list(r.path) for r in ranking.rank_queue(q).collect()}
    edges = ranking.edge_scores(q).select("queue_id", "src", "dst", "total", "style", "acoustic").collect()
    assert {(r.style, r.acoustic) for r in edges} == {(0.5, 0.5)}
    some = sorted(got)[:5]
    for name in some:
        n = len(got[name])
        m = np.zeros((n, n))
        for r in edges:
            if r.queue_id == name:
                m[r.src, r.dst] = r.total
        f = search.scored(all_orders(n), m, np.zeros(n)) if n > 1 else None
        assert f is None or got[name] == f.paths[f.order(f.value, f.weakest)[0]].tolist()


def test_clusters_equal_plain_means(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 6)) + 3 * np.eye(6)[rng.integers(0, 3, 60)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    k, centres = max(1, min(5, round(len(v) ** 0.5))), [v[0]]
    while len(centres) < k:
        centres.append(v[int(np.argmax(1 - (v @ np.array(centres).T).max(1)))])
    labels = None
    for _ in range(20):
        new = (v @ np.array(centres).T).argmax(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                c = v[labels == j].mean(0)
                if np.linalg.norm(c) > 1e-9:
                    centres[j] = c / np.linalg.norm(c)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {r.id: r.cluster for r in ranking.style_clusters(df).collect()}
    assert [got[i] for i in range(len(v))] == (labels + 1).tolist()


def test_bars_travel_once_per_pair(spark):
    """No exchange carries a track's bars for each candidate, even where nothing is broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["handover_scores"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above, below = plan.split("MapInArrow", 1)
    assert "Join" not in above and "Join" in below and "collect_list" in below


def test_setting_names_and_deadlines(spark):
    x = spark.range(1).select(scalar.style_mode(F.lit("Long Blend")).alias("a"), scalar.style_mode(F.lit("x")).alias("b"), scalar.model_name(F.lit(" harmonix-fold0 ")).alias("c"), scalar.deadline_policy(F.lit(5.0), F.lit(90.0), F.lit(False)).alias("d")).first()
    assert tuple(x) == ("Short Blend", None, "harmonix-fold0", "simple")


def test_a_pair_without_room_gets_a_fallback(spark):
    leave, enter = matching.ends(catalog.mix_bars(spark, SMALL), 6, 5)
    assert leave.groupBy("a_track").count().agg(F.max("count")).first()[0] <= 6 and enter.filter("entry >= b_n").isEmpty()


def test_gains_of_bass_and_drums_add_up(spark):
    c = rendering.ownership(F.col("id") / 100.0, F.lit("Bass Swap"), F.lit(0.5), F.lit(4.0), F.lit(0.3))
    for r in spark.range(101).select(*[v.alias(n) for n, v in c.items()]).collect():
        assert abs(r.bass_a + r.bass_b - 1) < 1e-9 and r.drum_b >= r.drum_loop and 0 <= r.harm_a <= 1 and r.echo_send == 0.0


def test_plain_hand_overs_keep_their_cues_and_stay_within_both_tracks(spark):
    rows = [
        (1, "gapless", 100, 50, 400, 1000, 1000),
        (2, "simple", 700, 50, 400, 1000, 1000),
        (3, "crossfade", 100, 900, 400, 1000, 1000),
        (4, "tail", 1000, 50, 400, 1000, 1000),
        (5, "creative", 100, 50, 400, 1000, 1000),
    ]
    plans = spark.createDataFrame(rows, "pair_id long, mode string, a_start long, b_start long, length long, a_total long, b_total long")
    got = {r.pair_id: r for r in planning.simple_plans(plans).collect()}
    assert {k: r.length for k, r in got.items()} == {1: 400, 2: 300, 3: 100, 4: 1}
    assert all(r.a_start == rows[k - 1][2] and r.a_end == r.a_start + r.length and r.b_resume == r.b_start + r.length for k, r in got.items())
    assert {k: r.complexity for k, r in got.items()} == {1: 0.15, 2: 0.42, 3: 0.42, 4: 0.42}
    assert planning.simple_plans(plans.limit(0)).count() == 0


def test_cue_curves_meet_at_the_cue_and_end_at_one(spark):
    plans = [(sw, beats, g) for sw in (0.0, 0.3, 0.5, 1.0) for beats in (0.5, 4.0, 16.0) for g in (0.5, 1.0, 1.4)]
    df = spark.createDataFrame(plans, "switch double, beats double, gain double").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64))))
    phase = F.col("i") / 64.0
    c = matching.cue_curves(phase, F.col("switch"), F.col("beats"), F.col("gain"))
    step = lambda x: np.clip(x, 0, 1) ** 2 * (3 - 2 * np.clip(x, 0, 1))
    for r in df.select("*", phase.alias("p"), *[v.alias(n) for n, v in c.items()]).collect():
        w, over = 1 / max(r.beats, 1.0), []
        for before, after in ((1.40, 1.10), (0.55, 0.35)):
            a, b = np.clip(r.switch - before * w, 0, 1), np.clip(r.switch + after * w, 0, 1)
            over.append(float(r.p >= b) if b <= a + 1e-6 else step((r.p - a) / (b - a)))
        level = r.gain + (1 - r.gain) * step(r.p)
        fade = (np.cos(over[0] * np.pi / 2), np.sin(over[0] * np.pi / 2) * level)
        np.testing.assert_allclose([r.fade_out, r.fade_in, r.bass_out, r.bass_in, r.high_out, r.high_in], [*fade, 1 - over[1], over[1] * level, *fade], atol=1e-9)
        if r.i == 64:
            np.testing.assert_allclose([r.fade_out, r.fade_in, r.bass_out, r.bass_in], [0, 1, 0, 1], atol=1e-9)
