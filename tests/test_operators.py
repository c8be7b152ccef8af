"""Acceptance cases with known answers, on small in-memory inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar
from gridloom.functions.windows import numbered
from gridloom.operators import cues, grid, matching, ranking, structure, timemap


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def beats(spark, times, track=1):
    return spark.createDataFrame([(track, float(t)) for t in times], "track_id long, t double")


@pytest.mark.parametrize("source,target,want", [(64, 128, 128), (140, 70, 70), (124, 128, 124)])
def test_octave_folding(spark, source, target, want):
    assert one(spark, scalar.related_bpm(float(source), float(target))) == want


@pytest.mark.parametrize("bpm,want", [(35.0, 70.0), (69.9, 139.8), (70.0, 70.0), (190.0, 190.0), (200.0, 100.0), (400.0, 100.0), (17.6, 70.4)])
def test_bpm_folding(spark, bpm, want):
    assert one(spark, scalar.fold_bpm(bpm)) == pytest.approx(want)


def test_missing_beat_is_put_back(spark):
    times = [i * 0.5 for i in range(32) if i != 13]
    out = sorted(r.t for r in grid.regularize(beats(spark, times)).collect())
    assert len(out) == 32 and any(abs(t - 6.5) < 1e-9 for t in out)
    assert grid.estimate_bpm(beats(spark, out)).first()["bpm"] == pytest.approx(120)


def test_close_events_merge_and_few_events_stay(spark):
    times = [i * 0.5 for i in range(16)] + [2.05]
    out = sorted(r.t for r in grid.merge_close(beats(spark, times)).collect())
    assert len(out) == 16 and any(abs(t - 2.025) < 1e-9 for t in out)
    assert grid.merge_close(beats(spark, [0, 0.01, 0.5])).count() == 3
    assert grid.clean(beats(spark, [1, 1, -2, float("nan"), float("inf")])).count() == 1


def test_numbering_from_downbeats(spark):
    b = beats(spark, [i * 0.5 for i in range(16)])
    rows = grid.number_beats(b, beats(spark, [i * 2.0 for i in range(4)])).orderBy("t").collect()
    assert [r.number for r in rows] == [1, 2, 3, 4] * 4
    plain = grid.number_beats(b, beats(spark, [])).orderBy("t").collect()
    assert [r.number for r in plain] == [1, 2, 3, 4] * 4


def test_snap_and_suppression(spark):
    raw = spark.createDataFrame([(1, t, s) for t, s in ((1.1, 0.70), (5.2, 0.99), (10.1, 0.90), (18.1, 0.80))], "track_id long, t double, score double")
    out = cues.snap_and_suppress(raw, beats(spark, range(25)), 8).orderBy("t").collect()
    assert [(r.t, r.score) for r in out] == [(5.0, 0.99), (18.0, 0.80)]
    none = cues.snap_and_suppress(raw.limit(0), beats(spark, range(25)), 8).orderBy("t").collect()
    assert [(r.bar, r.score) for r in none] == [(0, 0.36), (17, 0.36)]


def test_later_cue_on_one_bar_sets_directions(spark):
    bars = spark.createDataFrame([(1, i, float(i), "SECTION", "UNKNOWN") for i in range(16)], "track_id long, bar long, t double, role string, function string")
    c = spark.createDataFrame([(1, 4.1, 0.9), (1, 4.2, 0.5), (1, 12.2, 0.7)], "track_id long, t double, score double")
    out = {r.bar: r for r in cues.directional_scores(c, bars).collect()}
    assert sorted(b for b, r in out.items() if r.cue > 0) == [4, 12]
    assert out[4].cue == 0.9 and out[4].mix_in == pytest.approx(0.5 * (1.04 - 0.48 * 4 / 15))


def matrix_edges(spark, default, overrides):
    rows = [(0, a, b, overrides.get((a, b), default)) for a in range(4) for b in range(4) if a != b]
    energy = spark.createDataFrame([(0, i, 0.0) for i in range(4)], "queue_id int, pos int, energy double")
    return spark.createDataFrame(rows, "queue_id int, src int, dst int, total double"), energy


def test_exact_order_on_a_known_graph(spark):
    e, n = matrix_edges(spark, 0.20, {(0, 2): 0.9, (2, 1): 0.9, (1, 3): 0.9, (0, 1): 0.5})
    assert ranking.exact_order(e, n, 4).first()["path"] == [0, 2, 1, 3]
    assert ranking.beam_order(e, n, 4).first()["path"] == [0, 2, 1, 3]


def test_polish_raises_value_and_weakest(spark):
    e, n = matrix_edges(spark, 0.50, {(0, 2): 0.9, (2, 1): 0.92, (1, 3): 0.9, (0, 1): 0.3, (1, 2): 0.3, (2, 3): 0.3})
    start = spark.createDataFrame([(0, [0, 1, 2, 3])], "queue_id int, path array<int>")
    assert ranking.polish(start, e, n).first()["path"] == [0, 2, 1, 3]


def track(pos, bpm, outro, intro):
    return (0, pos, float(bpm), [1.0, 0.0, 0.0], intro, outro, [[1.0, 0.0], [0.0, 1.0]], [0.0] * 6, "unknown", "unknown")


QUEUE = "queue_id int, pos int, bpm double, global array<double>, intro array<double>, outro array<double>, timeline array<array<double>>, acoustic array<double>, first_label string, last_label string"


def test_directed_order(spark):
    q = spark.createDataFrame([track(0, 120, [0.0, 1.0], [1.0, 0.0]), track(1, 121, [-1.0, 0.0], [0.0, 1.0]), track(2, 122, [1.0, 1.0], [-1.0, 0.0])], QUEUE)
    e = {(r.src, r.dst): r.total for r in ranking.edge_scores(q).collect()}
    assert e[0, 1] > e[1, 0]
    assert ranking.rank_queue(q).first()["path"] == [0, 1, 2]


def test_order_without_vectors_follows_tempo(spark):
    rows = [(0, i, float(b), [], [], [], [], [], "unknown", "unknown") for i, b in enumerate((120, 174, 122))]
    q = spark.createDataFrame(rows, QUEUE)
    assert ranking.rank_queue(q).first()["path"] == [0, 2, 1]


def test_prefix_stays_locked(spark):
    q = spark.createDataFrame([(0, i) for i in range(5)], "queue_id int, pos int")
    order = spark.createDataFrame([(0, [2, 4, 3])], "queue_id int, path array<int>")
    out = {r.pos: r.new_pos for r in ranking.lock_prefix(q, order, F.lit(2)).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 4: 3, 3: 4}


def test_energy_arc_signs(spark):
    assert one(spark, scalar.energy_arc_term(F.lit(0.3), F.lit(-0.3))) > one(spark, scalar.energy_arc_term(F.lit(0.3), F.lit(0.3)))
    assert one(spark, scalar.energy_arc_term(F.lit(0.3), F.lit(0.3))) < 0


def test_identical_signals_do_not_swell(spark):
    a, b, _ = scalar.correlated_gains(F.lit(math.cos(math.pi / 4)), F.lit(math.sin(math.pi / 4)), F.lit(1.0))
    assert one(spark, a + b) < 1.02
    ends = scalar.correlated_gains(F.lit(1.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, ends[0]) == 1.0 and one(spark, ends[1]) == 0.0


def window_row(spark, **kw):
    base = dict(bpm=120.0, rate=44100, a_cue=10 * 88200, b_cue=8 * 88200, a_total=64 * 88200, b_total=64 * 88200, earliest=0, b_first=0, force_tail=False)
    base |= kw
    kinds = "bpm double, rate long, a_cue long, b_cue long, a_total long, b_total long, earliest long, b_first long, force_tail boolean"
    return matching.cue_window(spark.createDataFrame([tuple(base.values())], kinds)).first()


def test_window_has_four_beats_before_and_two_after(spark):
    w = window_row(spark)
    beat = 22050
    assert (w.length, w.handoff, w.tail) == (6 * beat, 4 * beat, False)
    assert w.handoff / w.length == pytest.approx(4 / 6)


def test_tail_window_ends_with_the_track(spark):
    w = window_row(spark, a_cue=64 * 88200 - 10)
    assert w.tail and w.a_start + w.length == 64 * 88200 and w.handoff == w.length


def test_eased_tempo_ends(spark):
    assert one(spark, scalar.eased_bpm(128.0, 124.0, 0.0)) == pytest.approx(128)
    assert 124 < one(spark, scalar.eased_bpm(128.0, 124.0, 0.5)) < 128
    assert one(spark, scalar.eased_bpm(128.0, 124.0, 1.0)) == pytest.approx(124)


def test_alignment_similarity(spark):
    same = F.expr("array(array(1D,0D), array(0D,1D))")
    assert one(spark, arrays.dtw_similarity(same, same)) == pytest.approx(1)
    assert one(spark, arrays.dtw_similarity(F.expr("CAST(array() AS array<array<double>>)"), same, 0.5)) == 0.5
    assert one(spark, arrays.cosine_similarity(F.expr("array(1D,0D)"), F.expr("array(1D)"))) == 0
    assert one(spark, arrays.cosine_similarity(F.expr("array(1D,0D)"), F.expr("array(-1D,0D)"))) == 0
    assert list(one(spark, arrays.roll(F.expr("array(1,2,3,4)"), 1))) == [4, 1, 2, 3]


def test_normalisers_differ_on_flat_input(spark):
    df = spark.createDataFrame([(1, 0.4)] * 5, "track_id long, v double")
    r = df.select(structure.unit(F.col("v")).alias("a"), structure.unit(F.col("v"), flat=0.5).alias("b"), structure.min_max(F.col("v")).alias("c"), structure.z_score(F.col("v")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (0.0, 0.5, 0.0, 0.0)


def test_key_of_a_scale(spark):
    scale = [1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, i, 0.5, scale) for i in range(4)], "track_id long, bar long, rms double, chroma array<double>")
    r = structure.estimate_key(df).first()
    assert (r.key_index, r.mode, r.wheel) == (0, "major", "8B")
    silent = df.withColumn("chroma", F.array_repeat(F.lit(0.0), 12))
    assert structure.estimate_key(silent).first()["key_index"] == -1


def test_labels_in_gaps_and_after_the_end(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 2.0, "Intro"), (1, 1, 3.0, 5.0, "Outro")], "track_id long, seg long, start double, end double, label string")
    p = beats(spark, [0.0, 1.9, 2.5, 3.0, 9.0])
    assert [r.label for r in structure.label_at(p, s).orderBy("t").collect()] == ["intro", "intro", "unknown", "outro", "outro"]


def test_lag_of_an_impulse(spark):
    x = np.zeros(200)
    x[60:66] = 1
    rows = [(1, i, float(x[i]), float(x[i - 30])) for i in range(200)]
    out = timemap.lag_search(spark.createDataFrame(rows, "track_id long, idx long, a double, b double"), 40).first()
    assert out.lag == 30 and out.score == pytest.approx(1)


def test_interpolation_holds_both_ends(spark):
    k = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 30.0)], "track_id long, x double, y double")
    p = spark.createDataFrame([(1, -5.0), (1, 5.0), (1, 10.0), (1, 50.0)], "track_id long, x double")
    assert [r.y for r in timemap.interpolate(p, k).orderBy("x").collect()] == [10, 20, 30, 30]


def test_clusters_separate_directions(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(4)] + [(10 + i, [0.01 * i, 1.0]) for i in range(4)]
    out = {r.id: r.cluster for r in ranking.style_clusters(spark.createDataFrame(rows, "id long, v array<double>")).collect()}
    assert len({out[i] for i in range(4)} & {out[10 + i] for i in range(4)}) == 0
    empty = spark.createDataFrame([(1, [])], "id long, v array<double>")
    assert ranking.style_clusters(empty).first()["cluster"] == 0


def test_pairs_without_candidates_fall_back(spark):
    from gridloom.operators import planning

    pairs = spark.createDataFrame([(1, 10, 11), (2, 20, 21)], "pair_id long, a_track long, b_track long")
    c = spark.createDataFrame([(1, 10, 11, 3, 4, 8)], "pair_id long, a_track long, b_track long, exit long, entry long, bars int")
    exits = spark.createDataFrame([(20, 5, 7), (20, 6, 7)], "a_track long, exit long, a_n long")
    entries = spark.createDataFrame([(21, 2, 9), (21, 4, 9)], "b_track long, entry long, b_n long")
    out = {r.pair_id: (r.exit, r.entry, r.bars) for r in planning.or_fallback(c, exits, entries, pairs).collect()}
    assert out == {1: (3, 4, 8), 2: (6, 2, 1)}


def test_plain_vectors_are_neutral(spark):
    from gridloom.operators import planning

    c = spark.createDataFrame([(1, 10, 11, 0, 0, 4, 16, 16)], "pair_id long, a_track long, b_track long, exit long, entry long, bars int, a_n long, b_n long")
    none = spark.createDataFrame([(10, [], [], [])], "track_id long, global array<double>, timeline array<array<double>>, positions array<double>")
    r = planning.semantic_terms(c, none).first()
    assert (r.style, r.segment, r.trajectory) == (0.5, 0.5, 0.5)


def test_automix_rules_in_order(spark):
    rows = [(True, True, True, 1.0, 1.0, "x", True), (False, True, True, 0.0, 0.0, "x", False), (False, False, True, 1.0, 1.0, "x", False), (False, False, False, 0.1, 0.8, "Bass Handover", False), (False, False, False, 0.1, 0.8, "Safe Phrase Blend", True), (False, False, False, 0.1, 0.1, "x", False)]
    df = spark.createDataFrame(rows, "tail boolean, always boolean, cross boolean, c double, s double, i string, simple boolean").coalesce(1)
    got = [r.m for r in df.select(scalar.automix_policy("tail", "always", "cross", "c", "s", "i", "simple").alias("m")).collect()]
    assert got == ["tail", "creative", "crossfade", "creative", "simple", "gapless"]


def test_mixes_end_on_the_samples_before_the_track_resumes(spark):
    rng = np.random.default_rng(7)
    mixes, tracks, resumes = {1: rng.normal(size=2000), 2: rng.normal(size=60), 3: rng.normal(size=400), 4: rng.normal(size=400)}, {1: rng.normal(size=5000), 2: rng.normal(size=500), 3: rng.normal(size=50), 4: rng.normal(size=2)}, {1: 4000, 2: 100, 3: 900, 4: 1}
    rows = lambda x: spark.createDataFrame([(k, i, float(v)) for k, vs in x.items() for i, v in enumerate(vs)], "track_id long, idx long, v double")
    after = rows(tracks)
    out = timemap.end_seams(rows(mixes), after, spark.createDataFrame(list(resumes.items()), "track_id long, resume long"), 8000)
    got = {k: [0.0] * len(v) for k, v in mixes.items()}
    seams = {}
    for r in out.collect():
        got[r.track_id][r.idx], seams[r.track_id] = r.v, r.seam
    assert seams == {1: 192, 2: 0, 3: 49, 4: 0}
    for k, n in seams.items():
        want = mixes[k].copy()
        if n:
            at, p = min(resumes[k], len(tracks[k]) - 1), np.linspace(0, np.pi / 2, n)
            want[-n:] = want[-n:] * np.cos(p) + tracks[k][at - n : at] * np.sin(p)
        np.testing.assert_allclose(got[k], want, atol=1e-9)
    jump = {r.track_id: r.jump_after for r in timemap.seam_jumps(out, after).collect()}
    assert abs(jump[1] - abs(tracks[1][3999] - tracks[1][4000])) < 1e-9


def test_ties_are_numbered_alike_in_every_run(spark):
    rows = [(i % 3, i) for i in range(300)]
    runs = [{(r.seq, r.x): r.n for r in numbered(spark.createDataFrame(sorted(rows, key=lambda r: r[1] * k % 301), "seq long, x long").repartition(k), "seq", "n").collect()} for k in (1, 7)]
    assert runs[0] == runs[1] and sorted(runs[0].values()) == list(range(300))


def test_sql_functions(spark):
    from gridloom.functions import sql

    assert "fold_bpm" in sql.register(spark)
    r = spark.sql("SELECT smoothstep(0.5D) a, smootherstep(2D) b, related_bpm(64D, 128D) c, fold_bpm(35D) d, clock_text(75D) e, decibels(10D) f").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (0.5, 1.0, 128.0, 70.0, "01:15", 20.0)


def test_kernel_and_rows_find_the_same_order(spark):
    from gridloom.functions import search

    rng = np.random.default_rng(9)
    n = 7
    m = rng.random((n, n))
    en = rng.normal(size=n) * 0.3
    e = spark.createDataFrame([(0, a, b, float(m[a, b])) for a in range(n) for b in range(n) if a != b], "queue_id int, src int, dst int, total double")
    energy = spark.createDataFrame([(0, i, float(en[i])) for i in range(n)], "queue_id int, pos int, energy double")
    score, level = m.tolist(), en.tolist()
    assert tuple(ranking.exact_order(e, energy, n).first()["path"]) == search.exact(score, level, 0)
    assert tuple(ranking.beam_order(e, energy, n, width=12).first()["path"]) == search.beam(score, level, 0, 12)
    start = spark.createDataFrame([(0, list(range(n)))], "queue_id int, path array<int>")
    assert tuple(ranking.polish(start, e, energy).first()["path"]) == search.polish(tuple(range(n)), score, level)
    assert search.objective(search.exact(score, level, 0), score, level) >= search.objective(search.beam(score, level, 0, 12), score, level)
