"""Tracks are assembled once per content; models see every window in batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import providers
from gridloom.sources import assembly

SETUP = assembly.Config(rate=2048.0, size=32, hop=8, mels=8, bar=16)


def signal(spark, n=4):
    return spark.range(n * 60).select((F.col("id") % n).alias("track_id"), F.floor(F.col("id") / n).alias("i"), (F.pmod(F.col("id") * 37, F.lit(101)) / 101.0).alias("x"))


def test_only_what_changed_is_computed(spark, tmp_path):
    store, calls = f"{tmp_path}/store", []

    def compute(s, config):
        calls.append(sorted(r.track_id for r in s.select("track_id").distinct().collect()))
        return s.groupBy("track_id").agg(F.sum("x").alias("total"))

    s = signal(spark)
    run = lambda x, c=SETUP: {r.track_id: round(r.total, 6) for r in assembly.assemble(x, store, c, compute)[0].collect()}
    first = run(s)
    assert calls == [[0, 1, 2, 3]] and len(first) == 4
    assert run(s.repartition(7)) == first and len(calls) == 1
    changed = s.withColumn("x", F.when((F.col("track_id") == 2) & (F.col("i") == 5), 9.0).otherwise(F.col("x")))
    second = run(changed)
    assert calls[1:] == [[2]] and second[2] != first[2] and {k: v for k, v in second.items() if k != 2} == {k: v for k, v in first.items() if k != 2}
    assert run(s) == first and len(calls) == 2
    assert run(s.filter("track_id < 2")) == {0: first[0], 1: first[1]} and len(calls) == 2
    other = assembly.Config(rate=4096.0, size=32, hop=8, mels=8, bar=16)
    run(s.filter("track_id = 0"), other)
    assert calls[2:] == [[0]]


def test_assembled_row_and_empty_input(spark, tmp_path):
    rows, todo = assembly.assemble(signal(spark, 2), f"{tmp_path}/a", SETUP)
    got = rows.collect()
    assert todo.count() == 2 and len(got) == 2
    for r in got:
        assert r.samples == 60 and r.bars == 4 and abs(r.low_share + r.mid_share + r.high_share - 1) < 1e-9 and 0 <= r.loudest < 4
    rows, todo = assembly.assemble(signal(spark, 2).limit(0), f"{tmp_path}/b", SETUP)
    assert rows.count() == todo.count() == 0


def make():
    sizes = []

    def predict(x):
        sizes.append(len(x))
        assert x.shape[1] == 4 and len(x) <= 6
        return np.stack([x.sum(1), np.full(len(x), float(len(x)))], 1)

    return predict


def test_model_sees_every_window_in_batches_of_six(spark):
    w = spark.range(0, 20, 1, 1).select(F.lit(0).alias("track_id"), F.col("id").alias("frame"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (F.col("id") + j).cast("double")).alias("x"))
    got = {r.frame: (r.beat, r.down) for r in providers.activations(w, make, 4).collect()}
    assert {f: b for f, (b, _) in got.items()} == {f: 4.0 * f + 6 for f in range(20)}
    assert [got[f][1] for f in (0, 11, 17, 18, 19)] == [6.0, 6.0, 6.0, 2.0, 2.0]


def test_beats_are_first_of_the_largest(spark):
    s = [0.1, 0.9, 0.9, 0.2, 0.4, 0.6, 0.45, 0.1, 0.5]
    df = spark.createDataFrame([(0, i, v, 1.0 - v) for i, v in enumerate(s)], "track_id long, frame long, beat double, down double")
    assert sorted((round(r.t, 6), r.score, r.down) for r in providers.beats(df, 0.5).collect()) == [(0.5, 0.9, False), (2.5, 0.6, False), (4.0, 0.5, True)]
