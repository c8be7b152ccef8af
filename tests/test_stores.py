"""Sinks leave all or nothing; table functions check their arguments."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.sources import sinks, wav


def clips(spark, n=3, fail=None):
    rows = [(f"c{c}", 8000, 2, k, [0.1 * c, -0.1 * c] * 4) for c in range(n) for k in range(2)]
    df = spark.createDataFrame(rows, "clip string, rate int, channels int, chunk int, samples array<double>")
    stop = F.raise_error(F.lit("lost")).cast("int")
    return df.withColumn("rate", F.when((F.col("clip") == fail) & (F.col("chunk") == 1), stop).otherwise(F.col("rate"))) if fail else df


def names(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_clips_come_back(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.write_clips(clips(spark), path)
    assert names(path) == ["_SUCCESS", "c0.wav", "c1.wav", "c2.wav"]
    rate, x = wav.decode(open(f"{path}/c2.wav", "rb").read())
    assert rate == 8000 and x.shape == (8, 2) and np.allclose(x[:, 0], 0.2, atol=1e-4)
    sinks.write_clips(clips(spark, 1), path, overwrite=True)
    assert names(path) == ["_SUCCESS", "c0.wav"]
    sinks.write_clips(clips(spark, 2), path)
    assert names(path) == ["_SUCCESS", "c0.wav", "c1.wav"]


def test_a_lost_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match="lost"):
        sinks.write_clips(clips(spark, 8, fail="c3"), path)
    assert names(path) == []
    sinks.write_clips(clips(spark, 2), path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_clips(clips(spark, 8, fail="c5"), path, overwrite=True)
    assert names(path) == ["_SUCCESS", "c0.wav", "c1.wav"]


def test_only_committed_attempts_are_moved(tmp_path):
    w = sinks.StagedWriter(str(tmp_path), False, lambda rows: iter([(f"{r}.bin", b"x" * r) for r in rows]))
    lost, first, again = w.write(iter([3])), w.write(iter([1, 2])), w.write(iter([3]))
    assert lost.files != again.files
    w.commit([first, again])
    assert names(tmp_path) == ["1.bin", "2.bin", "3.bin", "_SUCCESS"]
    twice = sinks.StagedWriter(str(tmp_path), False, lambda rows: iter([("1.bin", b"")]))
    with pytest.raises(ValueError, match="two tasks"):
        twice.commit([twice.write(iter([])), twice.write(iter([]))])
    assert names(tmp_path) == ["1.bin", "2.bin", "3.bin", "_SUCCESS"] and os.path.getsize(f"{tmp_path}/1.bin") == 1


def test_damaged_entries_are_misses(spark, tmp_path):
    path = f"{tmp_path}/entries"
    df = spark.createDataFrame([("a", '{"v": 1}'), ("b", '{"v": 2}'), ("b", '{"v": 3}')], "key string, entry string")
    sinks.write_entries(df, path)
    with open(f"{path}/a.json", "w") as f:
        f.write('{"v": ')
    assert [(r.key, r.entry.v) for r in sinks.read_entries(spark, path, "v int").collect()] == [("b", 3)]


def test_table_function_takes_types_from_its_table(spark):
    tables.register(spark)
    spark.createDataFrame([("x", 2.5, True), ("x", 1.5, True), ("x", 3.5, None), ("y", 1.0, False)], "who string, at double, on boolean").createOrReplaceTempView("gridloom_states")
    out = spark.sql("SELECT * FROM runs(TABLE(gridloom_states), key => 'who', place => 'at', value => 'on')")
    assert [t for _, t in out.dtypes] == ["string", "boolean", "double", "double", "bigint"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("x", True, 1.5, 2.5, 2), ("x", None, 3.5, 3.5, 1), ("y", False, 1.0, 1.0, 1)], key=repr)
    with pytest.raises(Exception, match="no column nothing"):
        spark.sql("SELECT * FROM runs(TABLE(gridloom_states), key => 'who', place => 'at', value => 'nothing')").collect()
