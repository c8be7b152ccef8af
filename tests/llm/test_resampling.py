from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from gridloom.llm import resampling

from .common_rows import ROWS, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MORE = [(100 + i, " ".join(f"w{(i * j) % 37} The é{j % 5}" for j in range(1 + i % 23)), "en", "s", 0) for i in range(60)]
TIES = [(500, " ".join("same" for _ in range(25)), "en", "s", 0)] * 7


def features(text, low, high):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, low, high, buckets, percent, least):
    hashed = lambda fs: Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    docs = [(r[0], *features(r[1], low, high)) for r in rows]
    s = sum((hashed(f) for *_, f in docs), Counter())
    t = sum((hashed(features(x, low, high)[1]) for x in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for i, n, fs in docs:
        weight = math.floor(sum(gain[b] * c for b, c in hashed(fs).items()) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2], x[3]))
    k = percent * len(able) // 100
    return [(*x[1:], j + 1 if j < k else None) for j, x in enumerate(able)] + [(*x[1:], None) for x in out if x[0] < least]


def run(spark, rows, target, *args):
    docs = documents(spark, rows) if rows else empty(spark)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return [tuple(r) for r in resampling.resample(docs, t, args[:2], *args[2:]).collect()]


@pytest.mark.parametrize("args", [(1, 1, 10_000, 10, 20), (1, 1, 7, 60, 3), (1, 3, 1000, 50, 2), (2, 2, 100, 100, 0)])
def test_resampling_equals_plain_python(spark, monkeypatch, args):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 300)
    rows, target = ROWS + MORE + TIES, ["w1 w2 the", None, "", "plain WORDS of é1"]
    assert sorted(run(spark, rows, target, *args), key=repr) == sorted(brute(rows, target, *args), key=repr)


def test_equal_rows_take_neighbouring_ranks(spark):
    got = [r for r in run(spark, TIES * 3, ["x"], 1, 1, 10, 100, 20)]
    assert sorted(r[4] for r in got) == list(range(1, 22)) and len({r[:4] for r in got}) == 1


def test_without_documents_or_target(spark):
    assert run(spark, [], ["x"], 1, 1, 10, 50, 1) == []
    assert sorted(run(spark, MORE, [], 1, 1, 10, 50, 1), key=repr) == sorted(brute(MORE, [], 1, 1, 10, 50, 1), key=repr)


def test_a_draw_moves_towards_the_target(spark):
    rows = [(i, ("alpha beta " if i % 4 == 0 else "gamma delta ") * 20, "en", "s", 0) for i in range(400)]
    drawn = [r[0] for r in run(spark, rows, ["alpha beta alpha beta"], 1, 1, 10_000, 10, 20) if r[4] is not None]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) > 30
