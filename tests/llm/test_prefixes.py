from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROWS = [
    (0, 0, "user", "hello"), (0, 1, "bot", "hi"), (0, 2, "user", "more"), (0, 3, None, None), (0, 4, "", ""), (0, 5, "user", "é日本🇩🇪"),
    (1, None, "user", "null first"), (1, 7, "user", "b"), (1, 7, "user", "a"), (1, 7, "user", "a"),
    (2, 0, "user", "hello"), (2, 1, "bot", "hi"), (2, 2, "user", "more"),
    (3, 0, "user", "hello"), (3, 1, "bot", "hi"), (3, 2, "user", "less"),
    (4, 5, "user", "only one"),
    (205, 0, "user", "base is absent"), (205, 1, "bot", "x"), (206, 0, "user", "base is absent"), (207, 1, "", "z"),
    (None, 0, "user", "no conversation"), (-1, 0, "user", "hello"), (-150, 3, "user", "w"), (-100, 1, "a:b", "c"), (-100, 2, "a", "b:c"),
    (5, 0, "long", "word " * 50_000), (105, 0, "user", "same"), (106, 0, "user", "same"), (100, 0, "user", "same"),
]


def brute(rows):
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            said[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("own") for c in ("key", "depth", "n", "place", "chunk", "a.b")}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = prefixes.trie(*prefixes.rebuild(prefixes.turns(df)))
    return sorted((tuple(r) for r in out.select(*NAMES).collect()), key=repr)


def test_trie_equals_enumeration(spark):
    assert run(spark, ROWS) == brute(ROWS)


@pytest.mark.parametrize("rows", [[(300, t, "u", f"turn {t % 7}") for t in range(75)] + [(301, t, "u", f"turn {t % 7}") for t in range(40)], [(c, 0, "u", "same first turn") for c in range(60)] + [(c, 1, "u", f"{c % 3}") for c in range(60)]], ids=["deep", "wide"])
def test_doubling_reaches_every_ancestor(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_chunks_change_nothing(spark, monkeypatch):
    rows = [(7, t, "u", f"t{t}") for t in range(30)] + [(8, 3 * t, "u", f"t{t % 5}") for t in range(20)]
    want = run(spark, rows)
    monkeypatch.setattr(prefixes, "CHUNK_BITS", 2)
    assert run(spark, rows) == want == brute(rows)


def test_no_conversations(spark):
    assert run(spark, []) == [] == brute([])
