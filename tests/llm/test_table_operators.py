from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, minhash, mixing, neighbors, warc
from gridloom.llm.components import components, local_labels

from ..conftest import SMALL
from .common_rows import ROWS, documents, empty, keeps_values

# archive

PAGES = [
    (3, "http://a", "<p>" + "same " * 40 + "é</p>"), (1, "http://b\r\nX: y", "<p>" + "same " * 40 + "é</p>"), (2, None, "tiny"), (5, "http://c", "tiny"),
    (6, "http://d", None), (7, "http://e", ""), (8, "http://f", "y" * 300_000), (3, "http://a", "<p>" + "same " * 40 + "é</p>"), (None, "http://g", "z" * 200), (9, "u", "q" * 99), (10, "u", "q" * 99),
    (None, "http://h", "<p>" + "same " * 40 + "é</p>"), (11, "u", "r" * 100), (12, "u", "r" * 100),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("own"), "payload": F.lit("own"), "copies": F.lit(1)})


def test_archive_reads_back_what_was_written(spark):
    got = sorted((tuple(r) for r in warc.read_records(warc.reconstruct(warc.write_archive(pages(spark)))).collect()), key=repr)
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = len(b) >= 100 and b in first and i != first[b]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None, True))
    assert got == sorted(want, key=repr)


def test_archive_stores_payloads_once_and_rebuilds_exact_records(spark):
    archive = warc.write_archive(pages(spark))
    assert archive.payloads.count() == len({h for *_, h in PAGES if len((h or "").encode()) >= 100})
    html = {i: (h or "").encode() for i, _, h in PAGES if i is not None}
    records = warc.reconstruct(archive).collect()
    assert len(records) == len(PAGES)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n"
        http, _, body = rest[:n].partition(b"\r\n\r\n")
        if r.page_id is None:
            continue
        payload = html[r.page_id]
        assert body == (b"" if fields["WARC-Type"] == "revisit" else payload)
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert f"Content-Length: {len(payload)}".encode() in http


def test_damaged_payloads_stop_the_reading(spark):
    archive = warc.write_archive(pages(spark))
    archive.payloads = archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    with pytest.raises(Exception, match="payload differs from its digest"):
        warc.reconstruct(archive).collect()


def test_archive_of_nothing(spark):
    assert warc.read_records(warc.reconstruct(warc.write_archive(pages(spark, [])))).count() == 0


# mixing


def level_targets(sizes: dict, weights=(5.0, 2.0, 1.0)) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in rest)
        over = {s for s in rest if w[s] * level >= 3 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: 3.0 * sizes[s] if s in full else w[s] * level for s in names}


def check_mix(rows, out):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
    target = level_targets(dict(sizes))
    taken = defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    return target, taken


def test_mix_edge_rows(spark):
    out = mixing.mix(documents(spark), F.col("doc_id")).collect()
    check_mix(ROWS, out)
    assert mixing.mix(empty(spark), F.col("doc_id")).count() == 0
    blank = [(1, "", "en", "a", 0), (2, None, "en", None, 0)]
    assert [r["copies"] for r in mixing.mix(documents(spark, blank), F.col("doc_id")).collect()] == [0, 0]


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        s = "hot" if i % 3 == 0 else None if i % 41 == 0 else f"s{rng.integers(12):02d}"
        rows.append((i, "w " * int(rng.lognormal(3, 1) + 1), "en", s, 1))
    rows += [(10_000, "w " * 50, "en", "tiny", 1)] + [(20_000, "w " * 77, "en", "s01", 1)] * 500
    docs = documents(spark, rows, clash=False)
    out = mixing.mix(docs, F.col("doc_id")).collect()
    target, taken = check_mix(rows, out)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 30), s
    again = mixing.mix(docs.repartition(7), F.col("doc_id")).collect()
    key = lambda r: (r["key"], r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mix_rates_are_exponentially_tilted(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 2}", 1) for i in range(4000)]
    out = [r for r in mixing.mix(documents(spark, rows, clash=False), F.col("doc_id")).collect() if r["source"] == "s1"]
    rate = {r["size"]: r["rate"] for r in out if r["rate"] < 3}
    slope = {np.log(v) / k for k, v in rate.items()}
    assert max(slope) - min(slope) < 0.02 * abs(np.mean(list(slope)))


def test_take_repeats_rows(spark):
    docs = documents(spark)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    keeps_values(out)
    plan = mixing.mix(docs.select("doc_id", "text", "source"), F.col("doc_id"))
    assert out.count() <= 3 * len(ROWS) and out.filter("text is null").count() == 0
    words = out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == pytest.approx(plan.agg(F.sum(F.col("size") * F.col("copies"))).first()[0], rel=0.2)
    assert mixing.take(empty(spark)).count() == 0


# components


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 800, 500), rng.integers(0, 800, 500)
    u, v = np.append(u, np.arange(1000, 1400)), np.append(v, np.arange(1001, 1401))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, v, strict=True)], "u long, v long")
    want = local_labels(1500, u, v)
    for r in components(edges).collect():
        assert want[r["id"]] == r["component"]
    assert components(edges.limit(0)).count() == 0


# vectors


def brute_links(rows, threshold=0.95):
    ok = {}
    for k, (_, e) in enumerate(rows):
        if e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[k] = np.array(e, dtype=float) / np.linalg.norm(np.array(e, dtype=float))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and float(ok[a] @ ok[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    least = {}
    for k in range(len(rows)):
        ids = [i for i in (rows[k][0], least.get(find(k))) if i is not None]
        least[find(k)] = min(ids) if ids else None
    return sorted(((rows[k][0], links[k], least[find(k)]) for k in range(len(rows))), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"weight": F.lit(1), "cell": F.lit(2), "id": F.lit("own")})


def test_neighbors_equal_brute_force_with_edges(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 16))
    rows = [(int(i), (base[i % 40] + rng.normal(size=16) * rng.choice([0.01, 0.2, 0.35])).tolist()) for i in range(700)]
    hot = rng.normal(size=16)
    rows += [(1000 + i, (hot + rng.normal(size=16) * 0.12).tolist()) for i in range(400)]
    rows += [(2000 + i, hot.tolist()) for i in range(50)] + [(2000, hot.tolist()), (None, hot.tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [1.0, 2.001]), (3008, [1e-200] * 16), (3009, [1e200] * 16)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbors.near_duplicates(vectors(spark, rows)).collect()), key=repr)
    want = brute_links([(i, [x / max(abs(y) for y in e) for x in e] if e and None not in e and np.isfinite(e).all() and any(e) else e) for i, e in rows])
    assert got == want


@pytest.mark.parametrize("most", ["10MB", "-1"])
def test_neighbors_over_blocks_and_cells(spark, monkeypatch, most):
    monkeypatch.setattr(neighbors, "LEAST_BLOCK", 60)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows = [(int(i), (base[i % 60 if i % 3 else 0] + rng.normal(size=8) * 0.15).tolist()) for i in range(900)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbors.near_duplicates(vectors(spark, rows)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_links(rows)


def test_neighbors_of_nothing(spark):
    assert neighbors.near_duplicates(vectors(spark, [])).count() == 0


# near-duplicates


def brute_classes(texts, weights, threshold=0.8):
    sh = minhash.Shingler()
    feats = [dict(zip(*(x.tolist() for x in minhash.features(sh.shingles(sh.words(t)), weights)), strict=True)) for t in texts]
    keys = [sh.key(sh.words(t), t) for t in texts]
    u, v = [], []
    for a in range(len(texts)):
        for b in range(a):
            both = sum(w for f, w in feats[a].items() if f in feats[b])
            either = sum(feats[a].values()) + sum(feats[b].values()) - both
            if keys[a] == keys[b] or both and both >= threshold * either - 1e-9:
                u.append(a)
                v.append(b)
    return local_labels(len(texts), np.array(u, dtype=int), np.array(v, dtype=int))


def test_near_duplicates_equal_brute_force(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text").orderBy("doc_id").toPandas()
    rng = np.random.default_rng(8)
    texts, ids = docs.text.tolist(), docs.doc_id.tolist()
    for k in range(80):
        w = texts[k % 20].split(" ")
        for _ in range(max(1, len(w) // rng.integers(20, 80))):
            w[rng.integers(len(w))] = f"edit{rng.integers(10**6)}"
        texts.append(" ".join(w))
        ids.append(10_000 + k)
    df = documents(spark, list(zip(ids, texts, ["en"] * len(ids), ["s"] * len(ids), [1] * len(ids), strict=True)))
    weights = minhash.idf_weights(df.select("text"))
    want = np.array(ids)[brute_classes(texts, weights)]
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    lost = [(i, got[i], int(c)) for i, c in zip(ids, want, strict=True) if got[i] != c]
    assert not lost


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    w = [f"word{i}" for i in range(120)]
    rows = [(k, " ".join(w[:k] + [f"x{k}"] + w[k + 1 :]), "en", "s", 1) for k in range(60)]
    got = {r.class_id for r in minhash.classes(documents(spark, rows)).collect()}
    assert got == {0}


def test_near_duplicate_edge_rows(spark):
    got = [(r.doc_id, r.class_id) for r in minhash.classes(documents(spark)).collect()]
    assert len(got) == len(ROWS)
    classes = dict((d, c) for d, c in got if d is not None and d != 9)
    assert classes[6] == classes[1] == 1 and classes[2] == classes[3] == 2 and classes[7] == 7
    assert minhash.classes(empty(spark)).count() == 0


def test_deduplicate_keeps_one_of_each_class(spark):
    docs = documents(spark)
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    keeps_values(out)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "2", "4", "5", "7", "None", "9", "9"])


def test_sampling_estimates_weighted_similarity():
    sh, weights = minhash.Shingler(), np.full(minhash.DF_BUCKETS, minhash.WEIGHT)
    weights[::2] = minhash.WEIGHT // 2
    a = [f"w{i}" for i in range(400)]
    b = a[:360] + [f"v{i}" for i in range(40)]
    sample = minhash.Sampler()
    fa, fb = (minhash.features(sh.shingles(sh.words(" ".join(x))), weights) for x in (a, b))
    both = np.isin(fa[0], fb[0])
    exact = fa[1][both].sum() / (fa[1].sum() + fb[1].sum() - fa[1][both].sum())
    assert abs((sample(*fa) == sample(*fb)).mean() - exact) < 0.2


def test_words_and_shingles_equal_plain_python():
    sh = minhash.Shingler()
    text = "Ab cd,EF  éa-b \x00 7z ab"
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)
    h = sh.words(text)
    assert len(h) == len(words)
    same = lambda i, j: h[i] == h[j]
    assert same(0, len(words) - 1) and not same(0, 1)
    assert len(sh.shingles(h)) == len(words) - 4 and len(sh.shingles(h[:3])) == 1 and len(sh.shingles(h[:0])) == 0


def test_near_duplicates_beyond_hubs(spark, monkeypatch):
    """A chain: neighbours are alike, ends are not, and few members link to any hub."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "HUBS", 2)
    w = [f"word{i}" for i in range(1000)]
    rows = [(k, " ".join(w[3 * k : 3 * k + 150]), "en", "s", 1) for k in range(80)]
    got = {r.doc_id: r.class_id for r in minhash.classes(documents(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_groups_beyond_hubs_keep_their_parts_apart(spark, monkeypatch):
    """One group of rows with three unlike parts: each part is one class, whatever the hubs see of it."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "HUBS", 1)
    sketch = {p: bytes([p * 40 + 1]) * minhash.SAMPLES for p in range(3)}
    rows = [(10 * k + p, 7, 8, sketch[p]) for k in range(10) for p in range(3)]
    members = spark.createDataFrame(rows, "id long, `group` long, blocks long, sketch binary")
    edges = minhash.link_groups(members, ["sketch"], minhash.link_sketches, True, "test")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {10 * k + p: p for k in range(10) for p in range(3)}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    sh = minhash.Shingler()
    text = " ".join(f"w{i}é" for i in range(500)) + " " + "x" * 300 + " end"
    whole = sh.words(text)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    assert sh.words(text).tolist() == whole.tolist() and sh.words("a" * 200 + " b").tolist() == sh.words("a" * 200).tolist() + sh.words("b").tolist()


def test_idf_counts_contents_and_not_copies(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(200)]
    rows = [[*(word() for _ in range(100)), *passage, *(word() for _ in range(100))] for _ in range(400)]
    for _ in range(400):
        near = list(base)
        near[rng.integers(200)] = word()
        rows.append(near)
    rows += [[word() for _ in range(200)] for _ in range(800)]
    df = documents(spark, [(i, " ".join(x), "en", "s", 1) for i, x in enumerate(rows)])
    weights, sh = minhash.idf_weights(df.select("text")), minhash.Shingler()
    of = lambda words: np.median(weights[minhash.bucket(sh.shingles(sh.words(" ".join(words))))])
    assert of(passage) < 0.45 * minhash.WEIGHT and of(base) > 0.9 * minhash.WEIGHT and of(rows[-1]) == minhash.WEIGHT
    assert len({r.class_id for r in minhash.classes(df).filter("doc_id >= 400 and doc_id < 800").collect()}) == 1
    assert len({r.class_id for r in minhash.classes(df).filter("doc_id < 400").collect()}) == 400


def test_sources_are_numbered_over_ranges(spark):
    names = [f"s{i * 7919 % 500:03d}é" for i in range(500)] + [None, "", "Z"]
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = {r.source: r.ordinal for r in mixing.numbered(df, F.col("source").cast("binary").asc_nulls_last()).collect()}
    order = sorted((n for n in names if n is not None), key=str.encode) + [None]
    assert got == {n: i for i, n in enumerate(order)}


def test_clustered_vectors_meet_few_blocks(spark, monkeypatch):
    """Cells part clusters, so that the block pairs left grow with the clusters and not with their square; links stay exact."""
    monkeypatch.setattr(neighbors, "LEAST_BLOCK", 40)
    monkeypatch.setattr(neighbors, "BLOCKS", 1000)
    rng = np.random.default_rng(6)
    counts = {}
    for k in (16, 64):
        base = rng.normal(size=(k, 12))
        rows = [(int(i), (base[i % k] * 3 + rng.normal(size=12) * 0.2).tolist()) for i in range(60 * k)]
        df = vectors(spark, rows).select(F.col("vec_id").alias("id"), "embedding", F.lit(1).cast("long").alias("weight"))
        tau = float(neighbors.distance(0.95))
        celled, cells, pairs = neighbors.part_cells(df, 40, tau)
        assert celled.select("id").distinct().count() == len(rows) == cells.agg(F.sum("n")).first()[0]
        counts[k] = pairs.count() / cells.count()
        if k == 16:
            got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbors.near_duplicates(vectors(spark, rows)).collect()), key=repr)
            assert got == brute_links(rows)
    assert counts[64] < 2 * counts[16] + 4, counts


def test_cover_levels_are_nested_and_cover():
    rng = np.random.default_rng(9)
    u = neighbors.unit(np.concatenate([rng.normal(size=(700, 6)), rng.normal(size=(1, 6)) + 0.05 * rng.normal(size=(300, 6))]))
    radii = [0.64, 0.32, 0.16, 0.08]
    paths = neighbors.cover_levels(u, radii)
    for level, r in enumerate(radii):
        assert (neighbors.distance((u * u[paths[:, level]]).sum(1)) <= r + 1e-3).all()
        centres = np.unique(paths[:, level])
        assert (paths[centres, level] == centres).all() and (level == 0 or np.isin(paths[:, level - 1], centres).all())
