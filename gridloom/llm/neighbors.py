"""Embedding near-duplicates by dual traversal of cover trees: exact threshold pairs, none of them emitted.

Vectors of equal components collapse first. The upper levels are cells: the root holds all vectors of one length, and each
cell of more than two blocks is parted around pivots fitted on a bounded sample of its own, every vector going to the nearest,
until cells fit or their radii no longer shrink. Pairs of cells descend with them, level by level, as a join: a pair whose
centres lie further apart than both covering radii and the threshold distance drops out with all pairs below it. What is
left meets in blocks. Within a block nested levels with radii halving from twice the threshold distance form a cover tree;
a task walks the trees of two blocks: a node pair further apart than threshold plus radii is pruned, one whose farthest
members are near enough is counted whole, others descend; leaves are compared in single precision and, near the threshold,
again in double precision. A task returns, per vector, the number of its links and one link to its local component.

Cases: null, zero, empty and non-finite vectors and those with null components link with nothing; vectors of different
lengths never link; equal vectors link with one another; a null vec_id is a vector too; repeated rows are vectors
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .components import components, local_labels

THRESHOLD = 0.95
BLOCKS, LEAST_BLOCK, MOST_NUMBERS = 16, 2048, 1 << 21
"""Vectors of a block: 1/BLOCKS of all, at least LEAST_BLOCK, but at most MOST_NUMBERS components: 32,768 vectors of 64."""
FANOUT, DEPTH = 64, 9
"""Most pivots of a cell, and most levels of cells: 64**9 cells."""
SAMPLE = 1024
"""Vectors of a cell, chosen by hash, on which its pivots are fitted; every vector is indexed."""
SHRINK = 0.8
"""A cell whose radius is not below this share of its parent's has no clusters to part; its vectors are dealt by hash."""
LEVELS = 4
DENSE = 1 << 20
SLACK = 1e-5


def distance(cosine):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def farthest_first(u: np.ndarray, k: int) -> np.ndarray:
    """Indexes of up to k pivots, each the farthest from those before."""
    chosen, near = [0], u @ u[0]
    while len(chosen) < min(k, len(u)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-12:
            break
        chosen.append(i)
        near = np.maximum(near, u @ u[i])
    return np.array(chosen)


def cover_levels(u: np.ndarray, radii: list[float]) -> np.ndarray:
    """Per vector and level the index of its centre. Nested: a centre is its own centre on all lower levels."""
    n = len(u)
    out = np.empty((n, len(radii)), dtype=np.int32)
    parent = np.zeros(n, dtype=np.int32)
    f = u.astype(np.float32)
    for level, r in enumerate(radii):
        order = np.argsort(parent, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1):
            head = parent[group[0]] if level else group[0]
            left = np.append(head, group[group != head])
            while len(left):
                # the next vectors that may be centres, in order, against all that are left
                m = min(len(left), 256)
                near = f[left] @ f[left[:m]].T >= 1 - r * r / 2
                centre = np.full(len(left), -1)
                for j in range(m):
                    if centre[j] < 0:
                        centre[near[:, j] & (centre < 0)] = left[j]
                        centre[j] = left[j]
                found = centre >= 0
                out[left[found], level] = centre[found]
                left = left[~found]
        parent = out[:, level]
    return out


class Tree:
    """Nodes of one block: per level its centres, their members as slices of one order, and covering radii."""

    def __init__(self, u: np.ndarray, paths: np.ndarray):
        self.u, self.paths = u, paths
        self.f = u.astype(np.float32)

    def nodes(self, members: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Centres, members and radii of the nodes of `level` among members; leaves after the last level."""
        if level >= self.paths.shape[1]:
            return members, [members[i : i + 1] for i in range(len(members))], np.zeros(len(members))
        centre = self.paths[members, level]
        order = np.argsort(centre, kind="stable")
        sorted_members, sorted_centres = members[order], centre[order]
        starts = np.flatnonzero(np.append(True, sorted_centres[1:] != sorted_centres[:-1]))
        centres = sorted_centres[starts]
        far = distance(np.einsum("ij,ij->i", self.u[sorted_members], self.u[sorted_centres]))
        radii = np.maximum.reduceat(far, starts)
        ends = np.append(starts[1:], len(members))
        radii[(ends - starts == 1) & (sorted_members[starts] == centres)] = 0.0
        return centres, [sorted_members[a:b] for a, b in zip(starts, ends, strict=True)], radii


class Join:
    """Links between two trees (or within one, then `same`), as counts and local components."""

    def __init__(self, a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, same: bool, threshold: float):
        self.a, self.b, self.wa, self.wb, self.same, self.t = a, b, wa, wb, same, threshold
        self.tau = float(distance(threshold))
        self.na = len(a.u)
        self.links_a, self.links_b = np.zeros(len(a.u), dtype=np.int64), np.zeros(len(b.u), dtype=np.int64)
        self.labels = np.arange(self.na if same else self.na + len(b.u))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.labels = local_labels(len(self.labels), i, j if self.same else j + self.na, self.labels)

    def run(self) -> None:
        self.walk(np.arange(self.na), np.arange(len(self.b.u)), 0)

    def walk(self, ma: np.ndarray, mb: np.ndarray, level: int) -> None:
        if level >= self.a.paths.shape[1] or (level and len(ma) * len(mb) <= 4096):
            self.leaves(ma, mb)
            return
        ca, sa, ra = self.a.nodes(ma, level)
        cb, sb, rb = self.b.nodes(mb, level)
        one_a, one_b = np.array([len(s) == 1 for s in sa]), np.array([len(s) == 1 for s in sb])
        single_a, single_b = np.flatnonzero(one_a), np.flatnonzero(one_b)
        many_a, many_b = np.flatnonzero(~one_a), np.flatnonzero(~one_b)
        first = lambda s, k: np.array([s[i][0] for i in k], dtype=np.int64)
        if len(single_a) and len(single_b):
            self.leaves(first(sa, single_a), first(sb, single_b))
        for x, y in ((single_a, many_b), (many_a, single_b), (many_a, many_b)):
            if not len(x) or not len(y):
                continue
            step = max(1, DENSE // len(y))
            for k in range(0, len(x), step):
                xs = x[k : k + step]
                d = distance(self.a.f[ca[xs]] @ self.b.f[cb[y]].T)
                reach = ra[xs][:, None] + rb[y][None, :]
                for p, q in zip(*np.nonzero(d <= self.tau + reach + 1e-3), strict=True):
                    i, j = xs[p], y[q]
                    if d[p, q] + reach[p, q] <= self.tau - 1e-3:
                        self.whole(sa[i], sb[j])
                    else:
                        self.walk(sa[i], sb[j], level + 1)

    def whole(self, ma: np.ndarray, mb: np.ndarray) -> None:
        """All members of one node link with all of the other."""
        self.links_a[ma] += self.wb[mb].sum()
        if not self.same:
            self.links_b[mb] += self.wa[ma].sum()
        elif len(np.intersect1d(ma, mb)):
            both = np.intersect1d(ma, mb)
            self.links_a[both] -= self.wb[both]
        self.join(np.append(ma, np.full(len(mb), ma[0])), np.append(np.full(len(ma), mb[0]), mb))

    def leaves(self, ma: np.ndarray, mb: np.ndarray) -> None:
        fb = self.b.f[mb].T
        step = max(1, 4 * DENSE // len(mb))
        for k in range(0, len(ma), step):
            rows = ma[k : k + step]
            g = self.a.f[rows] @ fb
            at = np.flatnonzero(g >= self.t - SLACK)
            if not len(at):
                continue
            near = g.ravel()[at]
            i, j = rows[at // len(mb)], mb[at % len(mb)]
            close = np.flatnonzero(near < self.t + SLACK)
            ok = np.ones(len(at), dtype=bool)
            for c in range(0, len(close), 100_000):
                part = close[c : c + 100_000]
                ok[part] = np.einsum("ij,ij->i", self.a.u[i[part]], self.b.u[j[part]]) >= self.t
            if self.same:
                ok &= i != j
            i, j = i[ok], j[ok]
            if len(i):
                self.links_a += np.bincount(i, weights=self.wb[j], minlength=len(self.links_a)).astype(np.int64)
                if not self.same:
                    self.links_b += np.bincount(j, weights=self.wa[i], minlength=len(self.links_b)).astype(np.int64)
                self.join(i, j)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def part_cells(vectors: DataFrame, block: int, tau: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors with their leaf cells; the cells (dim, cell, n, blocks); and the pairs of cells that bounds do not part.

    Tables of cells have a row per some thousand vectors, without the vectors. They are written first, so that Spark knows their
    sizes: it broadcasts those below spark.sql.autoBroadcastJoinThreshold and shuffles beyond it, where AQE splits hot cells.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    per_block = F.least(F.lit(block), F.greatest(F.lit(16), F.floor(F.lit(MOST_NUMBERS) / F.col("dim")))).cast("long")
    celled = vectors.withColumns({"dim": F.size("embedding"), "cell": F.lit(0).cast("long")})
    cells = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).withColumns({"centre": F.lit(None).cast("array<double>"), "radius": F.lit(2.0), "before": F.lit(4.0)})
    cells = common.save(cells, "near-level")
    pairs = cells.select("dim", F.col("cell").alias("a"), F.col("cell").alias("b"))
    for level in range(DEPTH):
        big = cells.filter((F.col("n") > 2 * per_block) & (F.col("radius") < SHRINK * F.col("before")) & (F.col("radius") > 1e-6))
        big = common.save(big.select("dim", "cell", "n", F.ceil(F.col("n") / per_block).alias("salts"), F.col("radius").alias("parent_radius")), "near-split")
        if big.isEmpty():
            break
        inside = celled.select("dim", "cell", "id", "embedding", "weight").join(big, ["dim", "cell"])
        drawn = inside.withColumn("h", F.xxhash64("id", F.lit(level))).filter(F.pmod("h", F.lit(1 << 20)) * F.col("n") <= (4 * SAMPLE) << 20)
        place = F.row_number().over(W.partitionBy("dim", "cell").orderBy("h", "id"))
        drawn = drawn.withColumn("place", place).filter(F.col("place") <= SAMPLE).select("dim", "cell", "salts", "embedding")

        def fit(table: pa.Table) -> pa.Table:
            u = unit(matrix(table["embedding"]))
            chosen = u[farthest_first(u, max(2, min(FANOUT, table["salts"][0].as_py())))]
            dim, cell = table["dim"][0].as_py(), table["cell"][0].as_py()
            child = pa.array([cell * FANOUT + i + 1 for i in range(len(chosen))], pa.int64())
            return pa.table({"dim": pa.array([dim] * len(chosen), pa.int32()), "cell": pa.array([cell] * len(chosen), pa.int64()), "child": child, "centre": pa.array(list(chosen), pa.list_(pa.float64()))})

        pivots = common.save(drawn.groupBy("dim", "cell").applyInArrow(fit, "dim int, cell long, child long, centre array<double>"), "near-pivots")
        dealt = inside.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("salts"))).select("dim", "cell", "salt", "id", "embedding", "weight")
        copies = pivots.join(big, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "child", "centre")

        def assign(members: pa.Table, around: pa.Table) -> pa.Table:
            out = {"dim": members["dim"], "id": members["id"], "embedding": members["embedding"], "weight": members["weight"]}
            if not members.num_rows:
                return pa.table(out | {"cell": pa.array([], pa.int64()), "off": pa.array([], pa.float64())})
            g = unit(matrix(members["embedding"])) @ matrix(around["centre"]).T
            return pa.table(out | {"cell": around["child"].to_numpy()[g.argmax(1)], "off": distance(g.max(1))})

        key = ["dim", "cell", "salt"]
        moved = dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(assign, f"dim int, id long, embedding {kind}, weight long, cell long, off double")
        stayed = celled.join(big.select("dim", "cell"), ["dim", "cell"], "left_anti").select("dim", "id", "embedding", "weight", "cell", F.lit(None).cast("double").alias("off"))
        celled = common.save(moved.unionByName(stayed), "near-cells")
        sizes = celled.filter("off IS NOT NULL").groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius"))
        children = pivots.join(big, ["dim", "cell"]).select("dim", F.col("cell").alias("parent"), F.col("child").alias("cell"), "centre", F.col("parent_radius").alias("before")).join(sizes, ["dim", "cell"])
        same = cells.join(big.select("dim", "cell"), ["dim", "cell"], "left_anti").withColumn("parent", F.col("cell"))
        grown = common.save(children.unionByName(same), "near-level")
        side = lambda p, x: grown.select("dim", F.col("parent").alias(x), *(F.col(c).alias(f"{p}_{c}") for c in ("cell", "centre", "radius")))  # noqa: E731, B023
        met = pairs.join(side("one", "a"), ["dim", "a"]).join(side("two", "b"), ["dim", "b"]).filter("a <> b OR one_cell <= two_cell")
        dot = F.aggregate(F.zip_with("one_centre", "two_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot))
        near = F.coalesce(apart <= F.col("one_radius") + F.col("two_radius") + tau + 1e-6, F.lit(True))
        pairs = common.save(met.filter(near).select("dim", F.least("one_cell", "two_cell").alias("a"), F.greatest("one_cell", "two_cell").alias("b")), "near-meets")
        cells = grown.drop("parent")
    return celled, cells.select("dim", "cell", "n", F.ceil(F.col("n") / per_block).cast("long").alias("blocks")), pairs


def near_links(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """vectors (id long, embedding, weight long) of valid, distinct vectors. Returns (id, links) and edges (u, v)."""
    tau = float(distance(threshold))
    radii = [2 * tau / 2**k for k in range(LEVELS)]
    celled, cells, pairs = part_cells(vectors, max(LEAST_BLOCK, vectors.count() // BLOCKS), tau)
    dealt = celled.join(cells, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("dim", "cell", "block", "id", "embedding", "weight")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        paths = cover_levels(unit(matrix(table["embedding"])), radii)
        return table.append_column("path", pa.array(list(paths), pa.list_(pa.int32())))

    kind = vectors.schema["embedding"].dataType.simpleString()
    trees = common.save(dealt.groupBy("dim", "cell", "block").applyInArrow(build, f"dim int, cell long, block long, id long, embedding {kind}, weight long, path array<int>"), "near-trees")
    # blocks are paired, not vectors: a table of block pairs says to which tasks the vectors of a block go
    size = lambda c, b: cells.select("dim", F.col("cell").alias(c), F.col("blocks").alias(b))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    both = pairs.join(size("a", "n1"), ["dim", "a"]).join(size("b", "n2"), ["dim", "b"]).withColumn("b1", each("n1")).withColumn("b2", each("n2")).filter("a <> b OR b1 <= b2")
    pair = F.struct(F.col("a").alias("c1"), "b1", F.col("b").alias("c2"), "b2").alias("pair")
    first = both.select("dim", F.col("a").alias("cell"), F.col("b1").alias("block"), pair, F.lit(0).alias("side"))
    second = both.filter("a <> b OR b1 <> b2").select("dim", F.col("b").alias("cell"), F.col("b2").alias("block"), pair, F.lit(1).alias("side"))
    tasks = trees.join(first.unionAll(second), ["dim", "cell", "block"]).select("dim", "pair", "side", "id", "embedding", "weight", "path")

    def dual(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("id", "ascending")])
        side = table["side"].to_numpy()
        u, paths = unit(matrix(table["embedding"])), matrix(table["path"])
        weight, ids = table["weight"].to_numpy(), table["id"].to_numpy()
        n = int((side == 0).sum())
        pair = table["pair"][0].as_py()
        same = (pair["c1"], pair["b1"]) == (pair["c2"], pair["b2"])
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not same and (n == 0 or n == len(ids)):
            return empty
        a = Tree(u[:n], paths[:n])
        b = a if same else Tree(u[n:], paths[n:])
        j = Join(a, b, weight[:n], weight[:n] if same else weight[n:], same, threshold)
        j.run()
        links = j.links_a if same else np.append(j.links_a, j.links_b)
        at = np.flatnonzero(links)
        return pa.table({"id": ids[at], "links": links[at], "root": ids[j.labels[at]]})

    found = common.save(tasks.groupBy("dim", "pair").applyInArrow(dual, "id long, links long, root long"), "near-found")
    common.drop(trees)
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.select(F.col("id").alias("u"), F.col("root").alias("v"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: its id, n_links, component_id and kept."""
    e = F.col(embedding)
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("vec_id"), e.alias("embedding")).withColumn("valid", valid)
    # 128 bits name equal vectors
    rows = rows.withColumns({"k1": F.when(F.col("valid"), F.xxhash64("embedding")), "k2": F.when(F.col("valid"), F.xxhash64(F.lit(1), "embedding"))})
    distinct = rows.filter("valid").groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    distinct = common.save(distinct.withColumn("id", F.monotonically_increasing_id()), "near-distinct")
    links, edges = near_links(distinct.select("id", "embedding", "weight"), threshold)
    labels = components(edges)
    stats = common.save(distinct.select("k1", "k2", "id", "weight", "least").join(links, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-stats")
    groups = stats.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stats.join(groups, "component").select("k1", "k2", "component_id", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # equal vectors may be a third of all rows: their key is hot
    slim = rows.select("vec_id", F.when(F.col("valid"), F.struct("k1", "k2")).alias("k"))
    total = distinct.agg(F.sum("weight")).first()[0] or 0
    joined = common.join_hot(slim, known.select(F.struct("k1", "k2").alias("k"), "component_id", "weight", "n_links"), "k", "weight", total)
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.u = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.id = v.vec_id
"""
