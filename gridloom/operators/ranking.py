"""Directed compatibility of items and the search for the best ordering of a queue.

Tables: queue (queue_id, pos, ...vectors and metadata), edges (queue_id, src, dst, total), energies (queue_id, pos, energy).
All searches run on every queue at once, level by level; their states are rows. A queue has at most tens of items, so
all ordered pairs of a queue are the edges of its graph, and levels are bounded by the beam width per queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import arrays, scalar, search
from ..functions.scalar import clip
from ..functions.scratch import cut

TERMS = {"style": 0.18, "directional": 0.25, "trajectory": 0.16, "tempo": 0.15, "acoustic": 0.08, "energy": 0.09, "structure": 0.09}
HINGES = (("style", 0.22, 0.52), ("directional", 0.24, 0.58), ("tempo", 0.20, 0.58), ("energy", 0.14, 0.50), ("structure", 0.10, 0.48))


def ordered_pairs(queue: DataFrame) -> DataFrame:
    """All (a, b) of one queue with a's pos not b's: an equi-join on the queue."""
    names = [c for c in queue.columns if c != "queue_id"]
    a = queue.select("queue_id", *[F.col(c).alias(f"a_{c}") for c in names])
    b = queue.select("queue_id", *[F.col(c).alias(f"b_{c}") for c in names])
    return a.join(b, "queue_id").filter("a_pos <> b_pos")


def grouped_pairs(items: DataFrame, left: dict[str, str], right: dict[str, str], scores: dict[str, Column], block: int = 512) -> DataFrame:
    """items (group, id, ...) to (a, b, scores) of all ordered pairs of ids within a group; items without a group (null or empty) are one.

    left and right name the columns of a and of b that the scores are made of. The items of a group are dealt by hash into
    blocks of about `block`, and each block meets each: a cell of two blocks is what a task gets, however large the group.
    Within a cell a score is computed once per pair of distinct left and right values; the ids unfold behind it.
    """
    i = items.withColumn("group", F.coalesce(F.col("group").cast("string"), F.lit("")))
    sizes = i.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    i = i.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def side(ids: str, names: dict[str, str], own: str, other: str) -> DataFrame:
        rows = i.groupBy("group", "blocks", F.col("block").alias(own), *[F.col(c).alias(n) for n, c in names.items()]).agg(F.collect_list("id").alias(ids))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    # cells are few bytes and many pairs: a fixed number of partitions, or adaptive execution would merge them into one
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["group", "block_a", "block_b"]
    cells = side("ids_a", left, "block_a", "block_b").repartition(n, *cell).join(side("ids_b", right, "block_b", "block_a"), cell)
    scored = cells.select("ids_a", "ids_b", *[c.alias(k) for k, c in scores.items()])
    return scored.withColumn("a", F.explode("ids_a")).withColumn("b", F.explode("ids_b")).filter("a <> b").select("a", "b", *scores)


def edge_scores(queue: DataFrame) -> DataFrame:
    """(queue_id, src, dst, seven terms, jump_penalty, total) of every ordered pair."""
    p = ordered_pairs(queue)
    c = F.col
    known = (F.size("a_global") > 0) & (F.size("b_global") > 0)
    sim = lambda x, y: F.when(known, arrays.cosine_similarity(c(x), c(y))).otherwise(0.5)
    tail = F.slice("a_timeline", -F.least(F.lit(3), F.size("a_timeline")), F.least(F.lit(3), F.size("a_timeline")))
    near = scalar.related_bpm("b_bpm", "a_bpm")
    tempo = scalar.decay(F.log(F.greatest(near, F.lit(1e-6)) / F.greatest(c("a_bpm"), F.lit(1e-6))), 9.0)
    six = (F.size("a_acoustic") >= 6) & (F.size("a_acoustic") == F.size("b_acoustic"))
    weights = F.array(*map(F.lit, (1.2, 1.0, 0.8, 1.2, 0.8)))
    apart = F.zip_with(F.slice("a_acoustic", 2, 5), F.slice("b_acoustic", 2, 5), lambda x, y: (x - y) * (x - y))
    p = p.select(
        "queue_id", c("a_pos").alias("src"), c("b_pos").alias("dst"),
        sim("a_global", "b_global").alias("style"),
        sim("a_outro", "b_intro").alias("directional"),
        F.when(known, arrays.dtw_similarity(tail, F.slice("b_timeline", 1, 3), 0.0)).otherwise(0.5).alias("trajectory"),
        tempo.alias("tempo"),
        F.when(six, clip(F.exp(-2.0 * F.sqrt(arrays.dot(weights, apart) / 5.0)))).otherwise(0.5).alias("acoustic"),
        F.when(six, clip(scalar.decay(F.get("a_acoustic", F.lit(0)) - F.get("b_acoustic", F.lit(0)), 2.8))).otherwise(0.5).alias("energy"),
        scalar.structure_score(F.lower("a_last_label"), F.lower("b_first_label")).alias("structure"),
    )
    penalty = sum((w * F.greatest(F.lit(0.0), limit - F.col(t)) / limit for t, w, limit in HINGES[1:]), HINGES[0][1] * F.greatest(F.lit(0.0), HINGES[0][2] - F.col(HINGES[0][0])) / HINGES[0][2])
    p = p.withColumn("penalty", penalty)
    total = sum((w * F.col(t) for t, w in list(TERMS.items())[1:]), TERMS["style"] * F.col("style")) - F.col("penalty")
    return p.withColumn("total", clip(total)).withColumn("jump_penalty", clip(F.col("penalty"))).drop("penalty")


def energies(queue: DataFrame) -> DataFrame:
    return queue.select("queue_id", "pos", F.coalesce(F.get("acoustic", F.lit(0)), F.lit(0.0)).alias("energy"))


def edge_labels(segments: DataFrame) -> DataFrame:
    """(track_id, first_label, last_label) among labels that say something; unknown for tracks without any."""
    said = ~F.lower("label").isin("start", "end", "unknown", "")
    x = segments.groupBy("track_id").agg(F.min_by(F.lower("label"), F.when(said, F.col("seg"))).alias("f"), F.max_by(F.lower("label"), F.when(said, F.col("seg"))).alias("l"), F.max(said).alias("any"))
    return x.select("track_id", F.when(F.col("any"), F.col("f")).otherwise("unknown").alias("first_label"), F.when(F.col("any"), F.col("l")).otherwise("unknown").alias("last_label"))


def log_score(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-4)))


def path_objective(paths: DataFrame, edges: DataFrame, energy: DataFrame) -> DataFrame:
    """paths (queue_id, path_id, step, item) to (queue_id, path_id, value, weakest), by windows along the steps."""
    along = W.partitionBy("queue_id", "path_id").orderBy("step")
    p = paths.join(energy.withColumnRenamed("pos", "item"), ["queue_id", "item"]).withColumn("src", F.lag("item").over(along)).withColumn("d", F.col("energy") - F.lag("energy").over(along))
    p = p.join(edges.select("queue_id", "src", F.col("dst").alias("item"), "total"), ["queue_id", "src", "item"], "left")
    p = p.withColumn("worst", F.least(F.lit(1.0), F.min("total").over(along.rowsBetween(W.unboundedPreceding, 0)))).withColumn("before", F.lag("d").over(along))
    gain = log_score(F.col("total")) + 0.28 * log_score(F.col("worst")) + F.when(F.col("before").isNull(), 0.0).otherwise(scalar.energy_arc_term("before", "d"))
    return p.groupBy("queue_id", "path_id").agg(F.sum(F.when(F.col("src").isNotNull(), gain).otherwise(0.0)).alias("value"), F.min("worst").alias("weakest"))


def _matrix(edges: DataFrame, energy: DataFrame) -> DataFrame:
    """(queue_id, m, en): per queue its edge scores as one row-major array and its energies, items being 0..n-1."""
    cells = edges.select("queue_id", "src", "dst", "total").unionAll(energy.select("queue_id", "pos", "pos", F.lit(0.0)))
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    return cells.groupBy("queue_id").agg(ordered("src", "dst", "total").alias("m")).join(energy.groupBy("queue_id").agg(ordered("pos", "energy").alias("en")), "queue_id")


def _rest(path: Column, n: Column) -> Column:
    """Items that a path has not used."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(path, i))


def _expand(states: DataFrame, matrix: DataFrame) -> DataFrame:
    """Every state (queue_id, path, value, weakest, energy, d) with each item it has not used.

    States and matrices are partitioned by queue, and so are all windows over them: levels need no shuffle.
    """
    n = F.size("en")
    rest = _rest(F.col("path"), n)
    # a path of all items stays as it is, so that shorter queues last until the longest ends
    s = states.join(matrix, "queue_id").withColumn("dst", F.explode(F.when(F.size(rest) == 0, F.array(F.lit(-1))).otherwise(rest)))
    keep = lambda c, new: F.when(F.col("dst") < 0, F.col(c)).otherwise(new).alias(c)
    at = F.greatest(F.col("dst"), F.lit(0))
    s = s.withColumns({"total": F.get("m", F.element_at("path", -1) * n + at), "step": F.get("en", at) - F.col("energy")})
    worst = F.least("weakest", "total")
    value = F.col("value") + log_score(F.col("total")) + 0.28 * log_score(worst) + F.when(F.size("path") >= 2, scalar.energy_arc_term("d", "step")).otherwise(0.0)
    return s.select("queue_id", keep("path", F.concat("path", F.array("dst"))), keep("value", value), keep("weakest", worst), keep("energy", F.get("en", at)), keep("d", F.col("step")))


def _keyed(states: DataFrame) -> DataFrame:
    """The set used and the last two items: what decides how a path can go on."""
    return states.withColumns({"used": F.array_sort("path"), "prev": F.coalesce(F.get("path", F.size("path") - 2), F.lit(-1)), "last": F.element_at("path", -1)})


def skyline(states: DataFrame) -> DataFrame:
    """States that no other of the same key matches in value and in weakest edge; of equal ones the larger path."""
    w = W.partitionBy("queue_id", "used", "prev", "last").orderBy(F.desc("value"), F.desc("weakest"), F.desc("path")).rowsBetween(W.unboundedPreceding, -1)
    s = _keyed(states).withColumn("best", F.max("weakest").over(w))
    return s.filter(F.col("best").isNull() | (F.col("weakest") > F.col("best"))).drop("best", "used", "prev", "last")


def _begin(matrix: DataFrame, start: int) -> DataFrame:
    return matrix.filter(F.size("en") > start).select("queue_id", F.array(F.lit(start)).alias("path"), F.lit(0.0).alias("value"), F.lit(1.0).alias("weakest"), F.get("en", F.lit(start)).alias("energy"), F.lit(0.0).alias("d"))


def _integers(edges: DataFrame, energy: DataFrame) -> DataFrame:
    e = edges.select("queue_id", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "total")
    return cut(_matrix(e, energy.select("queue_id", F.col("pos").cast("int").alias("pos"), "energy")).repartition("queue_id"))


def _final(states: DataFrame) -> DataFrame:
    best = F.max(F.struct("value", "weakest", "path")).alias("b")
    return states.groupBy("queue_id").agg(best).select("queue_id", "b.path", "b.value", "b.weakest")


LEVELS = 5
"""Levels of a search between two cuts of its lineage."""


def exact_order(edges: DataFrame, energy: DataFrame, count: int, start: int = 0) -> DataFrame:
    """(queue_id, path, value, weakest): best paths of `count` items, or of all if a queue has fewer, by subset dynamic programming, for up to 10 items.

    One level per item: expand, then keep the skyline per (set, last two items).
    """
    matrix = _integers(edges, energy)
    states = _begin(matrix, start)
    for level in range(1, count):
        states = skyline(_expand(states, matrix))
        if level % LEVELS == 0 and level < count - 1:
            states = cut(states)
    return _final(states)


def _hope(path: Column, m: Column, n: Column) -> Column:
    """Optimistic value of the two next steps: the two best routes and the best single step."""
    rest, last = _rest(path, n), F.element_at(path, -1)
    score = lambda i, j: log_score(F.get(m, i * n + j))
    onward = lambda i: F.array_max(F.transform(F.filter(rest, lambda j: j != i), lambda j: score(i, j)))
    routes = F.sort_array(F.transform(rest, lambda i: score(last, i) + 0.52 * F.coalesce(onward(i), score(last, i))), False)
    direct = F.array_max(F.transform(rest, lambda i: score(last, i)))
    return F.when(F.size(rest) == 0, 0.0).otherwise(0.105 * F.get(routes, F.lit(0)) + 0.035 * F.coalesce(F.get(routes, F.lit(1)), F.get(routes, F.lit(0))) + 0.025 * direct)


def beam_order(edges: DataFrame, energy: DataFrame, count: int, start: int = 0, width: int = 192) -> DataFrame:
    """The same by beam search with look-ahead, at most two states per key and a reserve of distinct last items."""
    width = max(12, width)
    matrix = _integers(edges, energy)
    states = _begin(matrix, start)
    order = [F.desc("rank"), F.desc("weakest"), F.desc("value"), F.desc("path")]
    for level in range(1, count):
        frontier = W.partitionBy("queue_id", "used", "prev", "last").orderBy(F.desc(F.col("value") + 0.12 * log_score(F.col("weakest"))), F.desc("weakest"), F.desc("path"))
        c = _keyed(skyline(_expand(states, matrix))).withColumn("r", F.row_number().over(frontier)).filter("r <= 2").drop("r", "used", "prev")
        c = c.join(matrix, "queue_id").withColumn("rank", F.col("value") + _hope(F.col("path"), F.col("m"), F.size("en"))).drop("m", "en")
        c = c.withColumn("of_last", F.row_number().over(W.partitionBy("queue_id", "last").orderBy(*order)))
        # the best of each last item first, as far as the reserve goes, then by rank
        lead = c.withColumn("lead", F.when(F.col("of_last") == 1, F.row_number().over(W.partitionBy("queue_id", "of_last").orderBy(*order))))
        reserved = F.coalesce(F.col("lead") <= max(1, width // 5), F.lit(False))
        chosen = lead.withColumn("place", F.row_number().over(W.partitionBy("queue_id").orderBy(F.desc(reserved), *order))).filter(F.col("place") <= width)
        states = chosen.select("queue_id", "path", "value", "weakest", "energy", "d")
        if level % 2 == 0 and level < count - 1:
            states = cut(states)
    return _final(states)


def neighbours(paths: DataFrame) -> DataFrame:
    """All paths made from `path` by swapping two items or moving one, the first item staying; and path itself."""
    n = F.size("path")
    at = lambda i: F.get("path", i)
    ij = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(1), n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    p = paths.filter(n > 1).select("queue_id", "path", F.explode(ij).alias("m"))
    i, j = F.col("m.i"), F.col("m.j")
    swapped = F.transform("path", lambda x, k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(x))
    without = F.filter("path", lambda x: x != at(i))
    moved = F.concat(F.slice(without, F.lit(1), j), F.array(at(i)), F.slice(without, j + 1, n))
    return p.select("queue_id", F.explode(F.array(swapped, moved)).alias("path")).unionByName(paths.select("queue_id", "path")).distinct()


def polish(paths: DataFrame, edges: DataFrame, energy: DataFrame, passes: int = 2) -> DataFrame:
    """Best improvement among neighbours, `passes` times; queues of more than 36 items stay as they are."""
    long = paths.filter(F.size("path") > 36).select("queue_id", "path")
    best = paths.filter(F.size("path") <= 36).select("queue_id", "path")
    for _ in range(passes):
        steps = neighbours(best).select("queue_id", F.col("path").alias("path_id"), F.posexplode("path").alias("step", "item"))
        scored = path_objective(steps, edges, energy).withColumnRenamed("path_id", "path")
        best = cut(_final(scored).select("queue_id", "path"))
    return best.unionByName(long)


def _walked(matrix: DataFrame, walk) -> DataFrame:
    """(queue_id, path) of walk(m, en, n) on the scores and energies of each queue of n items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ms, ens = (b.column(i) for i in range(3))
            paths = []
            for m, en in zip(ms.to_pylist(), ens.to_pylist(), strict=True):
                n = len(en)
                paths.append(list(walk(np.reshape(m, (n, n)), en, n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(paths, pa.list_(pa.int32()))], names=["queue_id", "path"])

    kind = matrix.schema["queue_id"].dataType.simpleString()
    return matrix.select("queue_id", "m", "en").mapInArrow(run, f"queue_id {kind}, path array<int>")


def rank_queue(queue: DataFrame, start: int = 0) -> DataFrame:
    """(queue_id, path): exact orders up to 10 items, else beam and polish.

    A queue is one group of at most some tens of items: one exchange brings its scores together and a kernel walks the
    levels, without a job per level. exact_order() and beam_order() are the same search on rows, for larger frontiers.
    """
    return _walked(_matrix(edge_scores(queue), energies(queue)), lambda m, en, n: search.order(m, en, min(start, n - 1)))


def beam_queue(queue: DataFrame, start: int = 0, width: int = 192) -> DataFrame:
    """(queue_id, path): beam_order() of all items of each queue, without a job per level.

    Queues are few bytes and much work: a fixed number of partitions, or adaptive execution would merge them into a few.
    """
    parts = int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = queue.repartition(parts, "queue_id")
    matrix = _matrix(edge_scores(q), energies(q)).repartition(parts, "queue_id")
    return _walked(matrix, lambda m, en, n: search.beam(m, en, min(start, n - 1), width))


def lock_prefix(queue: DataFrame, order: DataFrame, locked: Column) -> DataFrame:
    """queue (queue_id, pos, ...) with new_pos: items up to `locked` stay, those after follow the order's path.

    order (queue_id, path) ranks the suffix, its first item being the anchor, the last locked one.
    """
    placed = order.select("queue_id", F.posexplode("path").alias("step", "pos"))
    q = queue.withColumn("_l", locked).join(placed, ["queue_id", "pos"], "left")
    return q.withColumn("new_pos", F.when(F.col("pos") <= F.col("_l"), F.col("pos")).otherwise(F.col("_l") + F.col("step"))).drop("_l", "step")


def sorted_neighbours(edges: DataFrame) -> DataFrame:
    """(queue_id, src, rank, dst, total): where one may go from each item, the best first, of equals the earlier item."""
    w = W.partitionBy("queue_id", "src").orderBy(F.desc("total"), "dst")
    return edges.select("queue_id", "src", (F.row_number().over(w) - 1).cast("int").alias("rank"), "dst", "total")


def rank_snapshot(queue: DataFrame, anchor: Column) -> DataFrame:
    """queue (queue_id, pos, ...) with new_pos: items up to the anchor's pos stay, those after it are ranked from the anchor on.

    The anchor is the track that plays, or the one that comes in while a transition runs.
    """
    at = queue.withColumn("_a", anchor)
    suffix = at.filter(F.col("pos") >= F.col("_a"))
    path = rank_queue(suffix.withColumn("pos", F.col("pos") - F.col("_a")).drop("_a"))
    first = suffix.select("queue_id", "_a").distinct()
    order = path.join(first, "queue_id").select("queue_id", F.transform("path", lambda x: x + F.col("_a")).alias("path"))
    return lock_prefix(at, order, F.col("_a")).drop("_a")


def without_vectors(queue: DataFrame) -> DataFrame:
    """queue whose items have no profile: its terms are neutral, so that tempo and structure alone rank it."""
    empty = {n: F.array().cast(queue.schema[n].dataType) for n in ("global", "intro", "outro", "timeline", "acoustic")}
    return queue.withColumns(empty)


def order_quality(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(queue_id, average, worst) of adjacent edges along path."""
    w = W.partitionBy("queue_id").orderBy("step")
    p = order.select("queue_id", F.posexplode("path").alias("step", "src")).withColumn("dst", F.lead("src").over(w)).filter("dst IS NOT NULL")
    return p.join(edges, ["queue_id", "src", "dst"]).groupBy("queue_id").agg(F.avg("total").alias("average"), F.min("total").alias("worst"))


def assign_clusters(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """vectors (id, v) and centres (k, c), of which there are five at most: (id, k) of the largest dot product, the first of equals."""
    d = vectors.join(F.broadcast(centres), how="cross").withColumn("s", arrays.dot(F.col("v"), F.col("c")))
    return d.groupBy("id").agg(F.max_by("k", F.struct("s", -F.col("k"))).alias("k"))


def style_clusters(vectors: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, cluster) of small spherical k-means, seeded farthest first from the smallest id; clusters from 1 on.

    vectors (id, v); an empty v is unavailable and takes part as a zero vector; without any v all clusters are 0.
    k = round(sqrt(n)) within 1..5. Per round one pass: assignment and per-dimension means; five centres reach the driver.
    """
    spark = vectors.sparkSession
    dim, n = vectors.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n or not dim or dim < 1:
        return vectors.select("id", F.lit(0).alias("cluster"))
    v = cut(vectors.select("id", F.when(F.size("v") == dim, F.col("v")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("v")))
    k = max(1, min(5, n, round(n**0.5)))
    seed = v.orderBy("id").limit(1).first()["v"]
    chosen = [seed]
    for _ in range(k - 1):
        sims = [arrays.dot(F.col("v"), F.array(*map(F.lit, c))) for c in chosen]
        far = 1.0 - (F.greatest(*sims) if len(sims) > 1 else sims[0])
        chosen.append(v.orderBy(far.desc(), "id").limit(1).first()["v"])
    labels = None
    for i in range(rounds):
        centres = spark.createDataFrame([(j, c) for j, c in enumerate(chosen)], "k int, c array<double>")
        new = cut(assign_clusters(v, centres))
        if i and new.join(labels, ["id", "k"], "left_anti").isEmpty():
            break
        labels = new
        dims = labels.join(v, "id").select("k", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.avg("x").alias("x"))
        for row in dims.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).collect():
            size = sum(x * x for x in row["c"]) ** 0.5
            if size > 1e-9:
                chosen[row["k"]] = [x / size for x in row["c"]]
    return labels.select("id", (F.col("k") + 1).alias("cluster"))
