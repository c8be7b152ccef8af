"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; five in a row make a
shingle, and the t-th copy of a shingle in a document is a feature of its own, so that min and max of term
frequencies are those of sets. A feature weighs WEIGHT * ln(N/df) / ln(N/rare), at most WEIGHT and at least 1, with df of its
shingle: one in RARE_SHARE of N contents, and RARE_MORE more, is rare and weighs all, one in every content next to nothing.
df counts contents, not copies: a document whose shingles lie in a group of c like documents counts 1/c, so that a group
of copies does not make its own text common, while a passage that unlike documents share is. Groups are read from
COPY_BINS least shingle hashes (one of each 1/COPY_BINS of the hash range) of all documents; those of at least 1/1000 of
all documents matter to df, so COPY_BINS * 1000 of them at most reach the driver. df itself is kept in DF_BUCKETS hashed buckets;
what a bucket holds by chance is taken off: about 300/DF_BUCKETS of N for documents of 300 words, at every size of the
corpus twice what counts as rare, with an error that falls as the corpus grows.

BANDS bands of ROWS samples give buckets. Within a bucket, documents whose sketches agree in CANDIDATE of
their samples are joined; the components of these links go whole to tasks that compare features exactly, by
integer sums, and join documents of weighted Jaccard similarity >= threshold. Buckets and components of more than
BLOCK documents are dealt into blocks, which meet some hubs first and then only what the hubs left open; no task holds
more than two blocks and none emits pairs.

Cases: a null text is empty; documents with the same words are one class, and so are documents of the same
text without words; fewer than five words make one shingle; repeated rows share a class; a null doc_id is the
class of its text, or that of the smallest doc_id there; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common
from .components import components, local_labels

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
CANDIDATE = 0.5
"""Agreement of 24 of 48 samples loses 5e-7 of pairs at similarity 0.8, less than banding does."""
DF_BITS = 17
DF_BUCKETS = 1 << DF_BITS
WEIGHT, RARE_SHARE, RARE_MORE = 200, 1000, 8
COPY_BINS, UNIT = 16, 1 << 20
BLOCK = 2048
BLOCK_FEATURES = 1 << 22
"""Documents of a block; features of a block on average, for components of long documents."""
HUBS = 64
"""Members of a group of more than one block that all others meet first."""
CHUNK = 1 << 20
"""Bytes of a text that are hashed at once; words are never cut."""

U64 = np.uint64
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Texts to word hashes and shingle hashes without a Python step per word."""

    def __init__(self):
        table = np.zeros(256, dtype=np.uint8)
        for c in range(256):
            if c >= 128 or chr(c).isalnum():
                table[c] = c + 32 if 65 <= c <= 90 else c
        self.table = table
        self.up, self.down = np.ones(1, dtype=U64), np.ones(1, dtype=U64)
        self.order = mix(np.arange(1, SHINGLE + 1, dtype=U64)) | U64(1)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.append(self.up, self.up * U64(pow(BASE, k, 1 << 64)))
            self.down = np.append(self.down, self.down * U64(pow(BASE_INVERSE, k, 1 << 64)))

    def words(self, text: str | None) -> np.ndarray:
        b = self.table[np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)]
        if len(b) <= CHUNK:
            return self._part(b)
        parts, start = [], 0
        gaps = np.append(np.flatnonzero(b == 0), len(b))
        while start < len(b):
            # up to the last gap within the chunk, or the next one after a longer word
            i = int(np.searchsorted(gaps, start + CHUNK, "right"))
            end = int(gaps[i - 1]) if i and gaps[i - 1] > start else int(gaps[min(i, len(gaps) - 1)])
            parts.append(self._part(b[start:end]))
            start = end if end == len(b) else end + 1
        return np.concatenate(parts)

    def _part(self, b: np.ndarray) -> np.ndarray:
        n = len(b)
        if not n:
            return np.empty(0, dtype=U64)
        self.powers(n + 1)
        inside = np.concatenate(([False], b != 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(b * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])

    def key(self, words: np.ndarray, text: str | None) -> tuple[int, int]:
        """128 bits for the word sequence; for the text if it has no words."""
        if not len(words):
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(U64) + U64(1 << 32)
            words = mix(raw) if len(raw) else np.zeros(1, dtype=U64)
        place = np.arange(1, len(words) + 1, dtype=U64)
        one = mix(words + place * U64(0xD6E8FEB86659FD93)).sum(dtype=U64)
        two = mix(words ^ mix(place * U64(0xA0761D6478BD642F))).sum(dtype=U64)
        return tuple(mix(np.array([one, two])).view(np.int64).tolist())

    def shingles(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if not n:
            return words
        k = min(SHINGLE, n)
        s = np.zeros(n - k + 1, dtype=U64)
        for j in range(k):
            s += words[j : n - k + 1 + j] * self.order[j]
        return mix(s)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - DF_BITS)).astype(np.int64)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least shingle hash of each COPY_BINS-th of the hash range that has one; near copies share most of them."""
    s = np.sort(shingles)
    bins = np.arange(COPY_BINS, dtype=U64)
    at = np.searchsorted(s, bins * U64((1 << 64) // COPY_BINS))
    found = s[np.minimum(at, len(s) - 1)]
    return found[(at < len(s)) & (found // U64((1 << 64) // COPY_BINS) == bins)]


def features(shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes (shingle and number of its copy) and integer weights."""
    s = np.sort(shingles)
    if not len(s):
        return s, np.empty(0, dtype=np.int64)
    first = np.append(True, s[1:] != s[:-1])
    w = weights[bucket(s)]
    if not first.all():
        at = np.arange(len(s))
        copy = at - np.maximum.accumulate(np.where(first, at, 0))
        s = np.where(first, s, mix(s + copy.astype(U64) * U64(0xE7037ED1A0B428DB)))
    return s, w


class Sampler:
    """Improved consistent weighted sampling: per sample k the feature with the least ln(a), and its level t."""

    def __init__(self):
        x = np.linspace(0, 40, 400_001)
        cdf = 1 - (1 + x) * np.exp(-x)
        gamma = lambda n: np.interp((np.arange(n) + 0.5) / n, cdf, x)  # noqa: E731  quantiles of Gamma(2, 1)
        self.r = gamma(4096).astype(np.float32)
        self.ln_c = np.log(gamma(65536)).astype(np.float32)
        rng = np.random.default_rng(20240607)
        self.xor = rng.integers(0, 1 << 64, SAMPLES, dtype=U64)[:, None]
        self.mul = (rng.integers(0, 1 << 64, SAMPLES, dtype=U64) | U64(1))[:, None]

    def _part(self, h: np.ndarray, ln_w: np.ndarray):
        x = (h[None, :] ^ self.xor) * self.mul
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        r = self.r[(x >> U64(52)).astype(np.int32)]
        ln_c = self.ln_c[(x >> U64(36)).astype(np.int32) & 0xFFFF]
        beta = ((x >> U64(16)).astype(np.int32) & 0xFFFFF).astype(np.float32) * np.float32(2.0**-20)
        t = np.floor(ln_w[None, :] / r + beta)
        ln_a = ln_c - r * (t - beta + np.float32(1))
        at = ln_a.argmin(1)
        k = np.arange(SAMPLES)
        return ln_a[k, at], h[at], t[k, at]

    def __call__(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """SAMPLES hashes, each of the feature and level sampled."""
        ln_w = np.log(w.astype(np.float32))
        best = None
        for a in range(0, len(h), 4096):
            part = self._part(h[a : a + 4096], ln_w[a : a + 4096])
            if best is None:
                best = part
            else:
                better = part[0] < best[0]
                best = tuple(np.where(better, p, b) for p, b in zip(part, best, strict=True))
        return mix(best[1] + best[2].astype(np.int64).view(U64) * U64(0x8EBC6AF09C88C6E3))


def copy_groups(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted least hashes that at least 1/1000 of n texts share, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in batches:
            least = [least_hashes(s) for s in map(sh.shingles, map(sh.words, b.column(0).to_pylist())) if len(s)]
            if least:
                h, k = np.unique(np.concatenate(least), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k)], names=["h", "n"])

    counts = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.filter((F.col("n") > 1) & (F.col("n") * RARE_SHARE >= n)).toArrow()
    h, k = rows["h"].to_numpy().view(U64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], k[order]


def share(least: np.ndarray, groups: tuple[np.ndarray, np.ndarray]) -> int:
    """UNIT over the size of the group of copies that more than half of the least hashes name."""
    h, k = groups
    at = np.minimum(np.searchsorted(h, least), len(h) - 1)
    size = np.sort(np.where(h[at] == least, k[at], 1)) if len(h) else np.ones(len(least), dtype=np.int64)
    return max(1, UNIT // int(size[(len(size) - 1) // 2]))


def idf_weights(texts: DataFrame) -> np.ndarray:
    """Integer weight per bucket of shingles. Partial sums per task, summed by bucket: DF_BUCKETS rows reach the driver."""
    groups = copy_groups(texts, texts.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, df, n, seen = Shingler(), np.zeros(DF_BUCKETS, dtype=np.int64), 0, np.zeros(DF_BUCKETS, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                s = sh.shingles(sh.words(text))
                if len(s):
                    at, part = bucket(s), share(least_hashes(s), groups)
                    if len(s) < 4000:
                        df[np.unique(at)] += part
                    else:
                        seen[at] = part
                        df += seen
                        seen[:] = 0
                    n += part
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, sums = rows["bucket"].to_numpy(), rows["n"].to_numpy() / UNIT
    n = float(sums[at < 0].sum())
    df = np.zeros(DF_BUCKETS)
    df[at[at >= 0]] = sums[at >= 0]
    chance = np.median(df)
    df = np.maximum(1.0, df - chance - 4 * np.sqrt(chance))
    rare = n / RARE_SHARE + RARE_MORE
    if n <= rare:
        return np.full(DF_BUCKETS, WEIGHT, dtype=np.int64)
    return np.rint(WEIGHT * np.clip(np.log(np.maximum(1.0, n / df)) / np.log(n / rare), 1 / WEIGHT, 1)).astype(np.int64)


def sketches(docs: DataFrame, keep: list[str], weights) -> DataFrame:
    """Columns `keep`, key1, key2, n_features, bands (array of long) and sketch (a byte per sample)."""

    def make():
        sh, sample, w = Shingler(), Sampler(), weights.value
        salt = mix(np.arange(1, BANDS + 1, dtype=U64))

        def run(texts):
            out = [[], [], [], [], []]
            for text in texts:
                words = sh.words(text)
                key = sh.key(words, text)
                f, fw = features(sh.shingles(words), w)
                bands, sketch = [], b""
                if len(f) > 1:
                    s = sample(f, fw)
                    rows = s.reshape(BANDS, ROWS)
                    h = salt.copy()
                    for j in range(ROWS):
                        h = mix(h + rows[:, j])
                    bands, sketch = h.view(np.int64).tolist(), (s & U64(255)).astype(np.uint8).tobytes()
                for column, value in zip(out, (*key, len(f), bands, sketch), strict=True):
                    column.append(value)
            return out

        return run

    fields = [common.long("key1"), common.long("key2"), common.long("n_features"), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return common.scan(docs, keep, ["text"], fields, make)


def by_group(df: DataFrame, order: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None]) -> DataFrame:
    """Deals rows by `task` and hands whole groups, many at once, to work(table, starts of the groups)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(table: pa.Table):
            key = table["task"].to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            return work(table, starts)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key = t["task"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if held and held[0]["task"][0].as_py() != key[-1] or not held and last:
                ready = pa.concat_tables([*held, t.slice(0, last)])
                if ready.num_rows and (out := done(ready)) is not None:
                    yield out
                held = []
                t = t.slice(last)
            held.append(t)
        if held and (out := done(pa.concat_tables(held))) is not None:
            yield out

    return df.repartition(F.col("task")).sortWithinPartitions("task", *order).mapInArrow(run, schema)


def link_groups(members: DataFrame, payload: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], any_large: bool, tag: str) -> DataFrame:
    """Edges that connect the members (id, group, blocks, *payload) of each group as work() finds them, whole.

    Groups of one block are one task. A larger group meets HUBS of its members first, block by block: what links to the
    same hubs is one class, for a group of copies nearly all of it, after work that is linear in its size. Members outside
    the largest class then meet all members, in pairs of blocks. Pairs within the largest class need no look.
    any_large says whether there are groups of more than one block.
    """
    if any_large:
        members = common.save(members, f"{tag}-members")
    columns = ["task", "side", "id", *payload]
    few = members.filter("blocks <= 1").withColumn("task", F.xxhash64("group")).withColumn("side", F.lit(0))
    edges = by_group(few.select(columns), ["side", "id"], EDGE, work)
    if not any_large:
        return edges
    large = members.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    first = W.partitionBy("group").orderBy(F.xxhash64("id", F.lit(7)), "id")
    hubs = large.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= HUBS)
    task = lambda *c: F.xxhash64("group", *c)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    hub_side = hubs.withColumn("block", each).withColumn("task", task("block")).withColumn("side", F.lit(0))
    doc_side = large.withColumn("task", task("block")).withColumn("side", F.lit(1))
    to_hubs = common.save(by_group(hub_side.select(columns).unionAll(doc_side.select(columns)), ["side", "id"], EDGE, work), f"{tag}-hubs")
    named = large.select("id", "group").join(components(to_hubs), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = common.save(named, f"{tag}-classes")
    counts = named.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("top"), (F.sum("n") - F.max("n")).alias("rest")).filter("rest > 0")
    top = common.save(top.withColumn("rest_blocks", F.ceil(F.col("rest") / BLOCK)), f"{tag}-rest")
    if not top.isEmpty():
        open_ = large.join(named, ["id", "group"]).join(top, "group")
        each_rest = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1))
        outside = open_.filter("component <> top").withColumn("rest_block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("rest_blocks"))).withColumn("block", each)
        whole = open_.withColumn("rest_block", each_rest)
        pair = lambda df, side: df.withColumn("task", task("block", "rest_block")).withColumn("side", F.lit(side)).select(columns)
        edges = edges.unionAll(by_group(pair(outside, 0).unionAll(pair(whole, 1)), ["side", "id"], EDGE, work))
    return edges.unionAll(to_hubs)


EDGE = "u long, v long"


def _edges(ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
    at = np.flatnonzero(labels != np.arange(len(labels)))
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[labels[at]])], names=["u", "v"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal samples of each row of a with each of b."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).sum(2)
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def link_sketches(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
    """Within each group, or between its sides, documents whose sketches agree in CANDIDATE of the samples."""
    ids, side = table["id"].to_numpy(), table["side"].to_numpy()
    s = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SAMPLES)
    least = int(np.ceil(CANDIDATE * SAMPLES))
    ends = np.append(starts[1:], len(ids))
    size = ends - starts
    two = starts[size == 2]
    two = two[(s[two] == s[two + 1]).sum(1) >= least]
    labels = np.arange(len(ids))
    labels[two + 1] = two
    for a, z in zip(starts[size > 2], ends[size > 2], strict=True):
        lab = None
        # sides come in order
        split = a + int((side[a:z] == 0).sum())
        low = split if split < z else a
        for i in range(a, split, 1024):
            rows = s[i : min(i + 1024, split)]
            p, q = np.nonzero(_agree(rows, s[low:z]) >= least)
            lab = local_labels(z - a, p + (i - a), q + (low - a), lab)
        labels[a:z] = lab + a if lab is not None else labels[a:z]
    return _edges(ids, labels)


def link_features(threshold: float) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch | None]:
    """Exact comparison within groups of (id, side, hashes, weights)."""

    def group(side: np.ndarray, hashes: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        n = len(side)
        total = np.array([w.sum() for w in weights], dtype=np.float64)
        doc = np.repeat(np.arange(n), [len(h) for h in hashes])
        _, feature, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        w = np.concatenate(weights).astype(np.float64)
        shared = count[feature] > 1
        doc, feature, w = doc[shared], feature[shared], w[shared]
        one = np.flatnonzero(side == 0)
        other = np.flatnonzero(side == 1) if side.any() else one
        label = np.arange(n)
        often = count > max(32, n // 16)
        dense = often[feature]
        column = np.cumsum(often) - 1
        d_doc, d_column, d_weight = doc[dense], column[feature[dense]], w[dense]
        n_columns = int(often.sum())
        # postings of the rarer features
        doc, feature, w = doc[~dense], feature[~dense], w[~dense]
        order = np.argsort(feature, kind="stable")
        posting_doc, posting_feature = doc[order], feature[order]
        start = np.searchsorted(posting_feature, np.arange(len(count) + 1))
        by_doc = np.searchsorted(doc, np.arange(n + 1))
        weight_of = np.zeros(n_columns)
        weight_of[d_column] = d_weight
        for a in range(0, len(one), 512):
            rows = one[a : a + 512]
            inter = np.zeros((len(rows), n))
            for c in range(0, n_columns, 2048):
                width = min(2048, n_columns - c)
                here = (d_column >= c) & (d_column < c + width)
                m = np.zeros((n, width), dtype=np.float32)
                m[d_doc[here], d_column[here] - c] = 1
                inter += (m[rows] * weight_of[c : c + width].astype(np.float32)) @ m.T
            for k, r in enumerate(rows):
                f, fw = feature[by_doc[r] : by_doc[r + 1]], w[by_doc[r] : by_doc[r + 1]]
                if len(f):
                    n_each = start[f + 1] - start[f]
                    at = np.repeat(start[f] - np.cumsum(n_each) + n_each, n_each) + np.arange(n_each.sum())
                    inter[k] += np.bincount(posting_doc[at], weights=np.repeat(fw, n_each), minlength=n)
            inter = inter[:, other]
            near = inter >= threshold * (total[rows][:, None] + total[other][None, :] - inter) - 1e-9
            p, q = np.nonzero(near & (inter > 0))
            label = local_labels(n, rows[p], other[q], label)
        return label

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        hashes = [np.frombuffer(x, dtype=np.uint32) for x in table["hashes"].to_pylist()]
        weights = [np.frombuffer(x, dtype=np.uint8) for x in table["weights"].to_pylist()]
        labels = np.arange(len(ids))
        for a, z in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            if z - a > 1 and len({*ids[a:z].tolist()}) > 1:
                labels[a:z] = group(side[a:z], hashes[a:z], weights[a:z]) + a
        return _edges(ids, labels)

    return work


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, text_key (xxhash64 of the text), component (names the class whatever its doc_ids), class_id (its smallest doc_id), n_copies (rows with its words)."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    weights = spark.sparkContext.broadcast(idf_weights(base.select("text")))
    rows = common.save(sketches(base, ["doc_id", "text_key"], weights), "minhash-rows")
    # map-side first: copies collapse before they shuffle
    distinct = rows.groupBy("key1", "key2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first("n_features").alias("n_features"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    distinct = common.save(distinct.withColumn("id", F.monotonically_increasing_id()), "minhash-distinct")
    banded = distinct.select("id", F.explode("bands").alias("bucket"))
    sizes = common.save(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "minhash-buckets")
    members = banded.join(sizes, "bucket").select("id", F.col("bucket").alias("group"), F.ceil(F.col("n") / BLOCK).alias("blocks")).join(distinct.select("id", "sketch"), "id")
    candidates = common.save(components(link_groups(members, ["sketch"], link_sketches, not sizes.filter(F.col("n") > BLOCK).isEmpty(), "minhash-buckets")), "minhash-candidates")
    common.drop(sizes)
    verified = components(_verify(base, rows, distinct, candidates, weights, threshold))
    labels = common.save(distinct.select("id", "key1", "key2", "least", "n_copies").join(verified, "id", "left").withColumn("component", F.coalesce("component", "id")), "minhash-labels")
    least = labels.groupBy("component").agg(F.min("least").alias("class_id"))
    known = labels.join(least, "component").select(F.struct("key1", "key2").alias("key"), "component", "class_id", "n_copies")
    total = distinct.agg(F.sum("n_copies")).first()[0] or 0
    slim = rows.select("doc_id", "text_key", F.struct("key1", "key2").alias("key"))
    return common.join_hot(slim, known, "key", "n_copies", total).select("doc_id", "text_key", "component", "class_id", "n_copies")


def _verify(base: DataFrame, rows: DataFrame, distinct: DataFrame, candidates: DataFrame, weights, threshold: float) -> DataFrame:
    """Edges between candidates of the same component that are similar, at most one per document and task."""
    known = candidates.join(distinct.select("id", "key1", "key2", "n_features"), "id")
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_features").alias("n_features"))
    chosen = known.drop("n_features").join(sizes, "component")
    # one row stands for all rows of the same words: the smallest text key of the smallest doc_id
    none = F.lit(-(1 << 63))
    row_of = rows.groupBy("key1", "key2").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("d"), F.col("text_key").alias("k"))).alias("r"))
    chosen = common.save(chosen.join(row_of, ["key1", "key2"]).select("id", "component", "n", "n_features", F.col("r.d").alias("d"), F.col("r.k").alias("text_key")), "minhash-chosen")
    # the same plan at every size: texts meet the rows chosen by a merge join, never by a broadcast of them
    texts = base.select(F.coalesce("doc_id", none).alias("d"), "text_key", "text").join(chosen.hint("merge"), ["d", "text_key"])

    def make():
        sh, w = Shingler(), weights.value

        def run(texts):
            got = [features(sh.shingles(sh.words(t)), w) for t in texts]
            return [[(f >> U64(32)).astype(np.uint32).tobytes() for f, _ in got], [x.astype(np.uint8).tobytes() for _, x in got]]

        return run

    data = common.scan(texts, ["id", "component", "n", "n_features"], ["text"], [T.StructField("hashes", T.BinaryType()), T.StructField("weights", T.BinaryType())], make)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_features") / BLOCK_FEATURES))
    members = data.select("id", F.col("component").alias("group"), blocks.alias("blocks"), "hashes", "weights")
    any_large = not chosen.filter((F.col("n") > BLOCK) | (F.col("n_features") > BLOCK_FEATURES)).isEmpty()
    return link_groups(members, ["hashes", "weights"], link_features(threshold), any_large, "minhash-components")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, one per class: the smallest doc_id; of equal rows one."""
    c = classes(docs, threshold)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key")))
    d, k, n = common.free(docs.columns, "dedup_id", "dedup_key", "dedup_n")
    kept = c.groupBy("component").agg(best.alias("b")).select(F.coalesce("b.doc_id", F.lit(-(1 << 63))).alias(d), F.col("b.text_key").alias(k))
    keyed = docs.withColumns({d: F.coalesce("doc_id", F.lit(-(1 << 63))), k: F.xxhash64(F.coalesce("text", F.lit("")))})
    # of rows that differ in other columns alone the one with the least digest stays, whatever the run
    one = W.partitionBy(d, k).orderBy(common.row_hash(docs))
    chosen = keyed.join(kept, [d, k], "left_semi").withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1)
    return chosen.select(*common.same(docs))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "n_copies")
