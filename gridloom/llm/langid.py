"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters, lower-cased, in runs joined by one blank give n-grams of 1 to 3 characters, hashed to DIMS buckets; a
document is tf*idf over its buckets, divided by their sum. Weights come from follow-the-regularised-leader with
L1 and L2 penalties per coordinate; a temperature fitted on held-back sample rows calibrates the probabilities.

idf counts all learnable documents. The classifier is fitted on at most SAMPLE of them, the smallest by hash of
doc_id, whole texts. Cases: null texts and texts without a letter are `und` with score 0; a null lang is never
learned; if nothing can be learned every row is `und`; a null doc_id is never held out nor learned; repeated rows
are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMS_BITS = 15
DIMS = 1 << DIMS_BITS
SAMPLE = 4000
ORDERS = 3
CHUNK = 1 << 20
SCALE = 40.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letters() -> np.ndarray:
    """Per code point: its own number if it is a letter, else that of a blank."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


def grams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of texts, the first of each text, and whether each text has a letter.

    Two blanks and more part the texts, so no n-gram mixes two of them.
    """
    codes = [table[np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)] for t in texts]
    has = np.array([bool((c != 32).any()) for c in codes])
    parts, starts, at = [], [], 0
    gap = np.full(ORDERS, 32, dtype=np.uint32)
    for c in codes:
        blank = c == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        c = c[keep]
        starts.append(at)
        parts += [gap, c]
        at += len(c) + ORDERS
    parts.append(gap)
    x = np.concatenate(parts)
    n = at
    out = np.empty((n, ORDERS), dtype=np.uint32)
    h = np.zeros(n, dtype=np.uint32)
    for k in range(ORDERS):
        h = (h + x[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[:, k] = (h * np.uint32(0x85EBCA6B) + np.uint32(k * 0x27D4EB2F)) >> np.uint32(32 - DIMS_BITS)
    return out, np.array(starts), has


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """df per bucket over all rows: partial counts per task, summed by bucket; DIMS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, df, n, seen = letters(), np.zeros(DIMS, dtype=np.int64), 0, np.zeros(DIMS, dtype=np.uint8)
        for b in batches:
            for part in chunks(b.column(0).to_pylist()):
                g, starts, _ = grams(part, table)
                for a, z in zip(starts, [*starts[1:], len(g)], strict=True):
                    seen[g[a:z].ravel()] = 1
                    df += seen
                    seen[:] = 0
                n += len(part)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS)
    total = 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return df, total


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (DIMS + 1, k), the last row a bias without L1. rows: buckets, values, class."""
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

    def weights(i):
        zi, ni = z[i], n[i]
        penalty = np.where(i[:, None] == DIMS, 0.0, l1)
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            sigma = (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g2
    out = np.zeros((DIMS + 1, k))
    for a in range(0, DIMS + 1, 4096):
        i = np.arange(a, min(a + 4096, DIMS + 1))
        out[i] = weights(i)
    return out


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, on a grid of ratios of 5 %."""
    if not len(y):
        return 1.0
    best = (np.inf, 1.0)
    for t in 1.05 ** np.arange(-60, 61):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        nll = float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))
        best = min(best, (nll, float(t)))
    return best[1]


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
    """(languages, idf, weights, temperature)."""
    ok = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    df, n = document_frequencies(ok.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    chosen = ok.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # where rows of a doc_id differ, the least language and text is learned, whatever the run
    one = F.min(F.struct("lang", "text")).alias("row")
    picked = ok.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(one).select("doc_id", "row.lang", "row.text")

    def make():
        table = letters()

        def run(texts):
            idx, val = [], []
            for t in texts:
                c = np.bincount(grams([t], table)[0].ravel(), minlength=DIMS)
                i = np.flatnonzero(c)
                idx.append(i.astype(np.int32))
                val.append(c[i].astype(np.int32))
            return [idx, val]

        return run

    arrays = T.ArrayType(T.IntegerType())
    got = common.scan(picked, ["doc_id", "lang"], ["text"], [T.StructField("idx", arrays), T.StructField("cnt", arrays)], make)
    rows = got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    if not langs:
        return [], idf, np.zeros((DIMS + 1, 0), dtype=np.float32), 1.0
    data = []
    for i, c, lang in zip(rows["idx"], rows["cnt"], rows["lang"].to_pylist(), strict=True):
        i = i.values.to_numpy()
        x = c.values.to_numpy() * idf[i].astype(float)
        x *= SCALE / max(x.sum(), 1e-9)
        data.append((np.append(i, DIMS).astype(np.int64), np.append(x, 1.0), langs.index(lang)))
    back = data[::5] if len(data) >= 50 else []
    fit = [d for k, d in enumerate(data) if k % 5] if back else data
    w = ftrl(fit, len(langs), epochs, alpha, beta, l1, l2)
    logits = np.array([x @ w[i] for i, x, _ in back]).reshape(len(back), len(langs))
    return langs, idf, w.astype(np.float32), temperature(logits, np.array([y for *_, y in back], dtype=int))


def predict(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred and score. Reads nothing but the text."""
    langs, idf, weights, t = model
    shared = docs.sparkSession.sparkContext.broadcast((idf, (weights[:DIMS] * idf[:, None]).T.copy(), weights[DIMS]))

    def make():
        table = letters()
        idf, wt, bias = shared.value

        def run(texts):
            pred, score = [], []
            for part in chunks(texts):
                g, starts, has = grams(part, table)
                sums = lambda v: np.add.reduceat(v[g].sum(1, dtype=np.float64), starts)
                if not langs:
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                s = (np.stack([sums(w) for w in wt], 1) * (SCALE / np.maximum(sums(idf), 1e-9))[:, None] + bias) / t
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                pred += [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                score += np.where(has, p.max(1), 0.0).tolist()
            return [pred, score]

        return run

    return common.scan(docs, keep, [text], [common.string("lang_pred"), common.double("score")], make)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
