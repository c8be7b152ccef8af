"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding lower-cases, strips accents, maps homoglyphs and digit substitutions to letters and all else to blanks.
The lexicon has words and word beginnings (of PREFIXES letters, or a whole word that longer ones begin with), learned from at most SAMPLE labelled documents (the smallest by hash of
doc_id, whole texts) by greedy multi-cover of the toxic ones; their weights are log odds. Hits inside an exception
phrase do not count. A logistic curve over the hit weight and its density per word gives the score.

Cases: a null text is empty; empty texts get the score of a text without hits; labels that are null or whose
doc_id is held out are never learned; where labels of a doc_id differ the larger counts; without any toxic label
every score is 0.01; repeated rows score alike; other columns pass drop_toxic() untouched.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .langid import held_out

SAMPLE = 8000
COVER = 3
LEAST_GAIN, LEAST_ODDS = 2, 1.5
NO_HIT = -0.405
"""A lexicon finds nothing in a text without hits, so it never calls one toxic: its score is at most 0.4, also where all labels are toxic."""
PREFIXES = (4, 5, 6, 7, 8)

# Lookalikes of a-z that have no decomposition, and substitutions by digits and signs.
HOMOGLYPHS = {
    "a": "аαɑ4@", "b": "ЬвЪ8", "c": "сϲ¢", "d": "ԁɗ", "e": "еєε3", "g": "ɡ9", "h": "һн", "i": "іιı1!|", "j": "јʝ",
    "k": "кκ", "l": "ӏł", "m": "м", "n": "пη", "o": "оοσø0", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ5$", "t": "тτ7",
    "u": "υս", "v": "ѵν", "w": "ԝωшա", "x": "хχ×", "y": "уγ", "z": "ᴢ2",
}

# Words of abuse that are in the lexicon from the start, unless the labels speak against them.
SEEDS = (
    "idiot idiots moron morons imbecile stupid dumb dumbass fool jerk loser losers scum trash garbage filth pathetic worthless disgusting vermin "
    "clown creep coward degenerate freak parasite pig rat retard scumbag slut whore bastard bitch asshole asshat shithead fuck fucker fucking shit "
    "vollidiot dummkopf arschloch trottel abschaum dreckskerl missgeburt connard salaud imbecile abruti ordure estupido imbecil cabron basura gilipollas"
).split()
SEED_WEIGHT = 3.0

EXCEPTIONS = ("trash can", "trash bin", "trash folder", "clown fish", "class clown", "sore loser", "idiot proof", "pathetic fallacy", "pond scum")


class Folding(dict):
    """A table for str.translate that fills itself."""

    def __init__(self):
        super().__init__({ord(c): k for k, v in HOMOGLYPHS.items() for c in v})

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c).lower()
        out = "".join(x if "a" <= x <= "z" else self.get(ord(x), "") for x in base if not unicodedata.combining(x))
        self[code] = out = "ss" if c == "ß" else out or " "
        return out


NOT_LETTERS = re.compile(r"[\W\d_]+")
PLAIN = "\x02"


def folded(text: str | None, table: Folding) -> str:
    """Folded words with one blank before, between and after; one blank if there is none.

    Words with letters beyond a-z follow unfolded, between PLAIN marks: an accent may be all that tells two words apart.
    """
    lower = (text or "").lower()
    line = f" {' '.join(lower.translate(table).split())} ".replace("  ", " ")
    if lower.isascii():
        return line
    plain = PLAIN.join(w for w in NOT_LETTERS.sub(" ", lower).split() if not w.isascii())
    return f"{line}{PLAIN}{plain}{PLAIN}" if plain else line


def terms(line: str) -> set[str]:
    """Words as ` word ` and beginnings as ` begin`; unfolded ones with PLAIN for a blank."""
    out = set()
    parts = line.split(PLAIN, 1)
    for mark, words in ((" ", parts[0].split()), (PLAIN, parts[1].split(PLAIN) if len(parts) > 1 else [])):
        for w in set(words) - {""}:
            out.add(f"{mark}{w}{mark}")
            out.update(f"{mark}{w[:k]}" for k in PREFIXES if len(w) >= k)
            out.add(f"{mark}{w}")
    return out


def n_words(line: str) -> int:
    return max(0, line.split(PLAIN, 1)[0].count(" ") - 1)


def automaton(weights: dict[str, float], exceptions: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, w in weights.items():
        a.add_word(term, (len(term), w))
    for e in exceptions:
        a.add_word(f" {e} ", (len(e) + 2, None))
    if len(a):
        a.make_automaton()
    return a


def hits(line: str, a) -> tuple[float, int]:
    """Sum of the largest weight at each word start outside exceptions, and their number."""
    if not len(a):
        return 0.0, 0
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in a.iter(line):
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        elif at.get(start, 0.0) < w:
            at[start] = w
    if spared:
        covered = np.zeros(len(line), dtype=bool)
        for s, e in spared:
            covered[s:e] = True
        at = {s: w for s, w in at.items() if not covered[s]}
    return sum(at.values()), len(at)


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, n_toxic, n_clean) over the sample: counted within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = Folding(), {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(y > 0)].update(terms(folded(text, table)))
        for y, c in seen.items():
            keys = list(c)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([y] * len(part), pa.int64()), pa.array([c[t] for t in part], pa.int64())], names=["term", "y", "n"])

    rows = sample.select("text", "toxic").mapInArrow(run, "term string, y long, n long")
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    return rows.groupBy("term").agg(n(1).alias("n_toxic"), n(0).alias("n_clean"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS):
    """(weights by term, exceptions, coefficients of the logistic curve)."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = common.save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    n = {int(y > 0): 0 for y in (0, 1)} | {r[0]: r[1] for r in picked.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        common.drop(picked)
        return {}, exceptions, np.array([np.log(0.01 / 0.99), 0.0, 0.0, 0.0])
    odds = F.log((F.col("n_toxic") + 0.5) / (n1 + 1)) - F.log((F.col("n_clean") + 0.5) / (n0 + 1))
    counts = _term_counts(picked).withColumn("odds", odds)
    seeds = {f" {w} ": SEED_WEIGHT for w in SEEDS}
    for r in counts.filter(F.col("term").isin(list(seeds))).collect():
        # what the labels say of a seed counts, with the seed's weight as one more witness
        seeds[r["term"]] = float(r["odds"]) + 1.0
    # a term of one document can tell nothing; all others are weighed by the cover
    top = counts.filter((F.col("n_toxic") >= 2) & (F.col("odds") >= LEAST_ODDS)).orderBy("term").collect()
    names, weight = [r["term"] for r in top], {r["term"]: float(r["odds"]) for r in top}
    names += [t for t in seeds if t not in weight]
    weight = seeds | weight
    index = {t: i for i, t in enumerate(names)}

    def make():
        table = Folding()

        def run(texts):
            lines = [folded(t, table) for t in texts]
            return [[sorted(index[t] for t in terms(x) if t in index) for x in lines], [n_words(x) for x in lines]]

        return run

    rows = common.scan(picked, ["toxic"], ["text"], [T.StructField("idx", T.ArrayType(T.IntegerType())), common.long("n_words")], make).collect()
    toxic = [set(r["idx"]) for r in rows if r["toxic"] > 0]
    clean = [set(r["idx"]) for r in rows if r["toxic"] <= 0]
    lexicon = cover(toxic, clean, names)
    weights = {t: w for t, w in seeds.items() if w >= LEAST_ODDS} | {t: weight[t] for t in lexicon}
    found = _matches(picked, weights, exceptions, ["toxic"], "text").collect()
    common.drop(picked)
    x = np.array([_features(r["weight"], r["n_hits"], r["n_words"]) for r in found])
    y = np.array([float(r["toxic"] > 0) for r in found])
    return weights, exceptions, logistic(x, y)


def cover(toxic: list[set[int]], clean: list[set[int]], names: list[str]) -> list[str]:
    """Greedy choice of terms until none would raise the cover, up to COVER, of two toxic documents more than thrice its clean ones.

    Of a word and its beginnings one is chosen. Gains only fall as terms are taken, so a heap of stale gains gives the best.
    """
    holders: dict[int, list[int]] = {}
    for d, s in enumerate(toxic):
        for i in s:
            holders.setdefault(i, []).append(d)
    against = Counter(i for s in clean for i in s)
    covered, out, taken, starts = np.zeros(len(toxic), dtype=int), [], set(), set()
    at = {i: np.array(ds) for i, ds in holders.items()}
    # of equally good terms the longest: a beginning is chosen only if it covers more than a word
    by_name = {i: r for r, i in enumerate(sorted(holders, key=lambda i: (len(holders[i]), len(names[i]), names[i]), reverse=True))}
    gain = lambda i: int((covered[at[i]] < COVER).sum()) - 3 * against[i]
    heap = [(-gain(i), by_name[i], i) for i in holders]
    heapq.heapify(heap)
    while heap:
        stale, rank, i = heapq.heappop(heap)
        now = gain(i)
        if now < LEAST_GAIN:
            continue
        if -stale != now:
            heapq.heappush(heap, (-now, rank, i))
            continue
        name = names[i]
        if name in starts or any(name[:k] in taken for k in range(1, len(name) + 1)):
            continue
        entry = name.rstrip(f" {PLAIN}") if len(name) > 9 else name
        taken.add(entry)
        starts.update(entry[:k] for k in range(1, len(entry) + 1))
        out.append(name)
        covered[at[i]] += 1
    return out


def _features(s: float, k: int, words: int) -> list[float]:
    """Constant, weight, weight per word, and whether a hit is not the only one."""
    return [1.0, float(np.log1p(s)), float(np.log1p(100.0 * s / max(words, 20))), float(min(k, 3))]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _matches(docs: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...], keep: list[str], text: str) -> DataFrame:
    """Columns `keep`, weight, n_hits and n_words of each text."""

    def make():
        table, a = Folding(), automaton(weights, exceptions)

        def run(texts):
            out = [[], [], []]
            for t in texts:
                line = folded(t, table)
                s, k = hits(line, a)
                for column, v in zip(out, (s, k, n_words(line)), strict=True):
                    column.append(v)
            return out

        return run

    return common.scan(docs, keep, [text], [common.double("weight"), common.long("n_hits"), common.long("n_words")], make)


def score(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, n_hits and score."""
    weights, exceptions, coef = model
    keep = keep or ["doc_id"]
    m = _matches(docs, weights, exceptions, keep, text)
    one, by_weight, by_density, by_number = (float(c) for c in coef)
    density = 100.0 * F.col("weight") / F.greatest(F.col("n_words"), F.lit(20))
    z = one + by_weight * F.log1p("weight") + by_density * F.log1p(density) + by_number * F.least(F.col("n_hits"), F.lit(3))
    z = F.when(F.col("n_hits") == 0, F.least(z, F.lit(NO_HIT))).otherwise(z)
    return m.select(*[F.col(f"`{c}`") for c in keep], "n_hits", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def drop_toxic(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose score is below the threshold."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select([c.alias(n) for c, n in zip(common.same(docs), names, strict=True)])
    text = next(n for n, c in zip(names, docs.columns, strict=True) if c.lower() == "text")
    kept = score(plain, model, text, names).filter(F.col("score") < threshold)
    return kept.select([F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
