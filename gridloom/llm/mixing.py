"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

The rates r of documents minimise sum r*log(r) under one token constraint per source, sum r*size = target, and
r <= MAX_COPIES. The dual is convex and separable: r = min(MAX_COPIES, exp(lambda*size)) with one lambda per
source, found by Newton's method kept inside a bracket. Documents of a source are summed up first in bins of
sizes within 1/64 octave (at most about 2,000 bins for any corpus), so each Newton step reads bins, not
documents, and all sources step at once on the executors. Rates are rounded to whole copies: each bin repeats
all its documents floor(r) times and as many of them once more as leaves the smallest error in words, carried
from the largest sizes to the smallest; which ones is decided by a hash of the document.

Cases: a null text has size 0 and takes nothing; a null source is a source of its own, the last; an empty table or one
without words takes nothing; a source without words has target 0; equal rows are interchangeable and the counts
of their copies are fixed; ties fall by hash; other columns pass take() untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BINS_PER_OCTAVE = 64
SALTS = 4096
STEPS = 80


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """rows with `ordinal`, their place from 0 in the order: numbered within ranges, which are counted in one small table."""
    ranged = common.save(rows.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mixing-ranges")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("place", place).join(F.broadcast(offsets), "range").withColumn("ordinal", F.col("place") + F.col("offset")).drop("range", "place", "offset")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """sources (source, is_null, source_size) with weight and target.

    Weights repeat in code point order, null last. The level c with sum(min(most*size, c*weight)) = total is found
    by raising it until no further source is full: Newton's method on a concave sum, which needs a few rounds, each one
    aggregate of two numbers.
    """
    ordered = numbered(sources, F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ordered = common.save(ordered.withColumn("weight", w), "mixing-sources")
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        full = F.col("weight") * level >= most * F.col("source_size")
        used, open_weight = ordered.agg(F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (total - (used or 0)) / open_weight
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return ordered.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")).cast("double"))


def bin_of(size: Column) -> Column:
    return F.when(size <= 0, F.lit(-1)).otherwise(F.floor(F.log2(size.cast("double")) * BINS_PER_OCTAVE)).cast("int")


def balance(bins: Column, target: Column, most: int = MAX_COPIES) -> Column:
    """lambda of one source, per mean document size, by bracketed Newton steps over its bins (x, words).

    A bin's x is its mean size over that of the source, so the tilted words of a bin are words*exp(lambda*x).
    """
    zero = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("d"))

    def tilted(lam: Column) -> Column:
        def add(s: Column, b: Column) -> Column:
            r = F.exp(F.least(lam * b["x"], F.lit(50.0)))
            return F.struct((s["f"] + b["words"] * F.least(r, F.lit(float(most)))).alias("f"), (s["d"] + F.when(r < most, b["words"] * b["x"] * r).otherwise(0.0)).alias("d"))

        return F.aggregate(bins, zero, add)

    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))

    def step(s: Column, _: Column) -> Column:
        lam = s["lam"]

        def after(t: Column) -> Column:
            error = t["f"] - target
            low = F.when(error <= 0, lam).otherwise(s["low"])
            high = F.when(error >= 0, lam).otherwise(s["high"])
            newton = lam - error / F.greatest(t["d"], F.lit(1e-12))
            # outside the bracket, or too far for one step of an exponential: halve the bracket or go a bounded way
            wide = F.greatest(F.least(newton, lam + 4.0 + F.abs(lam)), lam - 4.0 - F.abs(lam))
            inside = F.when((wide > low) & (wide < high), wide).otherwise((low + high) / 2)
            return F.struct(F.when(F.abs(error) <= 1e-9 * (target + 1), lam).otherwise(inside).alias("lam"), low.alias("low"), high.alias("high"))

        return F.get(F.transform(F.array(tilted(lam)), after), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["lam"]


def copies_by_bin(bins: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """bins (source_key, bin, docs, words) joined with target: adds `whole`, copies of every document, and `more`, the number of documents with one copy more."""
    per = (
        bins.groupBy("source_key")
        .agg(F.sum("words").alias("source_size"), F.sum("docs").alias("source_docs"), F.first("target").alias("target"), F.collect_list(F.struct("bin", "docs", "words")).alias("b"))
        .filter(F.col("source_size") > 0)
    )
    mean = F.col("source_size") / F.col("source_docs")
    # from the largest sizes to the smallest
    ordered = F.transform(
        F.reverse(F.array_sort("b")),
        lambda b: F.struct(b["bin"].alias("bin"), b["docs"].alias("docs"), b["words"].cast("double").alias("words"), (b["words"] / b["docs"] / mean).alias("x")),
    )
    # Rows pass a stage of their own, so that the fold over 80 steps runs once per source.
    solved = per.withColumn("b", ordered).withColumn("lam", F.when(F.col("target") >= most * F.col("source_size"), F.lit(1e9)).otherwise(balance(F.col("b"), F.col("target"), most)))
    solved = common.save(solved.repartition("source_key"), "mixing-rates")
    start = F.expr("named_struct('carry', CAST(0 AS DOUBLE), 'out', CAST(array() AS array<struct<bin: int, whole: bigint, more: bigint, rate: double>>))")

    def put(s: Column, b: Column) -> Column:
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * b["x"], F.lit(50.0))))
        whole = F.floor(rate).cast("long")
        each = b["words"] / b["docs"]
        wanted = b["words"] * (rate - whole) + s["carry"]
        more = F.when((b["words"] <= 0) | (whole >= most), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(b["docs"], F.round(wanted / F.greatest(each, F.lit(1e-9)))))).cast("long")
        row = F.struct(b["bin"].alias("bin"), whole.alias("whole"), more.alias("more"), rate.alias("rate"))
        return F.struct((wanted - more * each).alias("carry"), F.concat(s["out"], F.array(row)).alias("out"))

    return solved.select("source_key", F.explode(F.aggregate("b", start, put)["out"]).alias("r")).select("source_key", "r.*")


def mix(docs: DataFrame, key: Column, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies), one row per row of docs; `key` names the documents."""
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(5))
    sized = docs.select(key.alias("key"), F.col("source"), size_of(F.col("text")).alias("size"), tie.alias("tie"))
    # null and the empty string stay apart
    source_key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    # rows of one key are dealt too: a null key may name many
    salt = F.pmod(F.xxhash64("key", "size", "tie"), F.lit(SALTS)).cast("int")
    rows = common.save(sized.withColumns({"source_key": source_key, "bin": bin_of(F.col("size")), "salt": salt}), "mixing-sizes")
    salted = common.save(rows.groupBy("source_key", "source", "bin", "salt").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")), "mixing-bins")
    sources = salted.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    goal = common.save(targets(sources, weights).select("source_key", "source_size", "target"), "mixing-targets")
    bins = salted.groupBy("source_key", "bin").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    plan = copies_by_bin(bins.join(goal.select("source_key", "target"), "source_key"))
    # the documents of a bin that get one copy more are dealt over its salts in proportion, without any random choice
    running = W.partitionBy("source_key", "bin").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)
    whole_bin = W.partitionBy("source_key", "bin")
    dealt = (
        salted.join(plan, ["source_key", "bin"], "left")
        .withColumns({"upto": F.sum("docs").over(running), "all": F.sum("docs").over(whole_bin)})
        .withColumn("share", F.floor(F.col("upto") * F.col("more") / F.col("all")) - F.floor((F.col("upto") - F.col("docs")) * F.col("more") / F.col("all")))
        .join(goal, "source_key")
        .select("source_key", "bin", "salt", "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("share", F.lit(0)).alias("share"), F.coalesce("rate", F.lit(0.0)).alias("rate"))
    )
    dealt = common.save(dealt, "mixing-dealt")
    among = W.partitionBy("source_key", "bin", "salt").orderBy(F.xxhash64("key", F.lit(1)), "key", "tie")
    ranked = rows.withColumn("place", F.row_number().over(among)).join(dealt, ["source_key", "bin", "salt"])
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("place") <= F.col("share")).cast("long")).otherwise(0)
    return ranked.select("key", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = mix(docs, F.col("doc_id"))
    return out.select(F.col("key").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "rate")


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; all columns."""
    row, place, copies, i = common.free(docs.columns, "mix_row", "mix_place", "mix_copies", "mix_i")
    parts = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), common.row_hash(docs).cast("string"))
    same = W.partitionBy(row).orderBy(row)
    keyed = docs.withColumn(row, F.sha2(F.concat_ws(":", *parts), 256))
    plan = mix(keyed.select(row, "source", "text"), F.col(row), weights).select(F.col("key").alias(row), F.col("copies").alias(copies))
    # equal rows share a key; the sum of their copies goes to one of them
    plan = plan.groupBy(row).agg(F.sum(copies).alias(copies)).filter(F.col(copies) > 0)
    once = keyed.withColumn(place, F.row_number().over(same)).filter(F.col(place) == 1)
    return once.join(plan, row).select(*common.same(docs), F.explode(F.sequence(F.lit(1), F.col(copies))).alias(i)).drop(i)
