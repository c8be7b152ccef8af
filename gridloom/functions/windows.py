"""Window specifications by track. Functions, since a specification needs a running session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scratch import cut


def by_track() -> WindowSpec:
    return Window.partitionBy("track_id")


def by_bar() -> WindowSpec:
    return by_track().orderBy("bar")


def by_time() -> WindowSpec:
    return by_track().orderBy("t")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with `name`, the place of each row from 0 in order of `by`: numbered within ranges, whose sizes are one small table.

    No task sorts the whole table. Ties are numbered by a hash of their rows, so that reruns agree; equal rows are alike.
    """
    tie = F.xxhash64(F.to_json(F.struct(*df.columns)))
    ranged = cut(df.withColumn("_tie", tie).repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by, "_tie")) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(below), "_range").withColumn(name, F.col("_below") + F.col("_inside")).drop("_range", "_inside", "_below", "_tie")
