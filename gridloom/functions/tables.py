"""Python table functions and aggregates for SQL: a polymorphic one over partitions, and one over Arrow arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Runs:
    """runs(TABLE(t), key => 'k', place => 'p', value => 'v'): stretches of equal values along `place` within each key.

    The result has the types of the given columns. Rows stream by in order; one stretch is held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, place: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (key.value, place.value, value.value):
            if name not in kinds:
                raise ValueError(f"runs: the table has no column {name}")
        k, p, v = kinds[key.value], kinds[place.value], kinds[value.value]
        out = T.StructType([T.StructField("key", k), T.StructField("value", v), T.StructField("first", p), T.StructField("last", p), T.StructField("n", T.LongType())])
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(place.value)])

    def __init__(self):
        self.run = None

    def eval(self, rows, key: str, place: str, value: str):
        k, p, v = rows[key], rows[place], rows[value]
        if self.run is not None and self.run[1] == v:
            self.run[3], self.run[4] = p, self.run[4] + 1
        else:
            if self.run is not None:
                yield tuple(self.run)
            self.run = [k, v, p, p, 1]

    def terminate(self):
        if self.run is not None:
            yield tuple(self.run)


def trimmed_mean(x: pd.Series) -> float:
    """Mean of the middle eight tenths; of all where that is nothing."""
    s = x.dropna().sort_values()
    cut = len(s) // 10
    middle = s.iloc[cut : len(s) - cut]
    return float(middle.mean()) if len(middle) else float("nan")


def register(spark: SparkSession) -> list[str]:
    spark.udtf.register("runs", F.udtf(Runs))
    spark.udf.register("trimmed_mean", F.pandas_udf(trimmed_mean, "double"))
    return ["runs", "trimmed_mean"]
