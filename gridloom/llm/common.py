"""Shared pieces of the training-data operators: tables, scratch tables, text scans, skew-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1000
"""A key is hot if it holds at least 1/HOT_SHARE of all rows, so that there are at most HOT_SHARE hot keys."""

SLICE = 256
"""Rows that a text scan holds as Python objects."""

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and executors run in this process, a temporary one of our own."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _own_dir


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def free(columns: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores before it until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same(df: DataFrame) -> list[Column]:
    """The columns of df as they are, whatever their names."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of any type: those that hold maps, which have no hash, count by their JSON."""
    holds_map = lambda f: "map<" in f.dataType.simpleString()
    return F.xxhash64(*(F.to_json(F.struct(c)) if holds_map(f) else c for c, f in zip(same(df), df.schema.fields, strict=True)))


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by save() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_gridloom_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before this process
            return


def scan(
    df: DataFrame,
    keep: Iterable[str],
    inputs: Iterable[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Maps Arrow batches: columns `keep` pass through untouched, `fields` come from make()(*inputs as lists).

    make() runs once per task, so it can build automata or caches there. Nulls reach the function as None.
    """
    keep, inputs = list(keep), list(inputs)
    # mapInArrow takes columns by name, unquoted: they have plain names meanwhile
    plain = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*keep, *inputs]))}
    src = df.select(*(quoted(c).alias(n) for c, n in plain.items()))
    schema = T.StructType([*(src.schema[plain[c]] for c in keep), *(T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields))])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema]
    kept, read = [plain[c] for c in keep], [plain[c] for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        # parts of batches: Python objects of a few hundred rows at a time
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            out = f(*(b.column(c).to_pylist() for c in read))
            cols = [b.column(c) for c in kept] + [
                x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    final = [*keep, *(f.name for f in fields)]
    return src.mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, final, strict=True)))


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, small: Column | None = None) -> DataFrame:
    """left join right on key, where `weight` of right is at least the number of left rows of that key.

    Keys with at least 1/HOT_SHARE of `total` rows number HOT_SHARE at most, so their rows of `right`
    are broadcast; the others shuffle, and none of them can fill a partition. No row is dropped.
    `small` is a condition that bounds the bytes of a row, where rows of `right` may be long.
    """
    is_hot = F.coalesce(F.col(weight) * HOT_SHARE >= total, F.lit(False))
    if small is not None:
        is_hot &= F.coalesce(small, F.lit(False))
    hot, cold = right.filter(is_hot), right.filter(~is_hot)
    near = left.join(F.broadcast(hot), key, "inner")
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())
