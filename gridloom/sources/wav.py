"""WAV files as rows, without any library beyond the standard one and NumPy: a Python data source and binary decoding.

Other codecs need decoders that are not here; their files raise.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, rate int, channels int, frames long, duration double, chunk int, samples array<float>"


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, float32 samples of shape (frames, channels)) of PCM with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        n, channels, width, rate = w.getnframes(), w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = np.frombuffer(w.readframes(n), dtype=np.uint8)
    if width == 1:
        x = (raw.astype(np.float32) - 128) / 128
    elif width == 3:
        b = raw.reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = raw.view({2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return rate, x.reshape(-1, channels)


def encode(x: np.ndarray, rate: int) -> bytes:
    """16-bit PCM."""
    out = io.BytesIO()
    x = np.atleast_2d(x.T).T
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def stereo(x: np.ndarray) -> np.ndarray:
    """Two channels: a mono one twice, else the first two; channels first is turned round."""
    if x.ndim == 1:
        return np.stack([x, x], 1)
    if x.shape[0] <= 8 < x.shape[1]:
        x = x.T
    return np.repeat(x, 2, 1) if x.shape[1] == 1 else x[:, :2]


def normalize_loudness(x: np.ndarray, target_db: float = -16.0, ceiling: float = 0.98) -> np.ndarray:
    level = np.sqrt(np.mean(np.square(x, dtype=np.float64)) + 1e-12)
    y = x * min(10 ** (target_db / 20) / max(level, 1e-6), 4.0)
    peak = np.abs(y).max(initial=0.0)
    return (y * (ceiling / peak) if peak > ceiling else y).astype(np.float32)


def read_files(spark: SparkSession, path: str, chunk: int = 1 << 18) -> DataFrame:
    """Files under `path` on any Hadoop file system, cut into chunks of samples, stereo interleaved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rate, x = decode(data)
                channels, n = x.shape[1], len(x)
                x = stereo(x)
                for i in range(0, max(n, 1), chunk):
                    yield pa.RecordBatch.from_pylist([dict(path=name, rate=rate, channels=channels, frames=n, duration=n / rate, chunk=i // chunk, samples=x[i : i + chunk].ravel().tolist())], schema=ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


ARROW = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("duration", pa.float64()), ("chunk", pa.int32()), ("samples", pa.list_(pa.float32()))])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WavSource(DataSource):
    """spark.dataSource.register(WavSource); spark.read.format("wav").load(folder): one row of metadata per file.

    The folder must be one that driver and executors share as local files; read_files() reads any other store.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, rate int, channels int, frames long, duration double"

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(self.options["path"])


class _WavReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path.removeprefix("file:"), "**", "*.wav"), recursive=True))]

    def read(self, partition):
        with wave.open(partition.path) as w:
            yield partition.path, w.getframerate(), w.getnchannels(), w.getnframes(), w.getnframes() / w.getframerate()


def write_pcm(batch: DataFrame, path: str) -> None:
    """foreachBatch sink: interleaved float32 PCM chunks, one Parquet row each, under Spark's commit protocol."""
    batch.select("deck_id", "seq", F.col("samples")).write.mode("append").parquet(path)
