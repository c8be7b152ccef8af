"""Sinks that leave all or nothing: Python data source writers that stage files per task and move them when the job commits.

Every task attempt writes to a folder of its own below the target; what it returns names its files. Only files of attempts that
Spark commits are moved into place, each by one rename, and the staging folder goes in any case: a task that is lost, retried
or doubled leaves nothing. The target may be on any file system that pyarrow reaches and all executors share.
"""

from __future__ import annotations

import io
import re
import uuid
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

DONE = "_SUCCESS"


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+:", path) else f"file://{path}")


class StagedWriter(DataSourceWriter):
    """Writes (name, bytes) of each group of rows; `encode` turns an iterator of rows into those, one group after another."""

    def __init__(self, path: str, overwrite: bool, encode: Callable[[Iterator], Iterator[tuple[str, bytes]]]):
        self.path, self.overwrite, self.encode = path.rstrip("/"), overwrite, encode
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        store, staging = _open(self.staging)
        mine, files = f"{staging}/{uuid.uuid4().hex}", []
        store.create_dir(mine, recursive=True)
        for k, (name, data) in enumerate(self.encode(rows)):
            with store.open_output_stream(f"{mine}/{k}") as out:
                out.write(data)
            files.append((f"{mine}/{k}", name))
        return Staged(files)

    def commit(self, messages: list) -> None:
        store, target = _open(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("one name came from two tasks: rows of a name belong into one partition")
        old = [] if not self.overwrite else [i.path for i in store.get_file_info(fs.FileSelector(target, allow_not_found=True)) if i.is_file and i.base_name not in {*names, DONE}]
        for staged, name in files:
            store.move(staged, f"{target}/{name}")
        for path in old:
            store.delete_file(path)
        with store.open_output_stream(f"{target}/{DONE}"):
            pass
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, staging = _open(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


def _clips(rows: Iterator) -> Iterator[tuple[str, bytes]]:
    """16-bit WAV files of neighbouring chunks of one clip; one clip at a time is held, as the bytes of its file."""
    name, parts, shape = None, [], (0, 0)

    def file() -> tuple[str, bytes]:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(shape[1])
            w.setsampwidth(2)
            w.setframerate(shape[0])
            w.writeframes(b"".join(parts))
        return f"{name}.wav", out.getvalue()

    for r in rows:
        if r["clip"] != name:
            if name is not None:
                yield file()
            name, parts, shape = r["clip"], [], (r["rate"], r["channels"])
        x = np.asarray(r["samples"], dtype=np.float64)
        parts.append((np.clip(np.nan_to_num(x), -1.0, 1.0) * 32767).round().astype("<i2").tobytes())
    if name is not None:
        yield file()


class PcmSink(DataSource):
    """spark.dataSource.register(PcmSink); rows (clip, rate, channels, chunk, samples), chunks of a clip in order in one partition."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options["path"], overwrite, _clips)


class EntrySink(DataSource):
    """spark.dataSource.register(EntrySink); rows (key, entry): one JSON file per key."""

    @classmethod
    def name(cls) -> str:
        return "entries"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options["path"], overwrite, _entries)


def _entries(rows: Iterator) -> Iterator[tuple[str, bytes]]:
    for r in rows:
        yield f"{r['key']}.json", r["entry"].encode()


def write_clips(clips: DataFrame, path: str, overwrite: bool = False) -> None:
    """clips (clip, rate, channels, chunk, samples) as WAV files below path."""
    clips.sparkSession.dataSource.register(PcmSink)
    dealt = clips.select("clip", "rate", "channels", "chunk", "samples").repartition("clip").sortWithinPartitions("clip", "chunk")
    dealt.write.format("pcm").mode("overwrite" if overwrite else "append").save(path)


def write_entries(entries: DataFrame, path: str, overwrite: bool = False) -> None:
    """entries (key, entry), the last of equal keys by text, as one JSON file each below path."""
    entries.sparkSession.dataSource.register(EntrySink)
    entries.groupBy("key").agg(F.max("entry").alias("entry")).write.format("entries").mode("overwrite" if overwrite else "append").save(path)


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, entry) of the files below path; one that is damaged is a miss."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("key"), "value")
    parsed = text.select("key", F.try_parse_json("value").isNotNull().alias("sound"), F.from_json("value", schema).alias("entry"))
    return parsed.filter("sound AND entry IS NOT NULL").select("key", "entry")
