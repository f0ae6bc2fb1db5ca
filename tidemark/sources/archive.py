"""An append-only archive whose batches are all or nothing: ``df.write.format("archive")``, ``stream.writeStream.format("archive")``.

Tasks write their rows as Parquet files that nobody sees yet. The commit lists them in one
small file of the log, named by its version and put there in one step; an aborted or lost
job's files are in no list. A batch has an id (of a stream: its query's name and number), and
one whose id is in the log already is not added again, so a repeated batch leaves one copy. An
overwrite is a version that starts a new list: readers see the old one or the new one, and there
is no moment without.

Files are reached by pyarrow's file systems (local and mounted folders, HDFS, object stores). Two writers that commit at the same moment are told apart on local
and mounted file systems, where a version can be created once only; elsewhere let one job at a time write.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Every so many versions the log has the whole state, so that readers need only the versions since.
WHOLE = 32


def _at(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]
    rows: int


@dataclass
class State:
    """What a version of the archive holds: its files, and the ids of the batches that it took."""

    version: int
    files: list[str]
    batches: set[str]


class Log:
    """The versions of an archive."""

    def __init__(self, path: str):
        self.fs, self.root = _at(path)
        self.fs.create_dir(f"{self.root}/_log", recursive=True)
        self.fs.create_dir(f"{self.root}/data", recursive=True)

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(arrow_fs.FileSelector(f"{self.root}/_log"))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json"))

    def _read(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/_log/{version:020d}.json") as source:
            return json.loads(source.read())

    def state(self, version: int | None = None) -> State:
        """The archive as of a version, the last one by default."""
        versions = [v for v in self.versions() if version is None or v <= version]
        if not versions:
            return State(-1, [], set())
        changes = []
        for v in reversed(versions):
            changes.append(self._read(v))
            if changes[-1]["whole"]:
                break
        files: list[str] = []
        batches: set[str] = set()
        for change in reversed(changes):
            if change["overwrite"]:
                files = []
            files += change["files"]
            batches |= set(change["batches"])
        return State(versions[-1], files, batches)

    def commit(self, batch: str, files: list[str], overwrite: bool) -> bool:
        """Add a version, unless the batch is there already; whether it was added."""
        while True:
            now = self.state()
            if batch in now.batches:
                self.remove(files)
                return False
            version = now.version + 1
            change = {"overwrite": overwrite, "whole": False, "batches": [batch], "files": files}
            if version % WHOLE == 0:
                change = {"overwrite": True, "whole": True, "batches": sorted({*now.batches, batch}), "files": files if overwrite else now.files + files}
            if self._put(f"{self.root}/_log/{version:020d}.json", json.dumps(change).encode()):
                return True

    def _put(self, path: str, content: bytes) -> bool:
        """Create a file with all its content at once; whether it was not there before."""
        aside = f"{self.root}/_log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as out:
            out.write(content)
        if isinstance(self.fs, arrow_fs.LocalFileSystem):
            try:
                os.link(aside, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
            return True
        if self.fs.get_file_info(path).type != arrow_fs.FileType.NotFound:
            self.fs.delete_file(aside)
            return False
        self.fs.move(aside, path)
        return True

    def remove(self, files: list[str]) -> None:
        for name in files:
            at = f"{self.root}/data/{name}"
            if self.fs.get_file_info(at).type != arrow_fs.FileType.NotFound:
                self.fs.delete_file(at)

    def sweep(self) -> int:
        """Delete the files of jobs that ended without a commit, and those that an overwrite replaced; run it while none is writing. Returns their number."""
        listed = set(self.state().files)
        found = self.fs.get_file_info(arrow_fs.FileSelector(f"{self.root}/data"))
        gone = [f.base_name for f in found if f.base_name not in listed]
        self.remove(gone)
        return len(gone)


class _Sink:
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.batch = options.get("batch") or uuid.uuid4().hex
        Log(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _at(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=fs, compression="snappy")
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return _Written((name,) if out is not None else (), rows)

    def _files(self, messages: list[WriterCommitMessage | None]) -> list[str]:
        return [f for m in messages if m is not None for f in m.files]


class _BatchSink(_Sink, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        Log(self.path).commit(self.batch, self._files(messages), self.overwrite)

    def abort(self, messages) -> None:
        Log(self.path).remove(self._files(messages))


class _StreamSink(_Sink, DataSourceStreamArrowWriter):
    """An empty micro-batch adds no version."""

    def commit(self, messages, batchId) -> None:  # noqa: N803
        files = self._files(messages)
        if files or self.overwrite:
            Log(self.path).commit(f"{self.batch}-{batchId}", files, self.overwrite)

    def abort(self, messages, batchId) -> None:  # noqa: N803
        Log(self.path).remove(self._files(messages))


class Archive(DataSource):
    """path; batch: the id under which a write is taken once (of a stream: the query's lasting name, which it needs)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def writer(self, schema: StructType, overwrite: bool):
        return _BatchSink(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool):  # noqa: N802
        if not self.options.get("batch"):
            raise ValueError("a stream into an archive needs the option batch, a name that it keeps over restarts")
        return _StreamSink(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archive)


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add the rows as one batch; with an id, a repeated call adds nothing."""
    _write(df, path, "append", batch)


def replace(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Put the rows in the place of all; ``df`` may read the archive, and readers keep the version that they began with."""
    _write(df, path, "overwrite", batch)


def _write(df: DataFrame, path: str, mode: str, batch: str | None) -> None:
    register(df.sparkSession)
    out = df.write.format("archive").mode(mode).option("path", path)
    (out.option("batch", batch) if batch else out).save()


def read(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The committed rows as of a version (by default the last), by Spark's own Parquet scan."""
    log = Log(path)
    files = log.state(version).files
    if not files:
        return spark.createDataFrame([], schema)
    base = path.rstrip("/") if "://" in path else f"file://{log.root}"
    return spark.read.schema(schema).parquet(*[f"{base}/data/{f}" for f in files])
