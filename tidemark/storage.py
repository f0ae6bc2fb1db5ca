"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where set; on a local master without it, one of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None)
        if folder is None:
            folder = shared_folder.own = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that still read them must be saved before."""
    fs, at = file_system(spark, own_folder(spark))
    fs.delete(at, True)


def version_of(spark: SparkSession, path: str) -> int:
    """Changes when a file or a folder's files do: from their names, lengths and times."""
    fs, at = file_system(spark, path)
    status = fs.getFileStatus(at)
    files = list(fs.listStatus(at)) if status.isDirectory() else [status]
    return hash(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))


_kept: dict[tuple, tuple[str, StructType]] = {}


def shared_table(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives for a source, written once for all queries of the application.

    It is made anew when the source's files have changed, or the written table was cleared.
    """
    key = (spark.sparkContext.applicationId, name, source, version_of(spark, source))
    if key in _kept:
        path, schema = _kept[key]
        fs, at = file_system(spark, f"{path}/_SUCCESS")
        if fs.exists(at):
            return spark.read.schema(schema).parquet(path)
    df = make()
    path = new_path(spark, name)
    df.write.option("compression", "snappy").parquet(path)
    _kept[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "snappy").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote, once nothing that is still to be computed reads it."""
    path = getattr(df, "written_path", None)
    if path:
        fs, at = file_system(df.sparkSession, path)
        fs.delete(at, True)
