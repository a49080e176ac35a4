"""Session helpers: where stage tables live and how lineage is cut."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by the cluster in spark.checkpoint.dir.

    Only a local master may go without it; it then gets a temporary folder. Elsewhere a machine-local folder would lose rows, so that is an error.
    """
    folder = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused location below the application's part of the shared folder."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete every stage table of this application. Frames that still read one must not be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _SNAPSHOTS.clear()


def source_state(spark: SparkSession, folder: str) -> str:
    """Digest of the names, sizes and times of the files below a folder; a changed source gives another one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Used where one expensive result feeds several branches: the branches read
    files instead of recomputing, and a lost executor never restarts the chain.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_paths = [path]
    return out


def resting_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which from now on stands for the stage tables that it reads: to discard it is to discard them."""
    df._stage_paths = [path for t in (df, *tables) for path in vars(t).get("_stage_paths", [])]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read again, also those that a frame rests on. Other frames are passed over."""
    for df in tables:
        for name in vars(df).pop("_stage_paths", []):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SNAPSHOTS: dict[tuple[str, str, str, str], str] = {}


def snapshot(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A stage table built once per application and source folder, then read by every study.

    `build` is called the first time and again when the source's files have changed;
    other calls read the written files with the usual column pruning and filter pushdown.
    """
    key = (spark.sparkContext.applicationId, folder, name, source_state(spark, folder))
    if key in _SNAPSHOTS:
        try:
            return spark.read.parquet(_SNAPSHOTS[key])
        except AnalysisException:  # the shared folder was cleared: build the table again
            del _SNAPSHOTS[key]
    path = fresh_path(spark, name)
    rows = build(spark, folder)
    rows.write.parquet(path)
    _SNAPSHOTS[key] = path
    return spark.read.schema(rows.schema).parquet(path)
