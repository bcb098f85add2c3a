"""Intermediate tables of the operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that are not released yet, and the session that made them: results read them when they are asked for.
_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs locally, a temporary folder that is then set as such."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tape-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table. It cuts the lineage, survives lost executors, and is read again in place of
    being made again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    spark = _kept.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def released(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing reads any more."""
    for table in tables:
        _delete(table.stored_at)


def cleared() -> None:
    """Removes all that this process has in the shared folder: for when no result is read again."""
    for path in list(_kept):
        _delete(path)
