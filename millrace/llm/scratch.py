"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Where the tables of table() lie, by their frames.
_AT: dict[int, tuple[str, DataFrame]] = {}


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder of its own; on a cluster the setting is required."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return f"{root(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later plans start from
    the files, so a lost executor costs nothing that came before."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _AT[id(made)] = path, made
    return made


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove the files of a table() that no plan reads any more."""
    path, _ = _AT.pop(id(df), (None, None))
    if path:
        delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written here, once its results are stored elsewhere."""
    _AT.clear()
    delete(spark, f"{root(spark)}/millrace/{spark.sparkContext.applicationId}")
