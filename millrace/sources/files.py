"""Files in and out: Parquet, CSV, JSON lines, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; lines that do not parse are null in all columns but the corrupt-record one, if the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages in the column ``value``."""
    return spark.read.text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. One file only for a report whose size is bounded."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def quarantine(raw: DataFrame, good: DataFrame, keys: list[str], path: str) -> None:
    """Append the raw rows that did not get through to a table of bad records."""
    raw.join(good.select(*keys), keys, "left_anti").write.mode("append").parquet(path)
