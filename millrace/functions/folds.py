"""Rules in which each row depends on the last one that was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apart(df: DataFrame, keys: list[str], order: list[str], micros: int) -> DataFrame:
    """Of each key's rows in ``order`` (a time, then an id) those more than ``micros`` after the last one that was kept;
    dropped rows do not prolong the wait.

    A row that comes that much after the one before it is kept in any case, so rows are first cut into bursts at such
    gaps; only within a burst are they gone through in order."""
    row = F.struct(*df.columns).alias("row")
    at = F.unix_micros(F.col(order[0]).cast("timestamp")).alias("at")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], row, at, *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    names, by = [f"k{i}" for i in range(len(keys))], Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy(*[f"o{i}" for i in range(len(order))])
    gap = F.col("at") - F.lag("at").over(by)
    cut = rows.withColumn("new", F.when(gap <= micros, 0).otherwise(1)).withColumn("burst", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("at", *[f"o{i}" for i in range(1, len(order))], "row")
    bursts = cut.groupBy(*names, "burst").agg(F.array_sort(F.collect_list(item), lambda a, b: _compare(a, b, ["at", *[f"o{i}" for i in range(1, len(order))]])).alias("items"))
    none = F.slice("items", 1, 0)
    start = F.struct(F.lit(None).cast("long").alias("last"), none.alias("kept"))
    step = lambda a, x: F.when(a["last"].isNull() | (x["at"] - a["last"] > micros), F.struct(x["at"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return bursts.select(F.explode(F.aggregate("items", start, step, lambda a: a["kept"])).alias("item")).select("item.row.*")


def _compare(a, b, fields: list[str]):
    out = F.lit(0)
    for f in reversed(fields):
        out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
    return out
