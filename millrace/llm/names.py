"""Columns by name, whatever the name has in it, and rows that travel as one column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of this very name; dots and backticks in it mean nothing."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: Iterable[str]) -> Column:
    """The named columns as one, so that their names meet none of an operator's own. Without any it is a struct
    of one null, since a struct without fields cannot be stored."""
    names = list(names)
    return F.struct(*[column(n).alias(n) for n in names]) if names else F.struct(F.lit(None).cast("boolean").alias("none"))


def unpacked(row: str, names: Iterable[str]) -> list[Column]:
    """The named columns back from a packed row."""
    return [F.col(row).getField(n).alias(n) for n in names]


def fresh(taken: Iterable[str], stem: str) -> str:
    """A prefix that no taken name begins with."""
    prefix = stem
    while any(t.lower().startswith(prefix.lower()) for t in taken):
        prefix += "_"
    return prefix
