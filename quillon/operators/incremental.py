"""Merges of new rows into a table, as pure functions of old and new rows. Columns are matched by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SchemaMismatch(ValueError):
    """New rows lack columns of the table, or bring others."""


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """new with old's columns, order and types."""
    if set(old.columns) != set(new.columns):
        raise SchemaMismatch(f"table has {sorted(old.columns)}, new rows have {sorted(new.columns)}")
    return new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in old.schema])


def high_watermark(df: DataFrame, column: str) -> DataFrame:
    """max_date: one row."""
    return df.agg(F.max(F.col(column).cast("date")).alias("max_date"))


def newer(old: DataFrame, new: DataFrame, column: str, mark) -> DataFrame:
    """The distinct new rows above the watermark; all of them without one."""
    new = aligned(old, new)
    return (new if mark is None else new.where(F.col(column) > F.lit(mark))).distinct()


def append_newer(old: DataFrame, new: DataFrame, column: str, mark) -> DataFrame:
    return old.unionByName(newer(old, new, column, mark))


def overlap_replace(old: DataFrame, new: DataFrame, column: str, mark) -> DataFrame:
    """Old rows from the watermark on give way to the distinct new rows from it on.

    Old rows with a null watermark stay; new ones are not taken. Without a watermark all distinct new rows are added.
    """
    new = aligned(old, new)
    if mark is None:
        return old.unionByName(new.distinct())
    kept = old.where((F.col(column) < F.lit(mark)) | F.col(column).isNull())
    return kept.unionByName(new.where(F.col(column) >= F.lit(mark)).distinct())


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a new row of the same key, and the distinct new rows. Null keys match each other."""
    new = aligned(old, new).distinct()
    ids = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.join(ids, same, "left_anti").unionByName(new)
