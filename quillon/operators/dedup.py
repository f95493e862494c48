"""Latest row of each key, by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: dict[str, Column]) -> DataFrame:
    """One row for each key: the largest by ``order`` (descending, nulls last), then by all other columns.

    The largest struct is taken by an aggregate, not by a numbered window: it combines before the shuffle and sorts
    nothing. Structs order nulls first, so nulls lose. Rows with a null key go.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[v.alias(f"_{k}") for k, v in order.items()], *[F.col(f"`{c}`") for c in rest])
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max(ranked).alias("_r"))
    return rows.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(df.columns)


def latest_prices(sep: DataFrame) -> DataFrame:
    """One row for each (ticker, date): last updated (text that is no date counts as null), then price, then volume."""
    return latest(sep, ["ticker", "date"], {"u": F.col("lastupdated").try_cast("date"), "c": F.col("closeadj"), "v": F.col("volume")})


def latest_metadata(tickers: DataFrame, source: str = "SEP") -> DataFrame:
    """One row for each ticker of a source table."""
    return latest(tickers.where(F.col("`table`") == source), ["ticker"], {k: F.col(k) for k in ("lastupdated", "lastpricedate", "firstpricedate")})
