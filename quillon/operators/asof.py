"""As-of and point-in-time joins without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, right_on: str) -> DataFrame:
    """left with, for each row, the latest row of right with the same ``by`` and ``right_on <= on``.

    Both sides are stacked and the last right row is carried forward in order: one exchange by key and one sort, instead
    of a join of every pair. right has one row for each (by, right_on). Skewed keys are as large as one key's history.
    """
    values = [c for c in right.columns if c != by]
    stacked = left.withColumns({"_t": F.col(on), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType)})
    other = right.select(F.col(by), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v")).where(f"`{by}` IS NOT NULL AND _t IS NOT NULL")
    both = stacked.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    known = F.col(on).isNotNull()
    return out.select(*left.columns, *[F.when(known, F.col(f"_v.{c}")).alias(c) for c in values])


def stacked(left: DataFrame, by: str, on: str, rights: dict[str, tuple[DataFrame, str, bool]]) -> DataFrame:
    """left with a struct for each of ``rights`` (name: frame, its ``on``, exact): the latest row known, or the row of that very day.

    All sides are stacked and carried forward in one sort. Sides dealt by ``by`` alone are not dealt again, where a join on
    (by, on) would. A right side has one row for each (by, on).
    """
    both = left.withColumn("_side", F.lit(len(rights)))
    for i, (name, (right, right_on, _)) in enumerate(rights.items()):
        values = [c for c in right.columns if c not in (by, right_on)]
        both = both.unionByName(right.where(f"`{by}` IS NOT NULL AND `{right_on}` IS NOT NULL").select(F.col(by), F.col(right_on).alias(on), F.struct(F.col(right_on).alias("_t"), *values).alias(name), F.lit(i).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(F.col(on).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in rights}).where(F.col("_side") == len(rights))
    there = {name: F.col(f"{name}._t") == F.col(on) if exact else F.col(on).isNotNull() for name, (_, _, exact) in rights.items()}
    return out.select(*left.columns, *[F.when(there[name], F.col(name)).alias(name) for name in rights])


def trailing_sum(events: DataFrame, by: str, on: str, value: str, days: list[int], name: str) -> DataFrame:
    """by, on, {name}_{d}d: sums of value over the last d calendar days, the day itself included, at each day with events.

    Events of a day are summed first, so the frame holds at most a row a day.
    """
    daily = events.groupBy(by, on).agg(F.sum(value).alias("_x"))
    day = F.datediff(F.col(on), F.lit("1970-01-01").cast("date")).cast("long")
    w = Window.partitionBy(by).orderBy(day)
    return daily.withColumns({f"{name}_{d}d": F.sum("_x").over(w.rangeBetween(-(d - 1), 0)) for d in days}).drop("_x")


def year_over_year(events: DataFrame, by: str, on: str, value: str, name: str) -> DataFrame:
    """by, on, {name}: sum of the last 365 days over the sum of the 365 before, less 1; null without the latter."""
    daily = events.groupBy(by, on).agg(F.sum(value).alias("_x"))
    day = F.datediff(F.col(on), F.lit("1970-01-01").cast("date")).cast("long")
    w = Window.partitionBy(by).orderBy(day)
    now, before = F.sum("_x").over(w.rangeBetween(-364, 0)), F.sum("_x").over(w.rangeBetween(-729, -365))
    return daily.withColumn(name, F.try_divide(now, before) - 1).drop("_x")


def disclosed(panel: DataFrame, trades: DataFrame, days: int = 90) -> DataFrame:
    """panel(ticker, date) with buy_count, sell_count and net_buy_amount of trades disclosed in the last ``days`` days.

    trades: ticker, transaction_date, disclosure_date, side (buy or sell), amount. Only the disclosure date makes a trade
    visible. Trades are summed by day and stacked on the panel; a range frame adds them up.
    """
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    daily = trades.groupBy("ticker", F.col("disclosure_date").alias("date")).agg(F.count_if(F.col("side") == "buy").alias("_b"), F.count_if(F.col("side") == "sell").alias("_s"), F.sum(sign * F.col("amount")).alias("_n"))
    both = panel.select("ticker", "date").withColumn("_p", F.lit(True)).unionByName(daily, allowMissingColumns=True)
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    w = Window.partitionBy("ticker").orderBy(day).rangeBetween(-(days - 1), 0)
    out = both.withColumns({"buy_count_90d": F.coalesce(F.sum("_b").over(w), F.lit(0)), "sell_count_90d": F.coalesce(F.sum("_s").over(w), F.lit(0)), "net_buy_amount_90d": F.coalesce(F.sum("_n").over(w), F.lit(0.0))})
    return out.where("_p").select("ticker", "date", "buy_count_90d", "sell_count_90d", "net_buy_amount_90d")
