"""Forward-looking labels, walk-forward splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .universe import by_ticker


def forward(panel: DataFrame, horizons: tuple[int, ...] = (5, 21)) -> DataFrame:
    """target_{h}d: return over the ticker's next h rows; winner_{h}d: 1 if positive. Null on the last h rows."""
    out = {}
    for h in horizons:
        t = ratio(F.lead("closeadj", h).over(by_ticker()), F.col("closeadj")) - 1
        out |= {f"target_{h}d": t, f"winner_{h}d": (t > 0).cast("int")}
    return panel.withColumns(out)


def excess(panel: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Stock, benchmark and excess returns over the next h rows of each series; the calendar is broadcast."""
    w = Window.orderBy("date")
    b = bench.select("date", *[(ratio(F.lead("b", h).over(w), F.col("b")) - 1).alias(f"future_spy_return_{h}d") for h in horizons])
    df = panel.join(F.broadcast(b), "date", "left").withColumns({f"future_return_{h}d": ratio(F.lead("closeadj", h).over(by_ticker()), F.col("closeadj")) - 1 for h in horizons})
    return df.withColumns({f"future_excess_return_{h}d": F.col(f"future_return_{h}d") - F.col(f"future_spy_return_{h}d") for h in horizons})


def top_decile(labelled: DataFrame, column: str) -> DataFrame:
    """top_decile: whether a row is in the first tenth of its date by ``column``; ties by ticker, null values in none."""
    w = Window.partitionBy("date", F.col(column).isNull()).orderBy(F.col(column).desc_nulls_last(), "ticker")
    return labelled.withColumn("top_decile", F.when(F.col(column).isNotNull(), F.ntile(10).over(w) == 1))


def trading_calendar(sep: DataFrame) -> DataFrame:
    """Distinct dates of the prices, ordered."""
    return sep.select(F.col("date").cast("date").alias("trading_date")).where("trading_date IS NOT NULL").distinct().orderBy("trading_date")


def calendar_index(calendar: DataFrame) -> DataFrame:
    """trading_date, idx from 1. A row a day: one partition orders some thousand rows."""
    return calendar.select("trading_date", F.row_number().over(Window.orderBy("trading_date")).alias("idx"))


def future_event(panel: DataFrame, events: DataFrame, calendar: DataFrame, days: int = 60, name: str = "future_buy") -> DataFrame:
    """Whether the ticker has an event (ticker, date) in the next ``days`` trading days, the day itself not included.

    Days are numbered by the calendar; the next event's number is carried back over a ticker's rows, so no row meets more
    than one event. Events on a day without trading count as on the next trading day.
    """
    idx = calendar_index(calendar)
    nxt = idx.select("trading_date", "idx").withColumn("prev", F.lag("trading_date").over(Window.orderBy("trading_date")))
    # Every day from the first to the last trading date with the number it counts for: as many rows as days.
    dense = nxt.select(F.explode(F.sequence(F.coalesce(F.date_add("prev", 1), "trading_date"), "trading_date")).alias("day"), "idx")
    begin = calendar.agg(F.min("trading_date")).first()[0]
    day = events.select("ticker", F.greatest("date", F.lit(begin)).alias("day")).where("ticker IS NOT NULL").distinct()
    placed = day.join(F.broadcast(dense), "day").select("ticker", F.col("idx").alias("e"), F.col("idx").alias("i"))
    rows = panel.join(F.broadcast(idx), F.col("date") == F.col("trading_date")).select(*panel.columns, F.col("idx").alias("i"))
    both = rows.withColumn("_p", F.lit(1)).unionByName(placed.withColumn("_p", F.lit(0)).distinct(), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy(F.col("i").desc()).rangeBetween(Window.unboundedPreceding, -1)
    nearest = F.min("e").over(w)
    return both.withColumn("_e", nearest).where("_p = 1").select(*panel.columns, F.coalesce(F.col("_e") - F.col("i") <= days, F.lit(False)).alias(name))


def split_by_purge(panel: DataFrame, calendar: DataFrame, train_end: int, valid_end: int, test_end: int, purge: int = 21) -> DataFrame:
    """split: train, validation or test by calendar index, with ``purge`` days left out between them; null elsewhere."""
    idx = F.broadcast(calendar_index(calendar))
    i = F.col("idx")
    split = F.when(i <= train_end, "train").when((i > train_end + purge) & (i <= valid_end), "validation").when((i > valid_end + purge) & (i <= test_end), "test")
    return panel.join(idx, F.col("date") == F.col("trading_date"), "left").withColumn("split", split).drop("trading_date", "idx")


def walk_forward(calendar: DataFrame, first_train: int, test_days: int, purge: int = 90) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end: expanding training, a gap, a test, fold after fold."""
    idx = calendar_index(calendar).withColumn("n", F.max("idx").over(Window.partitionBy()))
    fold = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - first_train - purge - 1) / test_days).cast("int")))
    folds = idx.where("idx = 1").where(F.col("n") > first_train + purge).select("n", fold.alias("fold"))
    bounds = folds.select("fold", F.lit(1).alias("a"), (F.col("fold") * test_days + first_train).alias("b"), (F.col("fold") * test_days + first_train + purge + 1).alias("c"), F.least(F.col("fold") * test_days + first_train + purge + test_days, "n").alias("d"))
    out = bounds
    for k, name in (("a", "train_start"), ("b", "train_end"), ("c", "test_start"), ("d", "test_end")):
        out = out.join(F.broadcast(idx.select(F.col("idx").alias(k), F.col("trading_date").alias(name))), k)
    return out.select("fold", "train_start", "train_end", "test_start", "test_end")


def leakage(features: DataFrame, rules: dict[str, str], prediction: str = "prediction_date") -> DataFrame:
    """source, violations: rows whose public date (a column for each source) lies after the prediction date, in one pass."""
    counts = features.agg(*[F.count_if(F.col(c) > F.col(prediction)).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))])).alias("source", "violations"))
