"""The liquid-stock universe: prices joined to metadata, filtered, with rolling dollar volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import latest_metadata, latest_prices

EXCHANGES = ("NASDAQ", "NYSE", "NYSEMKT")
CATEGORIES = ("Domestic Common Stock", "Domestic Common Stock Primary Class", "Domestic Common Stock Secondary Class")
#: Metadata up to so many rows is broadcast; more is joined by shuffle on ticker.
BROADCAST_TICKERS = 500_000

COLUMNS = [
    "ticker", "date", "exchange", "category", "sector", "industry", "scalemarketcap", "scalerevenue", "currency", "location",
    "open", "high", "low", "close", "closeadj", "volume", "dollar_volume", "adv_20", "adv_60", "n_raw_universe",
]


def by_ticker(rows: int | None = None):
    w = Window.partitionBy("ticker").orderBy("date")
    return w if rows is None else w.rowsBetween(-(rows - 1), 0)


def few(df: DataFrame, rows: int = BROADCAST_TICKERS) -> DataFrame:
    """Hints a broadcast if the counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def rolling_liquidity(panel: DataFrame) -> DataFrame:
    """adv_20, adv_60 (means over so many rows at most) and obs_60 (rows in the frame): one sort serves the three."""
    return panel.withColumns({"adv_20": F.avg("dollar_volume").over(by_ticker(20)), "adv_60": F.avg("dollar_volume").over(by_ticker(60)), "obs_60": F.count(F.lit(1)).over(by_ticker(60))})


def universe(sep: DataFrame, tickers: DataFrame, min_price: float = 5.0, min_adv: float = 1e6, min_obs: int = 60) -> DataFrame:
    """Liquid common stocks by day.

    Frames count surviving rows, sub-price days included; the price, volume and warm-up bounds come after the windows,
    and n_raw_universe counts what is left of a date. Tickers without metadata go.

    Prices are dealt by ticker once: the deduplication and the rolling windows share that exchange. Metadata is broadcast
    if its counted rows are few; the planner's estimate of a join of aggregates would broadcast the prices instead.
    """
    meta = latest_metadata(tickers).select("ticker", "exchange", "category", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"), F.coalesce("industry", F.lit("UNKNOWN")).alias("industry"), "scalemarketcap", "scalerevenue", "currency", "location")
    meta = meta.where(F.col("exchange").isin(*EXCHANGES) & F.col("category").isin(*CATEGORIES))
    few = tickers.count() <= BROADCAST_TICKERS
    prices = latest_prices(sep.repartition("ticker")).where("closeadj > 0 AND volume > 0")
    base = prices.join(F.broadcast(meta) if few else meta, "ticker").withColumns({"date": F.col("date").cast("date"), "dollar_volume": F.col("closeadj") * F.col("volume")})
    kept = rolling_liquidity(base).where((F.col("closeadj") >= min_price) & (F.col("adv_20") >= min_adv) & (F.col("obs_60") >= min_obs))
    return kept.withColumn("n_raw_universe", F.count(F.lit(1)).over(Window.partitionBy("date"))).select(COLUMNS)


def policy_universe(panel: DataFrame, min_price: float = 5.0, min_adv: float = 5e7, min_cap: float = 5e9, min_days: int = 252) -> DataFrame:
    """Eligible rows of a panel with closeadj, adv_20, market_cap and category: size, volume, price, listing age, no funds."""
    age = F.row_number().over(by_ticker())
    ok = (F.col("closeadj") >= min_price) & (F.col("adv_20") >= min_adv) & (F.col("market_cap") >= min_cap) & ~F.col("category").isin("ETF", "OTC")
    return panel.withColumn("_age", age).where(ok & (F.col("_age") > min_days)).drop("_age")
