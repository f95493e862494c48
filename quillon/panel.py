"""Stand-ins for the equity tables, made from the order tables that the queries are run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.dedup import latest_prices


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily prices with duplicates, and update stamps of which some are missing and some are no dates."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    stamp = F.when(F.col("l_orderkey") % 17 == 0, "n/a").when(F.col("l_orderkey") % 13 != 0, F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber")).cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        *[price.alias(c) for c in ("open", "high", "low", "close", "closeadj")],
        F.col("l_quantity").alias("volume"), stamp.alias("lastupdated"),
    )


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the suppliers, twice each with different dates; some of another source, without a sector, or no stocks."""
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(x) for x in ("NASDAQ", "NYSE", "NYSEMKT", "OTC", "NASDAQ")])
    base = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    versions = base.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return versions.select(
        F.when(k % 11 == 5, "SFP").otherwise("SEP").alias("table"), k.cast("string").alias("ticker"),
        F.element_at(names, ((k + F.col("v")) % 5 + 1).cast("int")).alias("exchange"),
        F.when(k % 6 == 3, "ETF").otherwise("Domestic Common Stock").alias("category"),
        F.when(k % 7 != 0, F.col("r_name")).alias("sector"), F.col("n_name").alias("industry"),
        F.lit("5 - Large").alias("scalemarketcap"), F.lit("4 - Mid").alias("scalerevenue"), F.lit("USD").alias("currency"), F.col("n_name").alias("location"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("v") * (k % 3)).cast("int")).alias("lastupdated"),
        F.when(k % 2 == 0, F.date_add(F.lit("2001-06-01").cast("date"), F.col("v"))).alias("lastpricedate"), F.date_add(F.lit("1995-01-01").cast("date"), -F.col("v")).alias("firstpricedate"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, closeadj, volume: one row a day, dealt by ticker so that windows by ticker need no further exchange."""
    return latest_prices(sep(spark, sf_dir).select("ticker", "date", "closeadj", "volume", F.col("lastupdated").try_cast("date").alias("lastupdated")).repartition("ticker")).select("ticker", "date", "closeadj", "volume")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals by customer and order date: one filing a day, dealt by ticker."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderdate").cast("date").alias("datekey"), "o_orderkey", F.col("o_totalprice").alias("p")).repartition("ticker")
    one = o.groupBy("ticker", "datekey").agg(F.max(F.struct("o_orderkey", "p")).alias("x")).select("ticker", "datekey", "x.*")
    p, k = F.col("p"), F.col("o_orderkey")
    return one.select("ticker", "datekey", p.alias("revenue"), (p * 0.4).alias("grossprofit"), (p * 0.2).alias("opinc"), (p * (k % 7 - 2) / 10).alias("netinc"), (p * 2).alias("assets"), F.when(k % 5 != 0, p).otherwise(0.0).alias("equity"), (p * 1.5).alias("invcap"), (p * (k % 3)).alias("debt"), (p * 0.1).alias("fcf"))


def daily_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios for three in four ticker days; some are 0."""
    df = prices(spark, sf_dir).where(F.col("volume") % 4 != 0)
    c, v = F.col("closeadj"), F.col("volume")
    return df.select("ticker", "date", F.when(v % 3 == 0, 0.0).otherwise(c / 100).alias("pe"), (c / 50).alias("ps"), (c / 20).alias("pb"), (v - 7).alias("evebit"), (v + 1).alias("evebitda"), (c * 1000).alias("market_cap"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosed trades: orders, made public 45 days later."""
    o = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").cast("string").alias("ticker"), day.alias("transaction_date"), F.date_add(day, 45).alias("disclosure_date"), F.when(F.col("o_orderkey") % 3 == 0, "sell").otherwise("buy").alias("side"), F.col("o_totalprice").alias("amount"))
