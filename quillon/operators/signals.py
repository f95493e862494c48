"""Public-policy signals beyond bills and committees: market confirmation, lobbying, campaign flows, awards, disclosure rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, weight_of
from .asof import trailing_sum, year_over_year
from .features import YEAR, _moment, full, last_rows, returns, rsi, running
from .policy import concentration
from .universe import by_ticker, few

#: How much a kind of award tells of lasting business.
AWARD_WEIGHTS = {"definitive_contract": 1.0, "indefinite_delivery": 0.75, "grant": 0.5, "purchase_order": 0.25}

#: The day from which a row of a source may be known; of several columns the first that is there.
PUBLIC_DATES = {
    "congress_trades": ("disclosure_date",), "bill_actions": ("action_date",), "lobbying_reports": ("filing_date",),
    "campaign_contributions": ("available_date",), "federal_awards": ("publication_date", "action_date"),
}


def market_confirmation(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """panel(ticker, date, closeadj, volume) with returns, volatility, volume surge, the sector's return and the RSI's recovery.

    sectors: ticker, sector. A surge is the volume over the mean of the 20 rows before. A sector's return is the mean of its
    tickers' on the day. The recovery is the RSI's rise from its lowest value in 20 rows, as a share of 100.
    """
    c, w = F.col("closeadj"), by_ticker()
    before = w.rowsBetween(-20, -1)
    df = rsi(returns(panel))
    df = running(df, {"_n": F.col("r").isNotNull(), "_r": F.col("r"), "_rr": F.col("r") * F.col("r")})
    df = df.withColumns({f"return_{k}d": ratio(c, F.lag("closeadj", k).over(w)) - 1 for k in (20, 60, 90)} | {
        "volatility_20d": F.when(last_rows("_n", 20) == 20, F.sqrt(F.greatest(_moment(20, "_rr", "_r", "_r"), F.lit(0.0)))) * YEAR,
        "volume_surge_20d": F.when(F.count("volume").over(before) == 20, ratio(F.col("volume"), F.avg("volume").over(before))),
        "rsi_recovery_score": (F.col("rsi_14") - full(F.min("rsi_14"), "rsi_14", 20)) / 100,
    })
    df = df.join(few(sectors.select("ticker", "sector")), "ticker", "left")
    peers = Window.partitionBy("sector", "date")
    known = F.col("sector").isNotNull()
    df = df.withColumn("sector_return_20d", F.when(known, F.avg("return_20d").over(peers)))
    return df.withColumn("sector_excess_return_20d", F.col("return_20d") - F.col("sector_return_20d")).drop("r", "_n", "_r", "_rr")


def lobbying_intensity(reports: DataFrame) -> DataFrame:
    """ticker, date and, on days with reports(ticker, date, amount, bill, relevance): spend of 90 and 365 days, its yearly
    change, how many different bills the last 90 days' reports name, and the sum of these bills' relevance.

    A bill counts from a report until 90 days later or the next report on it, whichever comes first; such spans are signed
    changes that a running sum adds up, so no report meets another.
    """
    spend = trailing_sum(reports, "ticker", "date", "amount", [90, 365], "lobbying_spend")
    change = year_over_year(reports, "ticker", "date", "amount", "lobbying_spend_yoy")
    named = reports.where("bill IS NOT NULL").groupBy("ticker", "bill", "date").agg(F.max("relevance").alias("v"))
    again = F.lead("date").over(Window.partitionBy("ticker", "bill").orderBy("date"))
    spans = named.withColumn("end", F.least(F.date_add("date", 90), again))
    part = F.array(F.struct("date", F.lit(1).alias("n"), F.col("v")), F.struct(F.col("end").alias("date"), F.lit(-1).alias("n"), (-F.col("v")).alias("v")))
    steps = spans.select("ticker", F.explode(part).alias("s")).groupBy("ticker", F.col("s.date").alias("date")).agg(F.sum("s.n").alias("n"), F.sum("s.v").alias("v"))
    days = reports.select("ticker", "date").distinct().withColumn("asked", F.lit(True))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    both = steps.join(days, ["ticker", "date"], "full").withColumns({"specific_bill_count_90d": F.coalesce(F.sum("n").over(w), F.lit(0)), "lobbying_bill_relevance_score": F.coalesce(F.sum("v").over(w), F.lit(0.0))})
    bills = both.where("asked").select("ticker", "date", "specific_bill_count_90d", "lobbying_bill_relevance_score")
    return spend.join(change, ["ticker", "date"]).join(bills, ["ticker", "date"])


def pac_flows(contributions: DataFrame, relevant: DataFrame) -> DataFrame:
    """ticker, date, sums of 180 days to relevant members by company and by its industry, the yearly change, and the cluster.

    contributions: ticker, industry, member, date (of public availability), amount; relevant: member, those on committees
    that matter to the industry. ``donor_cluster_score`` is the concentration (sum of squared shares) of a company's money
    among members. An industry's sum holds whatever its companies gave up to the day, on days on which one of them gave.
    """
    gave = contributions.join(few(relevant.select("member").distinct()), "member", "left_semi")
    own = trailing_sum(gave, "ticker", "date", "amount", [180], "company_pac_to_relevant_member")
    whole = trailing_sum(gave, "industry", "date", "amount", [180], "industry_pac_to_relevant_committee")
    change = year_over_year(gave, "ticker", "date", "amount", "pac_flow_yoy_change")
    cluster = concentration(contributions, "ticker", "member", "amount").select("ticker", F.col("hhi").alias("donor_cluster_score"))
    industry = gave.select("ticker", "date", "industry").distinct()
    return own.join(change, ["ticker", "date"]).join(industry, ["ticker", "date"]).join(whole, ["industry", "date"]).join(cluster, "ticker")


def contract_type_score(awards: DataFrame, days: int = 365) -> DataFrame:
    """ticker, date, contract_type_score: the mean weight of the kinds of awards of the last days, by amount.

    awards: ticker, date, award_type, amount. Other kinds weigh 0.
    """
    daily = awards.groupBy("ticker", "date").agg(F.sum("amount").alias("_a"), F.sum(F.col("amount") * weight_of(F.col("award_type"), AWARD_WEIGHTS)).alias("_w"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    w = Window.partitionBy("ticker").orderBy(day).rangeBetween(-(days - 1), 0)
    return daily.select("ticker", "date", ratio(F.sum("_w").over(w), F.sum("_a").over(w)).alias("contract_type_score"))


def with_public_date(rows: DataFrame, source: str) -> DataFrame:
    """rows with public_date by the rule of their source."""
    return rows.withColumn("public_date", F.coalesce(*(F.col(c) for c in PUBLIC_DATES[source])))


def trade_violations(trades: DataFrame) -> DataFrame:
    """n_trades, n_late, n_misdated: trades disclosed before they were made, and those public on another day than disclosed."""
    late = F.col("transaction_date") > F.col("disclosure_date")
    other = ~F.col("public_date").eqNullSafe(F.col("disclosure_date"))
    return trades.agg(F.count("*").alias("n_trades"), F.count_if(late).alias("n_late"), F.count_if(other).alias("n_misdated"))


def stackable(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Predictions (fold, prediction_date, ...) that a second model may learn from: made in the test span of their fold,
    which training ended before. folds as of ``walk_forward``: some rows, as many as there are folds."""
    span = folds.select("fold", "train_end", "test_start", "test_end")
    day = F.col("prediction_date")
    kept = predictions.join(few(span), "fold").where((day > F.col("train_end")) & day.between(F.col("test_start"), F.col("test_end")))
    return kept.select(predictions.columns)
