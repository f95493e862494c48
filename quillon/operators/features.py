"""Panel features by ticker and day. Inputs: ticker, date, closeadj, volume, a row for each day that traded.

Warm-up: a return over k days is null on a ticker's first k rows; a mean, maximum or drawdown over w rows on its first
w - 1; a volatility or beta over w daily returns on its first w. Eligibility flags are never null. Annualised by
sqrt(252); deviations are of a sample; ranks are percent ranks; the risk-on score is return over volatility.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .asof import asof_backward, stacked
from .universe import by_ticker

YEAR = 252**0.5


def full(value: Column, of: str, rows: int, window=by_ticker) -> Column:
    """``value`` over the last ``rows`` rows, null until so many non-null ones are there."""
    return F.when(F.count(of).over(window(rows)) == rows, value.over(window(rows)))


def returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", ratio(F.col("closeadj"), F.lag("closeadj", 1).over(by_ticker())) - 1)


def price(panel: DataFrame) -> DataFrame:
    return panel.withColumns(_price())


def _price() -> dict[str, Column]:
    c, w = F.col("closeadj"), by_ticker()
    out = {f"px_return_{k}d": ratio(c, F.lag("closeadj", k).over(w)) - 1 for k in (1, 5, 21, 63, 126, 252)}
    out |= {f"px_ma_dist_{k}d": c / full(F.avg("closeadj"), "closeadj", k) - 1 for k in (21, 63, 252)}
    out["px_drawdown_252d"] = c / full(F.max("closeadj"), "closeadj", 252) - 1
    out["px_short_reversal_5d"] = 1 - ratio(c, F.lag("closeadj", 5).over(w))
    return out


def liquidity(panel: DataFrame, min_price: float = 5.0, min_adv: float = 1e6) -> DataFrame:
    return _eligible(panel.withColumn("liq_dollar_volume", F.col("closeadj") * F.col("volume")).withColumns(_averages()), min_price, min_adv)


def _averages() -> dict[str, Column]:
    return {f"liq_{name}_{k}d": full(F.avg(of), of, k) for k in (20, 60) for name, of in (("volume_avg", "volume"), ("adv", "liq_dollar_volume"))}


def _eligible(df: DataFrame, min_price: float, min_adv: float) -> DataFrame:
    """df, which has the averages, with the flags and what is relative to them."""
    priced, adv = (F.coalesce(F.col(c) >= least, F.lit(False)) for c, least in (("closeadj", min_price), ("liq_adv_20d", min_adv)))
    shares = F.col("shares") if "shares" in df.columns else F.lit(None).cast("double")
    return df.withColumns({
        "liq_is_price_eligible": priced, "liq_rel_volume_20d": ratio(F.col("volume"), F.col("liq_volume_avg_20d")), "liq_rel_volume_60d": ratio(F.col("volume"), F.col("liq_volume_avg_60d")),
        "liq_is_adv20_eligible": adv, "liq_turnover": ratio(F.col("volume"), shares), "liq_is_liquid": priced & adv,
    })


def running(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with the sums of ``values`` (null counts as 0) from each ticker's first row on: one pass, whatever the windows."""
    return df.withColumns(_running(values))


def _running(values: dict[str, Column]) -> dict[str, Column]:
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return {k: F.sum(F.coalesce(v.cast("double"), F.lit(0.0))).over(w) for k, v in values.items()}


def last_rows(name: str, k: int) -> Column:
    """The sum over the last k rows, from running sums: a row costs two reads, not k."""
    return F.col(name) - F.coalesce(F.lag(name, k).over(by_ticker()), F.lit(0.0))


def _moment(k: int, xy: str, x: str, y: str) -> Column:
    """Sample covariance of x and y over k rows. What is left of two nearly equal numbers is taken for 0."""
    total = last_rows(xy, k)
    value = (total - last_rows(x, k) * last_rows(y, k) / k) / (k - 1)
    return F.when(F.abs(value) > 1e-13 * F.abs(total), value).otherwise(0.0)


def risk(panel: DataFrame) -> DataFrame:
    """Realised volatility, and downside volatility with gains counted as 0."""
    sums, out = _risk()
    return running(returns(panel), sums).withColumns(out).drop(*sums)


def _risk() -> tuple[dict[str, Column], dict[str, Column]]:
    """What is summed, and the columns that come from the sums."""
    r = F.col("r")
    sums, out = {"_n": r.isNotNull(), "_r": r, "_rr": r * r, "_d": F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)) * r.isNotNull().cast("int")}, {}
    for k in (21, 63, 252):
        whole = last_rows("_n", k) == k
        out[f"risk_realized_vol_{k}d"] = F.when(whole, F.sqrt(F.greatest(_moment(k, "_rr", "_r", "_r"), F.lit(0.0)))) * YEAR
        out[f"risk_downside_vol_{k}d"] = F.when(whole, F.sqrt(F.greatest(last_rows("_d", k) / k, F.lit(0.0)))) * YEAR
    return sums, out


def max_drawdown(panel: DataFrame, windows: tuple[int, ...] = (21, 63, 252)) -> DataFrame:
    """ticker, date, risk_max_drawdown_{w}d: the worst fall from a peak to a later low inside the last w rows.

    A frame of a frame, which no window function expresses; numpy slides over a ticker's days (some thousand rows).
    """
    names = [f"risk_max_drawdown_{k}d" for k in windows]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", kind="stable").reset_index(drop=True)
        c = part["closeadj"].to_numpy(dtype=float)
        for k, name in zip(windows, names, strict=True):
            out = np.full(len(c), np.nan)
            if len(c) >= k:
                frames = np.lib.stride_tricks.sliding_window_view(c, k)
                for lo in range(0, len(frames), 2048):
                    f = frames[lo : lo + 2048]
                    out[k - 1 + lo : k - 1 + lo + len(f)] = (f / np.maximum.accumulate(f, axis=1) - 1).min(axis=1)
            part[name] = pd.array(np.where(np.isnan(out), None, out), dtype="Float64")
        return part[["ticker", "date", *names]]

    return panel.select("ticker", "date", "closeadj").groupBy("ticker").applyInPandas(run, "ticker string, date date, " + ", ".join(f"{n} double" for n in names))


#: Windows of drawdowns, each so many times the one before; the first is a step between.
FALLS = ((3, 1), (21, 3), (63, 21), (252, 63))


def with_max_drawdown(panel: DataFrame) -> DataFrame:
    """panel with risk_max_drawdown_{21,63,252}d, as ``max_drawdown`` has them, by windows on the rows where they are.

    A window is put together from shorter ones side by side: its worst fall is one inside a part, or from the highest
    price of earlier parts to the lowest of a later one.
    """
    df = panel.withColumns(_fall_start())
    for k, part in FALLS:
        df = df.withColumns(_earlier(k, part)).withColumns(_fall(k, part))
    return df.withColumns(_falls(df.columns)).drop(*[c for c in df.columns if c.startswith("_fall")])


def _fall_start() -> dict[str, Column]:
    """A day as a window of its own: highest and lowest price and worst fall. Prices that are no number count as null."""
    c = F.col("closeadj").cast("double")
    c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return {"_fall_high_1": c, "_fall_low_1": c, "_fall_1": F.when(c.isNotNull(), F.lit(0.0))}


def _earlier(k: int, part: int) -> dict[str, Column]:
    """The parts of a window over k rows that end before today, and its first price."""
    out = {f"_fall{x}_{part}_{j}": F.lag(f"_fall{x}_{part}", j * part).over(by_ticker()) for j in range(1, k // part) for x in ("_high", "_low", "")}
    return out | {f"_fall_first_{k}": F.lag("_fall_high_1", k - 1).over(by_ticker())}


def _fall(k: int, part: int) -> dict[str, Column]:
    name = lambda x, j: F.col(f"_fall{x}_{part}_{j}" if j else f"_fall{x}_{part}")
    order = range(k // part - 1, -1, -1)
    high, low, own = ([name(x, j) for j in order] for x in ("_high", "_low", ""))
    across = [ratio(low[i], F.greatest(*high[:i]) if i > 1 else high[0]) - 1 for i in range(1, len(high))]
    whole = high[0].isNotNull()
    for h in high[1:]:
        whole = whole & h.isNotNull()
    return {f"_fall_high_{k}": F.when(whole, F.greatest(*high)), f"_fall_low_{k}": F.when(whole, F.least(*low)), f"_fall_{k}": F.when(whole, F.least(*own, *across))}


def _falls(columns: list[str]) -> dict[str, Column]:
    """The worst falls; null where the window begins with a price of 0, from which there is none."""
    return {f"risk_max_drawdown_{k}d": F.when(F.col(f"_fall_first_{k}") != 0, F.col(f"_fall_{k}")) for k, _ in FALLS if f"_fall_first_{k}" in columns and k > 3}


def benchmark(panel: DataFrame) -> DataFrame:
    """date, b: the mean price of all tickers, where no index series is given. One row a date."""
    return panel.groupBy("date").agg(F.avg("closeadj").alias("b"))


def benchmark_returns(bench: DataFrame) -> DataFrame:
    """date, b, rb. A single series of some thousand days, ordered in one partition."""
    return bench.withColumn("rb", ratio(F.col("b"), F.lag("b", 1).over(Window.orderBy("date"))) - 1)


def beta(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Beta and idiosyncratic volatility against the benchmark; the calendar (a row a date) is broadcast."""
    sums, out = _beta()
    return running(_beside(returns(panel), bench), sums).withColumns(out).drop(*sums)


def _beside(df: DataFrame, bench: DataFrame) -> DataFrame:
    return df.join(F.broadcast(benchmark_returns(bench).select("date", "rb")), "date", "left")


def _beta() -> tuple[dict[str, Column], dict[str, Column]]:
    """What is summed, and the columns that come from the sums."""
    both = F.col("r").isNotNull() & F.col("rb").isNotNull()
    y, x = F.when(both, F.col("r")), F.when(both, F.col("rb"))
    sums, out = {"_m": both, "_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}, {}
    for k in (21, 63, 252):
        whole, cov, var = last_rows("_m", k) == k, _moment(k, "_xy", "_x", "_y"), _moment(k, "_xx", "_x", "_x")
        out[f"risk_beta_spy_{k}d"] = F.when(whole, ratio(cov, var))
        # var_y (1 - corr^2), without the division by 0 that corr() fails on
        out[f"risk_idio_vol_spy_{k}d"] = F.when(whole, F.sqrt(F.greatest(_moment(k, "_yy", "_y", "_y") - ratio(cov * cov, var), F.lit(0.0))) * YEAR)
    return sums, out


def regime(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """date and the market's state on it: return, trends, volatility, drawdown, risk-on score and breadth."""
    r21 = ratio(F.col("closeadj"), F.lag("closeadj", 21).over(by_ticker())) - 1
    breadth = panel.withColumn("_r", r21).groupBy("date").agg(_breadth("_r").alias("regime_breadth_px_return_21d_positive"))
    return market(bench).join(F.broadcast(breadth), "date", "left")


def _breadth(r21: str) -> Column:
    return F.avg((F.col(r21) > 0).cast("double"))


def market(bench: DataFrame) -> DataFrame:
    """The columns of ``regime`` that the benchmark alone gives."""
    w = Window.orderBy("date")
    over = lambda k: w.rowsBetween(-(k - 1), 0)
    b = F.col("b")
    df = benchmark_returns(bench)
    out: dict[str, Column] = {"regime_spy_return_21d": ratio(b, F.lag("b", 21).over(w)) - 1}
    for k in (50, 200):
        out[f"regime_spy_trend_{k}d"] = b / full(F.avg("b"), "b", k, over) - 1
        out[f"regime_spy_above_ma_{k}d"] = b / full(F.avg("b"), "b", k, over) - 1 > 0
    for k in (21, 63):
        out[f"regime_spy_realized_vol_{k}d"] = full(F.stddev_samp("rb"), "rb", k, over) * YEAR
    out["regime_spy_drawdown_252d"] = b / full(F.max("b"), "b", 252, over) - 1
    return df.withColumns(out).withColumn("regime_spy_risk_on_score_21d", ratio(F.col("regime_spy_return_21d"), F.col("regime_spy_realized_vol_21d"))).drop("b", "rb")


def _rank(column: str) -> Column:
    """Percent rank among the non-null values of the date."""
    w = Window.partitionBy("date", F.col(column).isNull()).orderBy(column)
    return F.when(F.col(column).isNotNull(), F.percent_rank().over(w))


def _z(column: str) -> Column:
    w = Window.partitionBy("date")
    sd = F.stddev_samp(column).over(w)
    return F.when(F.col(column).isNotNull(), F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col(column) - F.avg(column).over(w)) / sd))


def cross_section(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Ranks and z-scores within a date, and the return over the benchmark's."""
    df = risk(panel).withColumns({"px_return_21d": ratio(F.col("closeadj"), F.lag("closeadj", 21).over(by_ticker())) - 1, "liq_dollar_volume": F.col("closeadj") * F.col("volume")})
    spy = regime(panel, bench).select("date", "regime_spy_return_21d")
    df = df.join(F.broadcast(spy), "date", "left")
    return df.withColumns({
        "xs_px_return_21d_rank": _rank("px_return_21d"), "xs_liq_dollar_volume_rank": _rank("liq_dollar_volume"), "xs_risk_realized_vol_21d_rank": _rank("risk_realized_vol_21d"),
        "xs_liq_dollar_volume_z": _z("liq_dollar_volume"), "xs_risk_realized_vol_21d_z": _z("risk_realized_vol_21d"),
        "xs_px_return_21d_minus_spy": F.col("px_return_21d") - F.col("regime_spy_return_21d"),
    })


YIELDS = {"val_earnings_yield": "pe", "val_sales_yield": "ps", "val_book_yield": "pb", "val_ebit_ev_yield": "evebit", "val_ebitda_ev_yield": "evebitda"}


def valuation(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Yields from the same day's ratios: daily(ticker, date, pe, ps, pb, evebit, evebitda); null on a ratio of 0."""
    return panel.join(daily, ["ticker", "date"], "left").withColumns({k: ratio(F.lit(1.0), F.col(v)) for k, v in YIELDS.items()})


def fcf_yield(panel: DataFrame, filings: DataFrame) -> DataFrame:
    """val_fcf_yield: free cash flow of the latest filing known on the day over that day's market_cap; null without either."""
    known = asof_backward(panel, filings.select("ticker", "datekey", "fcf"), "ticker", "date", "datekey")
    return known.withColumn("val_fcf_yield", ratio(F.col("fcf"), F.col("market_cap"))).drop("datekey", "fcf")


def quality(filings: DataFrame) -> DataFrame:
    """Ratios of each filing (ticker, datekey, revenue, grossprofit, opinc, netinc, assets, equity, invcap, debt).

    Growth is against the filing four filings earlier.
    """
    w = Window.partitionBy("ticker").orderBy("datekey")
    c = F.col
    return filings.withColumns({
        "qual_gross_margin": ratio(c("grossprofit"), c("revenue")), "qual_operating_margin": ratio(c("opinc"), c("revenue")), "qual_net_margin": ratio(c("netinc"), c("revenue")),
        "qual_roa": ratio(c("netinc"), c("assets")), "qual_roe": ratio(c("netinc"), c("equity")), "qual_roic": ratio(c("opinc"), c("invcap")),
        "qual_revenue_growth": ratio(c("revenue"), F.lag("revenue", 4).over(w)) - 1, "qual_earnings_growth": ratio(c("netinc"), F.lag("netinc", 4).over(w)) - 1,
        "qual_debt_to_assets": ratio(c("debt"), c("assets")),
    })


def rsi(panel: DataFrame, days: int = 14) -> DataFrame:
    """RSI from plain means of gains and losses over ``days`` changes; 100 without losses, null in the warm-up."""
    change = F.col("closeadj") - F.lag("closeadj", 1).over(by_ticker())
    df = panel.withColumn("_c", change).withColumns({"_g": F.greatest("_c", F.lit(0.0)), "_l": F.greatest(-F.col("_c"), F.lit(0.0))})
    df = df.withColumns({"_n": F.count("_c").over(by_ticker(days)), "_g": F.avg(F.when(F.col("_c").isNotNull(), F.col("_g"))).over(by_ticker(days)), "_l": F.avg(F.when(F.col("_c").isNotNull(), F.col("_l"))).over(by_ticker(days))})
    value = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return df.withColumn(f"rsi_{days}", F.when(F.col("_n") == days, value)).drop("_c", "_g", "_l", "_n")


def ema(panel: DataFrame, span: int = 20) -> DataFrame:
    """ticker, date, ema_{span}, close_to_ema, ema_slope (change over 5 rows): the recursion runs over a ticker's days in order."""
    alpha, name = 2 / (span + 1), f"ema_{span}"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", kind="stable").reset_index(drop=True)
        e = part["closeadj"].ewm(alpha=alpha, adjust=False).mean()
        out = pd.DataFrame({"ticker": part["ticker"], "date": part["date"], name: e, "close_to_ema": part["closeadj"] / e - 1})
        out["ema_slope"] = (e / e.shift(5) - 1).astype("Float64")
        return out

    return panel.select("ticker", "date", "closeadj").groupBy("ticker").applyInPandas(run, f"ticker string, date date, {name} double, close_to_ema double, ema_slope double")


def buckets() -> Iterator[tuple[str, list[str]]]:
    """The feature columns of a panel by bucket."""
    yield "price_behavior", [*(f"px_return_{k}d" for k in (1, 5, 21, 63, 126, 252)), *(f"px_ma_dist_{k}d" for k in (21, 63, 252)), "px_drawdown_252d", "px_short_reversal_5d"]
    yield "volume_liquidity", ["liq_dollar_volume", "liq_is_price_eligible", *(f"liq_{x}_{k}d" for k in (20, 60) for x in ("volume_avg", "adv", "rel_volume")), "liq_is_adv20_eligible", "liq_turnover", "liq_is_liquid"]
    yield "volatility_risk", [f"risk_{x}_{k}d" for k in (21, 63, 252) for x in ("realized_vol", "downside_vol", "max_drawdown", "beta_spy", "idio_vol_spy")]
    yield "fundamental_quality", [f"qual_{x}" for x in ("gross_margin", "operating_margin", "net_margin", "roa", "roe", "roic", "revenue_growth", "earnings_growth", "debt_to_assets")]
    yield "valuation", [f"val_{x}_yield" for x in ("earnings", "sales", "book", "ebit_ev", "ebitda_ev", "fcf")]
    yield "regime_context", ["regime_spy_return_21d", *(f"regime_spy_{x}_{k}d" for k in (50, 200) for x in ("trend", "above_ma")), "regime_spy_realized_vol_21d", "regime_spy_realized_vol_63d", "regime_spy_drawdown_252d", "regime_spy_risk_on_score_21d", "regime_breadth_px_return_21d_positive"]
    yield "cross_sectional_context", ["xs_px_return_21d_rank", "xs_liq_dollar_volume_rank", "xs_risk_realized_vol_21d_rank", "xs_liq_dollar_volume_z", "xs_risk_realized_vol_21d_z", "xs_px_return_21d_minus_spy"]
    yield "legacy_rsi", []


def _standing(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prices with _rank_{c}, and by date _n_{c}, _avg_{c}, _sd_{c} and _breadth: what ranks, z-scores and breadth need.

    Rows go to their date once, with the two values that need the ticker's history, and back to their ticker with ranks as
    small numbers. The figures of a date are combined before they are dealt, from the same rows.
    """
    df = risk(prices).withColumn("px_return_21d", ratio(F.col("closeadj"), F.lag("closeadj", 21).over(by_ticker())) - 1)
    df = df.select("date", "ticker", "closeadj", "volume", "px_return_21d", "risk_realized_vol_21d")
    with_dollars = lambda x: x.withColumn("liq_dollar_volume", F.col("closeadj") * F.col("volume"))
    figures = {f"_{k}_{c}": f(c) for c in RANKED for k, f in (("n", F.count), ("avg", F.avg), ("sd", F.stddev_samp))}
    days = with_dollars(df).groupBy("date").agg(_breadth("px_return_21d").alias("_breadth"), *[v.alias(k) for k, v in figures.items()])
    df = with_dollars(df.repartition("date"))
    for c in RANKED:
        df = df.withColumn(f"_rank_{c}", F.rank().over(Window.partitionBy("date", F.col(c).isNull()).orderBy(c)))
    return df.select("ticker", "date", "closeadj", "volume", *[f"_rank_{c}" for c in RANKED]).repartition("ticker"), days


#: The values whose ranks on a date the panel has.
RANKED = ("px_return_21d", "liq_dollar_volume", "risk_realized_vol_21d")


def _stood(c: str) -> dict[str, Column]:
    """The rank and the z-score of a value from what ``_standing`` has; as _rank and _z have them."""
    v, n, sd = F.col(c), F.col(f"_n_{c}"), F.col(f"_sd_{c}")
    out = {f"xs_{c}_rank": F.when(v.isNotNull(), F.when(n > 1, (F.col(f"_rank_{c}") - 1) / (n - 1)).otherwise(0.0))}
    if c != "px_return_21d":
        out[f"xs_{c}_z"] = F.when(v.isNotNull(), F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((v - F.col(f"_avg_{c}")) / sd))
    return out


def factor_panel(prices: DataFrame, bench: DataFrame, filings: DataFrame, daily: DataFrame, min_price: float = 5.0, min_adv: float = 1e6) -> DataFrame:
    """All feature columns of a (ticker, date) panel, with closeadj and volume.

    filings also has fcf, daily also has market_cap; prices and daily have a row for each (ticker, date). Only narrow rows
    are dealt: prices to their dates for the ranks and back, where filings and daily ratios, dealt by ticker as well, are
    stacked on them. All wide columns are computed after that, in one pass over a ticker's days, and are never dealt.
    """
    columns = [c for _, v in buckets() for c in v]
    ratios = quality(filings).select("ticker", "datekey", "fcf", *[c for c in columns if c.startswith("qual_")])
    ranked, days = _standing(prices)
    df = stacked(ranked, "ticker", "date", {"_filing": (ratios, "datekey", False), "_daily": (daily, "date", True)})
    # One window takes what the rows hold as they are, the next what needs returns, then what needs their sums; drawdowns grow along.
    df = _beside(df, bench).withColumn("liq_dollar_volume", F.col("closeadj") * F.col("volume")).withColumns(_fall_start())
    (sums, out), (more_sums, more) = _risk(), _beta()
    steps = [_price() | _averages() | {"r": ratio(F.col("closeadj"), F.lag("closeadj", 1).over(by_ticker())) - 1}, _running(sums | more_sums), out | more, {}]
    for (k, part), step in zip(FALLS, steps, strict=True):
        df = df.withColumns(step | _earlier(k, part)).withColumns(_fall(k, part))
    df = _eligible(df.withColumns(_falls(df.columns)), min_price, min_adv)
    df = df.join(F.broadcast(days.withColumnRenamed("date", "_day")), F.col("date").eqNullSafe(F.col("_day")), "left")
    df = df.join(F.broadcast(market(bench).withColumn("_known", F.lit(True))), "date", "left")
    own = {"regime_breadth_px_return_21d_positive": F.when(F.col("_known"), F.col("_breadth")), "val_fcf_yield": ratio(F.col("_filing.fcf"), F.col("_daily.market_cap"))}
    own |= {c: F.col(f"_filing.{c}") for c in ratios.columns if c.startswith("qual_")} | {k: ratio(F.lit(1.0), F.col(f"_daily.{v}")) for k, v in YIELDS.items()}
    own |= {"xs_px_return_21d_minus_spy": F.col("px_return_21d") - F.col("regime_spy_return_21d")}
    for c in RANKED:
        own |= _stood(c)
    return df.select("ticker", "date", "closeadj", "volume", *[own[c].alias(c) if c in own else c for c in columns])
