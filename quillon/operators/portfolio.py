"""Ranking bands, selection, metrics and a sequential portfolio simulator."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def rank_bands(scores: DataFrame, buy: float = 0.95, hold: float = 0.80, sell: float = 0.60) -> DataFrame:
    """pct and band of each (ticker, date, score): buy, hold, watch or sell by percent rank within the date."""
    pct = F.percent_rank().over(Window.partitionBy("date").orderBy("score"))
    df = scores.where("score IS NOT NULL").withColumn("pct", pct)
    p = F.col("pct")
    return df.withColumn("band", F.when(p >= buy, "buy").when(p >= hold, "hold").when(p < sell, "sell").otherwise("watch"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each date, ties by ticker; the planner limits each group before the exchange."""
    w = Window.partitionBy("date").orderBy(F.col("score").desc_nulls_last(), "ticker")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_ic(scores: DataFrame) -> DataFrame:
    """date, n, rank_ic: correlation of the ranks of score and target of a date; mean ranks are shared by ties."""
    both = scores.where("score IS NOT NULL AND target IS NOT NULL")

    def rank(c: str):
        w = Window.partitionBy("date")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("date", c)) - 1) / 2

    return both.withColumns({"_a": rank("score"), "_b": rank("target")}).groupBy("date").agg(F.count("*").alias("n"), ratio(F.covar_samp("_a", "_b"), F.sqrt(F.var_samp("_a") * F.var_samp("_b"))).alias("rank_ic"))  # corr() fails on constant ranks


def decile_means(scores: DataFrame) -> DataFrame:
    """decile, n, mean_target over all dates; deciles within a date, ties by ticker."""
    w = Window.partitionBy("date").orderBy("score", "ticker")
    return scores.where("score IS NOT NULL AND target IS NOT NULL").withColumn("decile", F.ntile(10).over(w)).groupBy("decile").agg(F.count("*").alias("n"), F.avg("target").alias("mean_target"))


def ablation(panel: DataFrame, variants: dict[str, list[str]], target: str = "target") -> DataFrame:
    """variant, n_dates, mean_rank_ic of the mean percent rank of each variant's features: the model-free baseline.

    All features of all variants are ranked in one pass; a row without a feature of a variant is left out of it.
    """
    names = sorted({c for v in variants.values() for c in v})
    rank = {f"_{c}": F.when(F.col(c).isNotNull(), F.percent_rank().over(Window.partitionBy("date", F.col(c).isNull()).orderBy(c))) for c in names}
    df = panel.withColumns(rank)
    out = None
    for name, columns in variants.items():
        score = sum((F.col(f"_{c}") for c in columns[1:]), F.col(f"_{columns[0]}")) / len(columns)
        ic = rank_ic(df.select("ticker", "date", F.round(score, 9).alias("score"), F.col(target).alias("target")))
        own = ic.where("rank_ic IS NOT NULL").agg(F.count("*").alias("n_dates"), F.avg("rank_ic").alias("mean_rank_ic")).select(F.lit(name).alias("variant"), "n_dates", "mean_rank_ic")
        out = own if out is None else out.unionByName(own)
    return out


def drawdown(series: DataFrame) -> DataFrame:
    """date, equity, drawdown of one return series (date, r): a row a date, ordered in one partition."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = series.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(w)))
    return grown.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)) - 1).select("date", "equity", "drawdown")


def summary(series: DataFrame, year: int = 252) -> DataFrame:
    """n_days, mean, volatility, sharpe, sortino, hit_rate, max_drawdown, cagr of a return series (date, r)."""
    worst = drawdown(series).agg(F.min("drawdown").alias("max_drawdown"), F.max_by("equity", "date").alias("_e"))
    down = F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2.0))))
    one = series.where("r IS NOT NULL").agg(F.count("r").alias("n_days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("volatility"), down.alias("_d"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"))
    both = one.join(F.broadcast(worst))
    return both.select("n_days", "mean", "volatility", (ratio(F.col("mean"), F.col("volatility")) * year**0.5).alias("sharpe"), (ratio(F.col("mean"), F.col("_d")) * year**0.5).alias("sortino"), "hit_rate", "max_drawdown", (F.pow("_e", F.lit(float(year)) / F.col("n_days")) - 1).alias("cagr"))


def simulate(
    scores: DataFrame, holdings: int = 50, max_weight: float = 0.04, max_sector: float = 0.25, max_turnover: float = 0.5, buy: float = 0.95, hold: float = 0.80, sell: float = 0.60,
    min_holdings: int = 25, min_weight: float = 0.01,
) -> DataFrame:
    """date, ticker, sector, weight, action, turnover of a portfolio rebalanced on each date of (portfolio, ticker, date, sector, pct).

    State passes from date to date, so a portfolio is one ordered group in Python; portfolios run in parallel. Holdings
    stay while their rank is at least ``sell``; names below it go first, the worst before the others, as far as turnover
    allows. Then names are bought by rank: those from ``buy`` on, and down to ``hold`` while fewer than ``min_holdings`` are
    held. A purchase is as large as the position, sector, turnover and cash bounds leave room for, and is left out if that
    is less than ``min_weight``.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        out = []
        for day, now in part.sort_values(["date", "pct", "ticker"], ascending=[True, False, True]).groupby("date", sort=True):
            pct, sector = dict(zip(now.ticker, now.pct, strict=True)), dict(zip(now.ticker, now.sector, strict=True))
            traded, actions = 0.0, {}
            for t in sorted(held, key=lambda t: (pct.get(t, -1.0), t)):
                if pct.get(t, -1.0) < sell and traded + held[t] <= max_turnover + 1e-12:
                    traded += held.pop(t)
                    actions[t] = "sell"
            weight: dict[str, float] = {}
            for t, w in held.items():
                weight[sector.get(t, "")] = weight.get(sector.get(t, ""), 0.0) + w
            for t in now.ticker:
                if pct[t] < (buy if len(held) >= min_holdings else hold) or len(held) >= holdings:
                    break
                if t in held or t in actions:
                    continue
                s = sector[t]
                room = round(min(max_weight, max_sector - weight.get(s, 0.0), max_turnover - traded, 1 - sum(held.values())), 12)
                if room >= min_weight:
                    held[t] = room
                    weight[s] = weight.get(s, 0.0) + room
                    traded += room
                    actions[t] = "buy"
            for t in sorted(set(held) | set(actions)):
                out.append((part.portfolio.iloc[0], day, t, sector.get(t), held.get(t, 0.0), actions.get(t, "hold"), traded))
        return pd.DataFrame(out, columns=["portfolio", "date", "ticker", "sector", "weight", "action", "turnover"])

    return scores.groupBy("portfolio").applyInPandas(run, "portfolio string, date date, ticker string, sector string, weight double, action string, turnover double")


def promotion(candidate: dict, base: dict, max_turnover: float = 0.5) -> dict:
    """Eight gates of a promotion and the verdict: each must hold."""
    gates = {
        "higher_rank_ic": candidate["rank_ic"] > base["rank_ic"], "higher_sharpe": candidate["sharpe"] > base["sharpe"], "higher_net_return": candidate["net_return"] > base["net_return"],
        "drawdown_not_worse": candidate["max_drawdown"] >= base["max_drawdown"], "turnover_within_bound": candidate["turnover"] <= max_turnover,
        "no_leakage": candidate["leakage_violations"] == 0, "costs_included": bool(candidate["costs_included"]), "out_of_sample": bool(candidate["out_of_sample"]),
    }
    return {"gates": gates, "rejected": sorted(k for k, v in gates.items() if not v), "promoted": all(gates.values())}


def promotion_report(name: str, decision: dict, candidate: dict | None = None, base: dict | None = None, html: bool = False) -> str:
    """A promotion decision in Markdown or HTML: the verdict, the gates, and both models' figures side by side."""
    tables = [(("gate", "holds"), [(k, "yes" if v else "no") for k, v in decision["gates"].items()])]
    if candidate is not None:
        base = base or {}
        tables.append((("figure", "candidate", "base"), [(k, str(v), str(base.get(k, ""))) for k, v in candidate.items()]))
    verdict = "PROMOTED" if decision["promoted"] else "REJECTED"
    if html:
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(x)}</{tag}>" for x in cells) + "</tr>"
        body = "".join("<table>" + row(head, "th") + "".join(row(r, "td") for r in rows) + "</table>" for head, rows in tables)
        return f"<h1>Promotion: {escape(name)}</h1><p><b>{verdict}</b></p>{body}\n"
    line = lambda cells: "| " + " | ".join(cells) + " |"
    parts = ["\n".join([line(head), line(["---"] * len(head)), *map(line, rows)]) for head, rows in tables]
    return "\n\n".join([f"# Promotion: {name}", f"**{verdict}**", *parts]) + "\n"
