"""Edge cases of operators that the query comparison does not reach."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import DATA
from quillon import panel
from quillon.functions.scalars import as_date, as_date_column, impact_bps, redact, trade_allowed
from quillon.operators import asof, dedup, features, incremental, labels, policy, portfolio, reports
from quillon.operators.universe import universe

D = dt.date


def _panel(spark, n=300, tickers=("A", "B"), late=("C",), late_n=280):
    rows = [(t, D(2020, 1, 1) + dt.timedelta(days=i), 10.0 + (i * 7 + k * 3) % 11, 100.0 + i) for k, t in enumerate(tickers) for i in range(n)]
    rows += [(t, D(2020, 1, 1) + dt.timedelta(days=n - late_n + i), 20.0 + i % 5, 50.0) for t in late for i in range(late_n)]
    return spark.createDataFrame(rows, "ticker string, date date, closeadj double, volume double")


def test_warm_up_null_counts(spark):
    px = _panel(spark)
    bench = px.where("ticker = 'A'").select("date", F.col("closeadj").alias("b"))
    nulls = lambda df, c: df.where(F.col(c).isNull()).count()
    price, risk, liq, beta = features.price(px), features.risk(px), features.liquidity(px), features.beta(px, bench)
    for k in (1, 5, 21, 63, 126, 252):
        assert nulls(price, f"px_return_{k}d") == 3 * k
    for k in (21, 63, 252):
        assert nulls(price, f"px_ma_dist_{k}d") == 3 * (k - 1)
        assert nulls(risk, f"risk_realized_vol_{k}d") == nulls(risk, f"risk_downside_vol_{k}d") == 3 * k
        assert nulls(beta, f"risk_beta_spy_{k}d") == nulls(beta, f"risk_idio_vol_spy_{k}d") == 3 * k
    mdd = features.max_drawdown(px)
    assert nulls(mdd, "risk_max_drawdown_252d") == 3 * 251
    assert nulls(price, "px_drawdown_252d") == 3 * 251 and nulls(price, "px_short_reversal_5d") == 15
    for c in ("liq_dollar_volume", "liq_is_price_eligible", "liq_is_adv20_eligible", "liq_is_liquid"):
        assert nulls(liq, c) == 0
    assert nulls(liq, "liq_adv_20d") == 3 * 19 and nulls(liq, "liq_rel_volume_60d") == 3 * 59 and nulls(liq, "liq_turnover") == 880
    joined = px.join(features.regime(px, bench), "date")
    # Only the two tickers that trade from the start have rows in the benchmark's warm-up.
    assert nulls(joined, "regime_spy_return_21d") == nulls(joined, "regime_spy_risk_on_score_21d") == 2 * 21 + 1
    assert nulls(joined, "regime_breadth_px_return_21d_positive") == 2 * 21 + 1
    fw = labels.forward(px)
    assert nulls(fw, "target_5d") == 15 and nulls(fw, "winner_21d") == 63
    assert sum(len(v) for _, v in features.buckets()) == 68


def test_latest_takes_valid_stamp_then_price_and_is_deterministic(spark):
    rows = [("A", D(2026, 1, 2), 1.0, 5.0, "bad"), ("A", D(2026, 1, 2), 2.0, 5.0, "2026-01-03"), ("A", D(2026, 1, 2), 3.0, 5.0, None), ("B", D(2026, 1, 2), None, 1.0, None), ("B", D(2026, 1, 2), 4.0, 1.0, "x"), (None, D(2026, 1, 2), 4.0, 1.0, "x"), ("C", None, 4.0, 1.0, "x")]
    got = dedup.latest_prices(spark.createDataFrame(rows, "ticker string, date date, closeadj double, volume double, lastupdated string"))
    assert sorted((r.ticker, r.closeadj) for r in got.collect()) == [("A", 2.0), ("B", 4.0)]


def test_universe_bounds(spark):
    day = lambda i: D(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(t, day(i), *[10.0] * 4, 4.0 if (t, i) == ("A", 70) else 10.0, 0.0 if (t, i) == ("B", 5) else 100_000.0, None) for t in ("A", "B", "N") for i in range(80)]
    rows += [("S", day(i), *[10.0] * 4, 10.0, 100_000.0, None) for i in range(59)]
    sep = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, closeadj double, volume double, lastupdated string")
    meta = [("SEP", t, "NYSE", "Domestic Common Stock", None, "x", "s", "r", "USD", "US", None, None, None) for t in "ABS"]
    tick = spark.createDataFrame(meta, "table string, ticker string, exchange string, category string, sector string, industry string, scalemarketcap string, scalerevenue string, currency string, location string, lastupdated date, lastpricedate date, firstpricedate date")
    got = universe(sep, tick, min_adv=1_000_000.0)
    assert got.where("ticker IN ('N', 'S')").count() == 0  # no metadata; 59 rows
    a = got.where("ticker = 'A'")
    assert a.where(F.col("date") == day(70)).count() == 0 and a.where(F.col("date") == day(59)).count() == 1
    # The frame with the cheap day is below the bound; exactly 1,000,000 is not.
    assert a.where(F.col("date") == day(71)).count() == 0 and a.where(F.col("date") == day(69)).count() == 1
    assert got.where("ticker = 'B'").agg(F.min("date")).first()[0] == day(60)  # the day without volume does not count
    assert {r.sector for r in got.collect()} == {"UNKNOWN"}
    assert got.where(F.col("date") == day(59)).first().n_raw_universe == 1


def test_merges(spark):
    s = "k string, day date, x long"
    old = spark.createDataFrame([("a", D(2026, 1, 1), 1), ("b", D(2026, 1, 2), 1), ("c", None, 1), ("gone", D(2026, 1, 2), 1)], s)
    new = spark.createDataFrame([("b", D(2026, 1, 2), 2), ("b", D(2026, 1, 2), 2), ("d", D(2026, 1, 3), 2), ("e", None, 2), ("a", D(2026, 1, 1), 9)], s)
    key = lambda df: sorted((r.k, r.x) for r in df.collect())
    mark = D(2026, 1, 2)
    assert key(incremental.overlap_replace(old, new.select("x", "day", "k"), "day", mark)) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    assert key(incremental.append_newer(old, new, "day", mark)) == [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("gone", 1)]
    assert len(key(incremental.append_newer(old.limit(0), new, "day", None))) == 4
    with pytest.raises(incremental.SchemaMismatch):
        incremental.newer(old, new.drop("x"), "day", mark)


def test_asof_takes_the_latest_known(spark):
    left = spark.createDataFrame([("A", D(2026, 1, 1)), ("A", D(2026, 1, 5)), ("A", None), (None, D(2026, 1, 5)), ("B", D(2026, 1, 5))], "t string, d date")
    right = spark.createDataFrame([("A", D(2026, 1, 5), 2, None), ("A", D(2026, 1, 2), 1, 7)], "t string, k date, v int, w int")
    got = sorted(((r.t, r.d, r.v, r.w) for r in asof.asof_backward(left, right, "t", "d", "k").collect()), key=repr)
    assert ("A", D(2026, 1, 5), 2, None) in got and ("A", D(2026, 1, 1), None, None) in got and ("A", None, None, None) in got and (None, D(2026, 1, 5), None, None) in got and len(got) == 5


def test_scalars(spark):
    assert as_date(dt.datetime(2026, 1, 2, 3)) == as_date("2026-01-02T03:00") == D(2026, 1, 2) and as_date(None) is None
    df = spark.createDataFrame([("2026-01-02 x", 0.0, 1.0), ("bad", 4.0, 1.0)], "s string, adv double, o double")
    got = df.select(as_date_column(F.col("s")).alias("d"), impact_bps(F.col("o"), F.col("adv"), F.lit(0.02)).alias("i"), trade_allowed(F.lit(0.1), F.lit(0.01), 0.01, F.lit(None).cast("double"), F.lit(0.1), F.lit(True)).alias("ok")).collect()
    assert got[0].d == D(2026, 1, 2) and got[1].d is None
    assert got[0].i == float("inf") and got[1].i == pytest.approx(0.75 * 0.02 * 0.5 * 1e4) and got[0].ok is False
    assert redact("x?api_key=abc&b=1 {'api_key': 'abc'}") == "x?api_key=<redacted>&b=1 {'api_key': '<redacted>'}"


def test_split_arithmetic(spark):
    days = [(D(2020, 1, 1) + dt.timedelta(days=i),) for i in range(300)]
    cal = spark.createDataFrame(days, "trading_date date")
    px = cal.select(F.lit("A").alias("ticker"), F.col("trading_date").alias("date"))
    got = {r.split: r["count"] for r in labels.split_by_purge(px, cal, 200, 240, 296).groupBy("split").count().collect()}
    assert got == {"train": 200, "validation": 19, "test": 35, None: 2 * 21 + 4}
    folds = labels.walk_forward(cal, 100, 50, 20).orderBy("fold").collect()
    assert [(f.train_end - f.train_start).days for f in folds] == [99, 149, 199, 249] and all((f.test_start - f.train_end).days == 21 for f in folds)
    assert labels.walk_forward(cal.limit(100), 100, 50, 20).count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("A", D(2026, 1, 1), 1.0, None, 1), ("A", D(2026, 1, 1), None, 2.0, 3), (None, D(2026, 1, 1), 1.0, 2.0, None)], "ticker string, date date, x double, y double, w int")
    assert reports.key_report(df).first().asDict() == {"n_rows": 3, "duplicate_keys": 1, "null_tickers": 1, "null_dates": 0}
    assert [tuple(r) for r in reports.bucket_report(df, {"b": ["x", "y"], "none": []}).collect()] == [("b", 2, 3, 1, 2), ("none", 0, 0, 0, 0)]
    t = reports.target_report(df.select(F.col("x").alias("target_5d"), F.col("w").alias("winner_5d")), (5,)).first()
    assert (t.unexpected_winner_nulls, t.unexpected_winner_values, t.invalid_winner_values) == (1, 1, 1)
    assert not reports.is_valid(0, 0, [t.asDict()]) and reports.is_valid(0, 0, [])
    assert reports.unclassified(["ticker", "x", "volume", "target_5d"], {"b": ["x"]}) == ["volume"]
    empty = reports.bucket_split_report(df.withColumn("split", F.lit("train")), {"b": ["x"]}, "y").where("split = 'test'").first()
    assert empty.split_rows == 0 and empty.columns == 1 and empty.rows_all_with_target == 0


def test_future_event_counts_trading_days(spark):
    cal = spark.createDataFrame([(D(2026, 1, d),) for d in (1, 2, 5, 6, 7)], "trading_date date")
    px = spark.createDataFrame([("A", D(2026, 1, d)) for d in (1, 2, 5, 6)] + [("B", D(2026, 1, 1))], "ticker string, date date")
    ev = spark.createDataFrame([("A", D(2026, 1, 4)), ("A", D(2026, 1, 4))], "ticker string, date date")  # a Sunday: counts as the 5th
    got = {(r.ticker, r.date.day): r.future_buy for r in labels.future_event(px, ev, cal, 1).collect()}
    assert got == {("A", 1): False, ("A", 2): True, ("A", 5): False, ("A", 6): False, ("B", 1): False}


def test_entities(spark):
    rec = spark.createDataFrame([(1, "T1", None, "zzz"), (2, None, "C2", "zzz"), (3, None, None, "Acme, Inc."), (4, None, None, "Acmee Tools"), (5, None, None, "Nothing like"), (6, None, None, None)], "id long, ticker string, cik string, name string")
    com = spark.createDataFrame([(10, "T1", "C1", "One"), (20, "T2", "C2", "Two"), (30, "T3", "C3", "ACME Corp"), (40, "T4", "C4", "Acme Tools LLC")], "id long, ticker string, cik string, name string")
    got = policy.cascade(rec, com)
    assert {(r.record_id, r.company_id, r.method) for r in got.collect()} == {(1, 10, "ticker"), (2, 20, "cik"), (3, 30, "exact_name"), (4, 40, "fuzzy_name")}
    assert {(r.record_id, r.reason) for r in policy.review_queue(rec, got, 0.95).collect()} == {(5, "unmatched"), (6, "unmatched"), (4, "low_confidence")}


def test_committee_relevance_counts_only_memberships_in_force(spark):
    """Against a count by hand: ends before starts, no start, no end, one day, no committee, a committee without members."""
    held = [("c1", "chair", D(2020, 1, 1), D(2020, 1, 31)), ("c1", "member", D(2020, 2, 1), D(2020, 1, 10)), ("c1", "member", None, None), ("c1", "member", D(2020, 1, 15), None), ("c1", "ranking_member", D(2020, 1, 20), D(2020, 1, 20)), (None, "chair", D(2020, 1, 1), None)]
    over = [("c1", 1, 0.5), ("c2", 1, 1.0), ("c2", 2, 1.0), (None, 3, 1.0), ("c1", 4, None)]
    days = [D(2019, 1, 1), D(2020, 1, 10), D(2020, 1, 20), D(2020, 1, 25), D(2020, 2, 1)]
    weight = {"chair": 3.0, "ranking_member": 2.5, "member": 1.0}
    power = {(d, c): sum(weight[r] for k, r, s, e in held if k == c and s and s <= d and (e is None or d <= e)) for d in days for c in ("c1", "c2")}
    want = {(d, n): None if x is None else sum(power.get((d, c), 0) * y for c, m, y in over if m == n) for d in days for _, n, x in over}
    a = spark.createDataFrame([(str(i), *x) for i, x in enumerate(held)], "member string, committee string, role string, start date, end date")
    got = policy.committee_relevance(a, spark.createDataFrame(over, "committee string, company long, overlap double"), spark.createDataFrame([(d,) for d in days], "date date"))
    assert {(x.date, x.company): x.committee_relevance_score for x in got.collect()} == want


def test_simulator_respects_bounds(spark):
    rows = [("p", f"T{i:02d}", D(2026, m, 1), f"S{i % 3}", (i - m * 5) % 40 / 39) for m in range(1, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "portfolio string, ticker string, date date, sector string, pct double")
    out = portfolio.simulate(df, holdings=10, max_weight=0.04, max_sector=0.08, max_turnover=0.1, buy=0.8).toPandas()
    by_day = out.groupby("date")
    assert (by_day.weight.sum() <= 1).all() and (out.turnover <= 0.1 + 1e-9).all()
    assert (out[out.weight > 0].groupby(["date", "sector"]).weight.sum() <= 0.08 + 1e-9).all()
    assert set(out.action) >= {"buy", "hold", "sell"}


def test_promotion():
    good = dict(rank_ic=0.05, sharpe=1.2, net_return=0.1, max_drawdown=-0.1, turnover=0.3, leakage_violations=0, costs_included=True, out_of_sample=True)
    base = dict(rank_ic=0.03, sharpe=1.0, net_return=0.08, max_drawdown=-0.2)
    assert portfolio.promotion(good, base)["promoted"]
    bad = portfolio.promotion(good | {"turnover": 0.6}, base)
    assert bad["rejected"] == ["turnover_within_bound"] and "REJECTED" in portfolio.promotion_report("x", bad)


def test_factor_panel_has_every_column_once(spark):
    px = _panel(spark, 40, ("A", "B"), ("C",), 30)
    bench = features.benchmark(px)
    filings = spark.createDataFrame([("A", D(2020, 1, 10), *[10.0] * 9)], "ticker string, datekey date, revenue double, grossprofit double, opinc double, netinc double, assets double, equity double, invcap double, debt double, fcf double")
    daily = px.select("ticker", "date", *[F.lit(2.0).alias(c) for c in ("pe", "ps", "pb", "evebit", "evebitda")], F.lit(100.0).alias("market_cap"))
    got = features.factor_panel(px, bench, filings, daily)
    columns = [c for _, v in features.buckets() for c in v]
    assert got.columns == ["ticker", "date", "closeadj", "volume", *columns] and len(columns) == 68 and got.count() == 110
    assert got.where("val_fcf_yield IS NOT NULL").count() == got.where("qual_roa IS NOT NULL").count() == 31
    assert reports.unclassified(got.columns, dict(features.buckets())) == ["closeadj", "volume"]


def _formatted(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_factor_panel_deals_no_wide_rows(spark):
    """Rows are dealt before the feature columns are there, so that scratch does not grow with their number."""
    px = _panel(spark, 40, ("A", "B"), ("C",), 30).repartition("ticker")
    filings = spark.createDataFrame([("A", D(2020, 1, 10), *[10.0] * 9)], "ticker string, datekey date, revenue double, grossprofit double, opinc double, netinc double, assets double, equity double, invcap double, debt double, fcf double").repartition("ticker")
    daily = px.select("ticker", "date", *[F.lit(2.0).alias(c) for c in ("pe", "ps", "pb", "evebit", "evebitda")], F.lit(100.0).alias("market_cap"))
    plan = _formatted(features.factor_panel(px, features.benchmark(px), filings, daily))
    dealt = [int(n) for n in re.findall(r"\(\d+\) Exchange\s*\nInput \[(\d+)\].*\nArguments: hashpartitioning", plan)]
    # The widest are the figures of a date, combined, and the filings as they come in.
    assert len(dealt) > 3 and max(dealt) <= 16
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_factor_panel_equals_its_parts(spark):
    """Every column as the operator of its bucket gives it, on tables with days without ratios, filings and history."""
    d = str(DATA)
    px, filings, daily = panel.prices(spark, d), panel.filings(spark, d), panel.daily_ratios(spark, d)
    bench = features.benchmark(px)
    # A day that the benchmark lacks, and filings of a ticker that has no prices or on the day itself.
    bench = bench.where("date <> DATE '1996-03-05'")
    got = features.factor_panel(px, bench, filings, daily, min_adv=30_000)
    fcf = features.fcf_yield(px.join(daily.select("ticker", "date", "market_cap"), ["ticker", "date"], "left"), filings)
    ratios = features.quality(filings).select("ticker", "datekey", *[c for c in got.columns if c.startswith("qual_")])
    parts = [features.price(px), features.liquidity(px, min_adv=30_000), features.risk(px), features.beta(px, bench), features.max_drawdown(px), asof.asof_backward(px, ratios, "ticker", "date", "datekey"), features.valuation(px, daily), fcf, px.join(features.regime(px, bench), "date", "left"), features.cross_section(px, bench)]
    rows, seen = {(r.ticker, r.date): r for r in got.collect()}, set()
    for part in parts:
        own = [c for c in got.columns[2:] if c in part.columns and c not in seen]
        seen.update(own)
        for r in part.select("ticker", "date", *own).collect():
            for c in own:
                x, y = rows[r.ticker, r.date][c], r[c]
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (c, r.ticker, r.date, x, y)
    assert seen == set(got.columns[2:]) and len(rows) == px.count()


def test_drawdown_by_windows_equals_the_loop(spark):
    r = random.Random(5)
    odd = {(1, 40): 0.0, (2, 0): 0.0, (2, 1): 0.0, (3, 100): None, (4, 30): float("nan"), (5, 260): float("inf")}
    rows = [(f"T{t}", D(2020, 1, 1) + dt.timedelta(days=i), odd.get((t, i), r.uniform(5, 50))) for t in range(8) for i in range((20, 300, 300, 400, 330, 600, 252, 251)[t])]
    px = spark.createDataFrame(rows, "ticker string, date date, closeadj double")
    names = [f"risk_max_drawdown_{k}d" for k in (21, 63, 252)]
    got, want = ({(x.ticker, x.date): x[2:] for x in df.select("ticker", "date", *names).collect()} for df in (features.with_max_drawdown(px), features.max_drawdown(px)))
    assert got == want and features.with_max_drawdown(px).columns == [*px.columns, *names]


def test_max_drawdown_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(t, D(2020, 1, 1) + dt.timedelta(days=i), r.uniform(5, 50), 1.0) for t in "AB" for i in range(270)]
    px = spark.createDataFrame(rows, "ticker string, date date, closeadj double, volume double")
    got = {(x.ticker, x.date): x for x in features.max_drawdown(px, (21, 252)).collect()}
    for t in "AB":
        own = [(d, c) for k, d, c, _ in rows if k == t]
        for i in range(0, len(own), 7):
            for k in (21, 252):
                window = [c for _, c in own[i - k + 1 : i + 1]] if i + 1 >= k else []
                want = min((low / max(window[: j + 1]) - 1 for j, low in enumerate(window)), default=None)
                value = got[t, own[i][0]][f"risk_max_drawdown_{k}d"]
                assert value is None if want is None else value == pytest.approx(want)


def test_simulator_keeps_every_rule(spark):
    """A replay of what it did, date by date, against each bound and band."""
    r = random.Random(2)
    names = [(f"T{k:02d}", f"s{k % 6}") for k in range(60)]
    rows = [("p", t, D(2021, m, 28), s, r.random()) for m in range(1, 13) for t, s in names if r.random() < 0.95]
    df = spark.createDataFrame(rows, "portfolio string, ticker string, date date, sector string, pct double")
    out = portfolio.simulate(df, min_holdings=12).collect()
    pct = {(x[2], x[1]): x[4] for x in rows}
    held = {}
    for day in sorted({x.date for x in out}):
        now = [x for x in out if x.date == day]
        sold, bought = ({x.ticker: x for x in now if x.action == a} for a in ("sell", "buy"))
        kept = {x.ticker: x.weight for x in now if x.action == "hold"}
        assert set(kept) | set(sold) == set(held) and all(held[t] == w for t, w in kept.items())
        assert all(pct.get((day, t), -1) < 0.6 and x.weight == 0 for t, x in sold.items())
        assert all(0.01 <= x.weight <= 0.04 and pct[day, t] >= 0.8 for t, x in bought.items())
        n = len(kept)
        for t in sorted(bought, key=lambda t: -pct[day, t]):
            assert pct[day, t] >= 0.95 or n < 12
            n += 1
        assert sum(held[t] for t in sold) + sum(x.weight for x in bought.values()) == pytest.approx(now[0].turnover) and now[0].turnover <= 0.5 + 1e-9
        held = kept | {t: x.weight for t, x in bought.items()}
        sectors = {}
        for t, w in held.items():
            sectors[dict(names)[t]] = sectors.get(dict(names)[t], 0) + w
        assert len(held) <= 50 and sum(held.values()) <= 1 + 1e-9 and max(sectors.values()) <= 0.25 + 1e-9
        assert not any(pct.get((day, t), -1) < 0.6 for t in kept) or now[0].turnover + min(kept.values()) > 0.5 - 0.04


def test_report_formats():
    good = dict(rank_ic=0.05, sharpe=1.2, net_return=0.1, max_drawdown=-0.1, turnover=0.3, leakage_violations=0, costs_included=True, out_of_sample=True)
    made = portfolio.promotion(good, good)
    text, page = portfolio.promotion_report("a<b", made, good, good), portfolio.promotion_report("a<b", made, good, good, html=True)
    assert "| sharpe | 1.2 | 1.2 |" in text and "REJECTED" in text and "<td>sharpe</td><td>1.2</td>" in page and "a&lt;b" in page
