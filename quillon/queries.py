"""Every operator as a query on the test tables, and the same query in SQL.

Floating-point results are rounded with a nudge (see ``rounded``) to digits that both engines agree on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import panel as P
from .functions.scalars import impact_bps, normal_name, redact_column, rounded, trade_allowed
from .operators import asof, dedup, features, incremental, labels, policy, portfolio, reports, signals
from .operators.universe import few, policy_universe, rolling_liquidity, universe
from .plans.audit import KEYED
from .sources.registry import kept_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_RAW = """
raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS closeadj, l_quantity AS volume,
  CASE WHEN l_orderkey % 17 = 0 THEN 'n/a' WHEN l_orderkey % 13 <> 0 THEN strftime(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER), '%Y-%m-%d') END AS lastupdated FROM lineitem)"""
_PX = (
    _RAW
    + """,
px AS (SELECT ticker, date, closeadj, volume FROM raw QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, date ORDER BY TRY_CAST(lastupdated AS DATE) DESC NULLS LAST, closeadj DESC NULLS LAST, volume DESC NULLS LAST) = 1)"""
)
_RET = _PX + ", ret AS (SELECT *, closeadj / lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM px)"
_BENCH = _RET + ", bench0 AS (SELECT date, avg(closeadj) AS b FROM px GROUP BY date), bench AS (SELECT *, b / lag(b) OVER (ORDER BY date) - 1 AS rb FROM bench0)"
_META = """
meta0 AS (SELECT CASE WHEN s_suppkey % 11 = 5 THEN 'SFP' ELSE 'SEP' END AS "table", CAST(s_suppkey AS VARCHAR) AS ticker, ['NASDAQ', 'NYSE', 'NYSEMKT', 'OTC', 'NASDAQ'][CAST((s_suppkey + v) % 5 + 1 AS INTEGER)] AS exchange,
  CASE WHEN s_suppkey % 6 = 3 THEN 'ETF' ELSE 'Domestic Common Stock' END AS category, CASE WHEN s_suppkey % 7 <> 0 THEN r_name END AS sector, n_name AS industry, '5 - Large' AS scalemarketcap, '4 - Mid' AS scalerevenue, 'USD' AS currency, n_name AS location,
  DATE '2001-01-01' + CAST(v * (s_suppkey % 3) AS INTEGER) AS lastupdated, CASE WHEN s_suppkey % 2 = 0 THEN DATE '2001-06-01' + CAST(v AS INTEGER) END AS lastpricedate, DATE '1995-01-01' - CAST(v AS INTEGER) AS firstpricedate
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest([0, 1]) AS v)),
meta AS (SELECT * FROM meta0 WHERE "table" = 'SEP' QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY lastupdated DESC NULLS LAST, lastpricedate DESC NULLS LAST, firstpricedate DESC NULLS LAST) = 1)"""
_FIL = """
fil AS (SELECT ticker, datekey, p AS revenue, p * 0.4 AS grossprofit, p * 0.2 AS opinc, p * (k % 7 - 2) / 10 AS netinc, p * 2 AS assets, CASE WHEN k % 5 <> 0 THEN p ELSE 0.0 END AS equity, p * 1.5 AS invcap, p * (k % 3) AS debt
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS datekey, o_orderkey AS k, o_totalprice AS p FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC, o_totalprice DESC) = 1))"""


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr} + 1e-{digits + 2}, {digits})"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), n) for c, n in digits.items()})


# ------------------------------------------------------------------------------------------ universe and its parts


@query(
    "universe",
    f"""WITH {_PX}, {_META},
base AS (SELECT px.*, exchange, category, coalesce(sector, 'UNKNOWN') AS sector, coalesce(industry, 'UNKNOWN') AS industry, scalemarketcap, scalerevenue, currency, location, closeadj * volume AS dollar_volume FROM px LEFT JOIN meta USING (ticker)
  WHERE closeadj > 0 AND volume > 0 AND exchange IN ('NASDAQ', 'NYSE', 'NYSEMKT') AND category IN ('Domestic Common Stock', 'Domestic Common Stock Primary Class', 'Domestic Common Stock Secondary Class')),
liq AS (SELECT *, avg(dollar_volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS adv_20, avg(dollar_volume) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS adv_60, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS obs_60 FROM base)
SELECT ticker, date, exchange, category, sector, industry, scalemarketcap, scalerevenue, currency, location, closeadj AS open, closeadj AS high, closeadj AS low, closeadj AS close, closeadj, volume, dollar_volume, {_r("adv_20", 4)} AS adv_20, {_r("adv_60", 4)} AS adv_60, count(*) OVER (PARTITION BY date) AS n_raw_universe
FROM liq WHERE closeadj >= 5 AND adv_20 >= 30000 AND obs_60 >= 60""",
)
def _universe(spark, d):
    return _round(universe(P.sep(spark, d), P.tickers(spark, d), min_adv=30_000), {"adv_20": 4, "adv_60": 4})


@query("dedup_latest", f"WITH {_RAW} SELECT ticker, date, closeadj, volume, TRY_CAST(lastupdated AS DATE) AS updated FROM raw QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, date ORDER BY TRY_CAST(lastupdated AS DATE) DESC NULLS LAST, closeadj DESC NULLS LAST, volume DESC NULLS LAST) = 1")
def _dedup_latest(spark, d):
    return dedup.latest_prices(P.sep(spark, d).select("ticker", "date", "closeadj", "volume", "lastupdated")).select("ticker", "date", "closeadj", "volume", F.col("lastupdated").try_cast("date").alias("updated"))


@query("dedup_meta", f"WITH {_META} SELECT * FROM meta")
def _dedup_meta(spark, d):
    return dedup.latest_metadata(P.tickers(spark, d))


@query(
    "rolling_adv",
    f"""WITH {_PX}, a AS (SELECT ticker, date, avg(closeadj * volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS adv_20, avg(closeadj * volume) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS adv_60, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS obs_60 FROM px)
SELECT ticker, date, {_r("adv_20", 4)} AS adv_20, {_r("adv_60", 4)} AS adv_60, obs_60 FROM a""",
)
def _rolling_adv(spark, d):
    df = rolling_liquidity(P.prices(spark, d).withColumn("dollar_volume", F.col("closeadj") * F.col("volume")))
    return _round(df.select("ticker", "date", "adv_20", "adv_60", "obs_60"), {"adv_20": 4, "adv_60": 4})


@query(
    "policy_universe",
    f"""WITH {_PX}, {_META}, a AS (SELECT px.*, category, closeadj * 1000 AS market_cap, avg(closeadj * volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS adv_20, row_number() OVER (PARTITION BY ticker ORDER BY date) AS age FROM px JOIN meta USING (ticker))
SELECT ticker, date, closeadj, category FROM a WHERE closeadj >= 5 AND adv_20 >= 30000 AND market_cap >= 100000 AND category NOT IN ('ETF', 'OTC') AND age > 252""",
)
def _policy_universe(spark, d):
    meta = dedup.latest_metadata(P.tickers(spark, d)).select("ticker", "category")
    df = P.prices(spark, d).join(few(meta), "ticker").withColumns({"dollar_volume": F.col("closeadj") * F.col("volume"), "market_cap": F.col("closeadj") * 1000})
    return policy_universe(rolling_liquidity(df), min_adv=30_000, min_cap=100_000).select("ticker", "date", "closeadj", "category")


@query("trading_calendar", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS trading_date FROM lineitem WHERE l_shipdate IS NOT NULL")
def _trading_calendar(spark, d):
    return labels.trading_calendar(P.sep(spark, d))


# ------------------------------------------------------------------------------------------------------- audits


@query(
    "audit_tables",
    """SELECT 'sep_base' AS table_name, count(*) AS n_rows, min(CAST(l_shipdate AS DATE)) AS min_date, max(CAST(l_shipdate AS DATE)) AS max_date, 'ticker' AS entity_column, count(DISTINCT l_suppkey) AS distinct_entities FROM lineitem
UNION ALL SELECT 'sf1', count(*), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), 'ticker', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'tickers', count(*), NULL, NULL, 'ticker', count(DISTINCT s_suppkey) FROM supplier
UNION ALL SELECT 'indicators', count(*), NULL, NULL, NULL, NULL FROM part""",
)
def _audit_tables(spark, d):
    orders = P.read(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("datekey"))
    parts = [reports.table_report(P.sep(spark, d), "sep_base", "date", "ticker"), reports.table_report(orders, "sf1", "datekey", "ticker"), reports.table_report(P.read(spark, d, "supplier").withColumnRenamed("s_suppkey", "ticker"), "tickers", None, "ticker"), reports.table_report(P.read(spark, d, "part"), "indicators", None, None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("audit_dup_keys", "SELECT 'sep_base' AS table_name, count(*) AS duplicate_keys FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE) HAVING count(*) > 1) UNION ALL SELECT 'daily', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1)")
def _audit_dup_keys(spark, d):
    orders = P.read(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"))
    a, b = (reports.duplicate_keys(df, ["ticker", "date"]).select(F.lit(n).alias("table_name"), "duplicate_keys") for n, df in zip(KEYED, (P.sep(spark, d), orders), strict=True))
    return a.unionByName(b)


@query("audit_catalog")
def _audit_catalog(spark, d):
    rows = [(t, f.name, f.dataType.simpleString()) for t in ("lineitem", "orders", "supplier", "events") for f in P.read(spark, d, t).schema]
    return spark.createDataFrame(sorted(rows), "table_name string, column_name string, type string")


@query("high_watermark", "SELECT max(CAST(l_shipdate AS DATE)) AS max_date FROM lineitem")
def _high_watermark(spark, d):
    return incremental.high_watermark(P.sep(spark, d), "date")


@query(
    "freshness_lag",
    """WITH l AS (SELECT 'sep_base' AS t, max(CAST(l_shipdate AS DATE)) AS m FROM lineitem UNION ALL SELECT 'sf1', max(CAST(o_orderdate AS DATE)) FROM orders), a AS (SELECT 'sep_base' AS t, DATE '2001-11-06' AS m UNION ALL SELECT 'sf1', DATE '2001-07-31')
SELECT l.t AS table_name, l.m AS local_max, a.m AS api_max, date_diff('day', l.m, a.m) AS lag_days, coalesce(date_diff('day', l.m, a.m) <= 0, FALSE) AS fresh FROM l JOIN a USING (t)""",
)
def _freshness_lag(spark, d):
    local = incremental.high_watermark(P.sep(spark, d), "date").withColumn("table_name", F.lit("sep_base")).unionByName(incremental.high_watermark(P.read(spark, d, "orders"), "o_orderdate").withColumn("table_name", F.lit("sf1")))
    api = spark.createDataFrame([("sep_base", "2001-11-06"), ("sf1", "2001-07-31")], "table_name string, max_date string").withColumn("max_date", F.col("max_date").cast("date"))
    return reports.freshness(local, api).select("table_name", "local_max", "api_max", "lag_days", "fresh")


# ------------------------------------------------------------------------------------------------------- merges

_OLD = "old AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_shipdate AS DATE) END AS day, l_extendedprice AS x FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01'), new AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_shipdate AS DATE) END AS day, l_extendedprice + 1 AS x FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-12-01'), m AS (SELECT max(day) AS m FROM old)"


def _old_new(spark, d):
    li = P.read(spark, d, "lineitem")
    day = F.col("l_shipdate").cast("date")
    pick = lambda cond, x: (F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(cond, day).alias("day"), x.alias("x"))
    old = li.where(F.col("l_shipdate") <= F.lit("1999-01-01").cast("timestamp_ntz")).select(*pick(F.col("l_orderkey") % 17 != 0, F.col("l_extendedprice")))
    new = li.where(F.col("l_shipdate") >= F.lit("1998-12-01").cast("timestamp_ntz")).select(*pick(F.col("l_orderkey") % 13 != 0, F.col("l_extendedprice") + 1))
    return old, new.select("x", "day", "n", "k"), incremental.high_watermark(old, "day").first()[0]


@query("incremental_append", f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT DISTINCT k, n, day, x FROM new, m WHERE day > m")
def _incremental_append(spark, d):
    old, new, mark = _old_new(spark, d)
    return incremental.append_newer(old, new, "day", mark)


@query("incremental_overlap", f"WITH {_OLD} SELECT k, n, day, x FROM old, m WHERE day < m OR day IS NULL UNION ALL SELECT DISTINCT k, n, day, x FROM new, m WHERE day >= m")
def _incremental_overlap(spark, d):
    old, new, mark = _old_new(spark, d)
    return incremental.overlap_replace(old, new, "day", mark)


@query("incremental_upsert", f"WITH {_OLD} SELECT k, n, day, x FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k = old.k AND new.n = old.n) UNION ALL SELECT DISTINCT k, n, day, x FROM new")
def _incremental_upsert(spark, d):
    old, new, _ = _old_new(spark, d)
    return incremental.keyed_upsert(old, new, ["k", "n"])


@query("prune_plan", "SELECT unnest(['derived_features', 'scratch']) AS table_name")
def _prune_plan(spark, d):
    stored = spark.createDataFrame([(t,) for t in ("sep_base", "scratch", "daily", "tickers", "derived_features", "trading_calendar")], "table_name string")
    return stored.where(~F.col("table_name").isin(sorted(kept_tables()))).orderBy("table_name")


@query(
    "redact_text",
    r"""SELECT event_id, regexp_replace(t, '(?i)\b(api_?key["'']?\s*[=:]\s*["'']?)[^\s"''&<>(),;{}\[\]]+', '\1<redacted>', 'g') AS text
FROM (SELECT event_id, 'GET /x?api_key=k' || user_id || '&a=1 {''api_key'': ''s' || event_id || ''', "b": ' || props || '}' AS t FROM events)""",
)
def _redact_text(spark, d):
    text = F.concat(F.lit("GET /x?api_key=k"), "user_id", F.lit("&a=1 {'api_key': 's"), "event_id", F.lit("', \"b\": "), "props", F.lit("}"))
    return P.read(spark, d, "events").select("event_id", redact_column(text).alias("text"))


# ----------------------------------------------------------------------------------------------------- features


def _full(fn: str, col: str, k: int, part: str = "PARTITION BY ticker ") -> str:
    w = f"OVER ({part}ORDER BY date ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {w} = {k} THEN {fn}({col}) {w} END"


_PRICE = {f"px_return_{k}d": f"closeadj / lag(closeadj, {k}) OVER (PARTITION BY ticker ORDER BY date) - 1" for k in (1, 5, 21, 63, 126, 252)}
_PRICE |= {f"px_ma_dist_{k}d": f"closeadj / ({_full('avg', 'closeadj', k)}) - 1" for k in (21, 63, 252)}
_PRICE |= {"px_drawdown_252d": f"closeadj / ({_full('max', 'closeadj', 252)}) - 1", "px_short_reversal_5d": "1 - closeadj / lag(closeadj, 5) OVER (PARTITION BY ticker ORDER BY date)"}


@query("feat_price", f"WITH {_PX} SELECT ticker, date, " + ", ".join(f"{_r(v)} AS {k}" for k, v in _PRICE.items()) + " FROM px")
def _feat_price(spark, d):
    return _round(features.price(P.prices(spark, d)).select("ticker", "date", *_PRICE), dict.fromkeys(_PRICE, 6))


_LIQ4 = ["liq_dollar_volume", "liq_volume_avg_20d", "liq_volume_avg_60d", "liq_adv_20d", "liq_adv_60d", "liq_rel_volume_20d", "liq_rel_volume_60d"]


@query(
    "feat_liquidity",
    f"""WITH {_PX}, dv AS (SELECT *, closeadj * volume AS v FROM px), a AS (SELECT ticker, date, volume, v AS liq_dollar_volume, closeadj >= 5 AS liq_is_price_eligible, {", ".join(f"{_full('avg', 'volume', k)} AS liq_volume_avg_{k}d, {_full('avg', 'v', k)} AS liq_adv_{k}d" for k in (20, 60))} FROM dv),
b AS (SELECT *, volume / liq_volume_avg_20d AS liq_rel_volume_20d, volume / liq_volume_avg_60d AS liq_rel_volume_60d, coalesce(liq_adv_20d >= 30000, FALSE) AS liq_is_adv20_eligible FROM a)
SELECT ticker, date, liq_is_price_eligible, liq_is_adv20_eligible, CAST(NULL AS DOUBLE) AS liq_turnover, liq_is_price_eligible AND liq_is_adv20_eligible AS liq_is_liquid, {", ".join(f"{_r(c, 4)} AS {c}" for c in _LIQ4)} FROM b""",
)
def _feat_liquidity(spark, d):
    df = features.liquidity(P.prices(spark, d), min_adv=30_000)
    return _round(df.select("ticker", "date", "liq_is_price_eligible", "liq_is_adv20_eligible", "liq_turnover", "liq_is_liquid", *_LIQ4), dict.fromkeys(_LIQ4, 4))


_RISK = {f"risk_realized_vol_{k}d": f"({_full('stddev_samp', 'r', k)}) * sqrt(252)" for k in (21, 63, 252)} | {f"risk_downside_vol_{k}d": f"sqrt({_full('avg', 'd', k)}) * sqrt(252)" for k in (21, 63, 252)}
_RISK_CTE = _RET + ", rd AS (SELECT *, pow(least(r, 0.0), 2.0) AS d0 FROM ret), rr AS (SELECT *, CASE WHEN r IS NOT NULL THEN d0 END AS d FROM rd)"


@query("feat_risk", f"WITH {_RISK_CTE} SELECT ticker, date, " + ", ".join(f"{_r(v, 4)} AS {k}" for k, v in _RISK.items()) + " FROM rr")
def _feat_risk(spark, d):
    return _round(features.risk(P.prices(spark, d)).select("ticker", "date", *_RISK), dict.fromkeys(_RISK, 4))


_MDD = (21, 63)


@query(
    "feat_risk_mdd",
    f"WITH {_PX}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM px), "
    + ", ".join(f"p{k} AS (SELECT a.ticker, a.i, b.closeadj / max(b.closeadj) OVER (PARTITION BY a.ticker, a.i ORDER BY b.i) - 1 AS f FROM n a JOIN n b ON a.ticker = b.ticker AND b.i BETWEEN a.i - {k - 1} AND a.i WHERE a.i >= {k}), m{k} AS (SELECT ticker, i, min(f) AS f FROM p{k} GROUP BY 1, 2)" for k in _MDD)
    + " SELECT n.ticker, n.date, "
    + ", ".join(f"{_r(f'm{k}.f')} AS risk_max_drawdown_{k}d" for k in _MDD)
    + " FROM n "
    + " ".join(f"LEFT JOIN m{k} ON n.ticker = m{k}.ticker AND n.i = m{k}.i" for k in _MDD),
)
def _feat_risk_mdd(spark, d):
    return _round(features.max_drawdown(P.prices(spark, d), _MDD), {f"risk_max_drawdown_{k}d": 6 for k in _MDD})


@query("feat_risk_mdd_252")
def _feat_risk_mdd_252(spark, d):
    return features.max_drawdown(P.prices(spark, d), (252,))


def _beta_sql() -> str:
    out = []
    for k in (21, 63, 252):
        w = f"OVER (PARTITION BY ticker ORDER BY date ROWS {k - 1} PRECEDING)"
        out.append(f"{_r(f'CASE WHEN count(x) {w} = {k} THEN covar_samp(y, x) {w} / NULLIF(var_samp(x) {w}, 0) END', 4)} AS risk_beta_spy_{k}d")
        out.append(f"{_r(f'CASE WHEN count(x) {w} = {k} THEN sqrt(greatest(var_samp(y) {w} * (1 - pow(corr(y, x) {w}, 2)), 0)) * sqrt(252) END', 4)} AS risk_idio_vol_spy_{k}d")
    return ", ".join(out)


_BETA = [f"risk_{x}_spy_{k}d" for k in (21, 63, 252) for x in ("beta", "idio_vol")]


@query("feat_risk_beta", f"WITH {_BENCH}, j AS (SELECT ticker, date, CASE WHEN r IS NOT NULL AND rb IS NOT NULL THEN r END AS y, CASE WHEN r IS NOT NULL AND rb IS NOT NULL THEN rb END AS x FROM ret LEFT JOIN bench USING (date)) SELECT ticker, date, {_beta_sql()} FROM j")
def _feat_risk_beta(spark, d):
    px = P.prices(spark, d)
    return _round(features.beta(px, features.benchmark(px)).select("ticker", "date", *_BETA), dict.fromkeys(_BETA, 4))


_REG = {"regime_spy_return_21d": "b / lag(b, 21) OVER (ORDER BY date) - 1"}
_REG |= {f"regime_spy_trend_{k}d": f"b / ({_full('avg', 'b', k, '')}) - 1" for k in (50, 200)}
_REG |= {f"regime_spy_realized_vol_{k}d": f"({_full('stddev_samp', 'rb', k, '')}) * sqrt(252)" for k in (21, 63)}
_REG |= {"regime_spy_drawdown_252d": f"b / ({_full('max', 'b', 252, '')}) - 1"}
_REGIME = (
    _BENCH
    + ", reg0 AS (SELECT date, " + ", ".join(f"{v} AS {k}" for k, v in _REG.items()) + " FROM bench)"
    + ", br AS (SELECT date, avg(CASE WHEN r21 > 0 THEN 1.0 WHEN r21 IS NOT NULL THEN 0.0 END) AS regime_breadth_px_return_21d_positive FROM (SELECT date, closeadj / lag(closeadj, 21) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r21 FROM px) GROUP BY date)"
    + ", reg AS (SELECT reg0.*, regime_spy_return_21d / NULLIF(regime_spy_realized_vol_21d, 0) AS regime_spy_risk_on_score_21d, regime_spy_trend_50d > 0 AS regime_spy_above_ma_50d, regime_spy_trend_200d > 0 AS regime_spy_above_ma_200d, regime_breadth_px_return_21d_positive FROM reg0 LEFT JOIN br USING (date))"
)
_REG_OUT = [*_REG, "regime_spy_risk_on_score_21d", "regime_breadth_px_return_21d_positive"]


@query("feat_regime", f"WITH {_REGIME} SELECT date, regime_spy_above_ma_50d, regime_spy_above_ma_200d, " + ", ".join(f"{_r(c)} AS {c}" for c in _REG_OUT) + " FROM reg")
def _feat_regime(spark, d):
    px = P.prices(spark, d)
    return _round(features.regime(px, features.benchmark(px)).select("date", "regime_spy_above_ma_50d", "regime_spy_above_ma_200d", *_REG_OUT), dict.fromkeys(_REG_OUT, 6))


_XS = ["xs_px_return_21d_rank", "xs_liq_dollar_volume_rank", "xs_risk_realized_vol_21d_rank", "xs_liq_dollar_volume_z", "xs_risk_realized_vol_21d_z", "xs_px_return_21d_minus_spy"]


def _rank_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN percent_rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) END"


def _z_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN coalesce(stddev_samp({c}) OVER (PARTITION BY date), 0) = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_samp({c}) OVER (PARTITION BY date) END"


@query(
    "feat_xs",
    f"""WITH {_REGIME}, f AS (SELECT ticker, date, closeadj / lag(closeadj, 21) OVER (PARTITION BY ticker ORDER BY date) - 1 AS p, closeadj * volume AS l, ({_full("stddev_samp", "r", 21)}) * sqrt(252) AS v FROM ret),
g AS (SELECT f.*, p - regime_spy_return_21d AS m FROM f LEFT JOIN reg USING (date))
SELECT ticker, date, {_r(_rank_sql("p"))} AS xs_px_return_21d_rank, {_r(_rank_sql("l"))} AS xs_liq_dollar_volume_rank, {_r(_rank_sql("v"))} AS xs_risk_realized_vol_21d_rank, {_r(_z_sql("l"), 5)} AS xs_liq_dollar_volume_z, {_r(_z_sql("v"), 5)} AS xs_risk_realized_vol_21d_z, {_r("m")} AS xs_px_return_21d_minus_spy FROM g""",
)
def _feat_xs(spark, d):
    px = P.prices(spark, d)
    return _round(features.cross_section(px, features.benchmark(px)).select("ticker", "date", *_XS), {c: 5 if c.endswith("_z") else 6 for c in _XS})


_VAL = {"val_earnings_yield": "pe", "val_sales_yield": "ps", "val_book_yield": "pb", "val_ebit_ev_yield": "evebit", "val_ebitda_ev_yield": "evebitda"}
_VAL_CTE = _PX + ", dr AS (SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN 0.0 ELSE closeadj / 100 END AS pe, closeadj / 50 AS ps, closeadj / 20 AS pb, volume - 7 AS evebit, volume + 1 AS evebitda FROM px WHERE volume % 4 <> 0)"


@query("feat_valuation", f"WITH {_VAL_CTE} SELECT ticker, date, " + ", ".join(f"{_r(f'1.0 / NULLIF({v}, 0)')} AS {k}" for k, v in _VAL.items()) + " FROM px LEFT JOIN dr USING (ticker, date)")
def _feat_valuation(spark, d):
    return _round(features.valuation(P.prices(spark, d), P.daily_ratios(spark, d)).select("ticker", "date", *_VAL), dict.fromkeys(_VAL, 6))


_QUAL = {
    "qual_gross_margin": "grossprofit / NULLIF(revenue, 0)", "qual_operating_margin": "opinc / NULLIF(revenue, 0)", "qual_net_margin": "netinc / NULLIF(revenue, 0)", "qual_roa": "netinc / NULLIF(assets, 0)", "qual_roe": "netinc / NULLIF(equity, 0)", "qual_roic": "opinc / NULLIF(invcap, 0)",
    "qual_revenue_growth": "revenue / NULLIF(lag(revenue, 4) OVER w, 0) - 1", "qual_earnings_growth": "netinc / NULLIF(lag(netinc, 4) OVER w, 0) - 1", "qual_debt_to_assets": "debt / NULLIF(assets, 0)",
}


@query("feat_quality", f"WITH {_FIL} SELECT ticker, datekey, " + ", ".join(f"{_r(v)} AS {k}" for k, v in _QUAL.items()) + " FROM fil WINDOW w AS (PARTITION BY ticker ORDER BY datekey)")
def _feat_quality(spark, d):
    return _round(features.quality(P.filings(spark, d)).select("ticker", "datekey", *_QUAL), dict.fromkeys(_QUAL, 6))


@query(
    "feat_fcf_yield",
    f"WITH {_PX}, {_FIL} SELECT px.ticker, px.date, {_r('fil.revenue * 0.1 / NULLIF(px.closeadj * 1000, 0)')} AS val_fcf_yield FROM px ASOF LEFT JOIN fil ON px.ticker = fil.ticker AND px.date >= fil.datekey",
)
def _feat_fcf_yield(spark, d):
    px = P.prices(spark, d).withColumn("market_cap", F.col("closeadj") * 1000)
    return _round(features.fcf_yield(px, P.filings(spark, d)).select("ticker", "date", "val_fcf_yield"), {"val_fcf_yield": 6})


@query("factor_panel")
def _factor_panel(spark, d):
    px = P.prices(spark, d)
    return features.factor_panel(px, features.benchmark(px), P.filings(spark, d), P.daily_ratios(spark, d), min_adv=30_000)


@query("asof_fundamentals", f"WITH {_PX}, {_FIL} SELECT px.ticker, px.date, px.closeadj, fil.datekey, fil.revenue FROM px ASOF LEFT JOIN fil ON px.ticker = fil.ticker AND px.date >= fil.datekey")
def _asof_fundamentals(spark, d):
    right = P.filings(spark, d).select("ticker", "datekey", "revenue")
    return asof.asof_backward(P.prices(spark, d).select("ticker", "date", "closeadj"), right, "ticker", "date", "datekey")


@query(
    "feat_rsi",
    f"""WITH {_PX}, c AS (SELECT *, closeadj - lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) AS c FROM px), g AS (SELECT ticker, date, count(c) OVER w AS n, avg(CASE WHEN c IS NOT NULL THEN greatest(c, 0) END) OVER w AS g, avg(CASE WHEN c IS NOT NULL THEN greatest(-c, 0) END) OVER w AS l FROM c WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING))
SELECT ticker, date, {_r("CASE WHEN n = 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END")} AS rsi_14 FROM g""",
)
def _feat_rsi(spark, d):
    return _round(features.rsi(P.prices(spark, d)).select("ticker", "date", "rsi_14"), {"rsi_14": 6})


@query(
    "feat_ema",
    f"""WITH RECURSIVE {_PX}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM px), e AS (SELECT ticker, date, i, closeadj, closeadj AS ema FROM n WHERE i = 1 UNION ALL SELECT n.ticker, n.date, n.i, n.closeadj, n.closeadj * 2 / 21 + e.ema * 19 / 21 FROM e JOIN n ON n.ticker = e.ticker AND n.i = e.i + 1)
SELECT ticker, date, {_r("ema", 4)} AS ema_20, {_r("closeadj / ema - 1")} AS close_to_ema, {_r("ema / lag(ema, 5) OVER (PARTITION BY ticker ORDER BY date) - 1")} AS ema_slope FROM e""",
)
def _feat_ema(spark, d):
    return _round(features.ema(P.prices(spark, d)), {"ema_20": 4, "close_to_ema": 6, "ema_slope": 6})


# ------------------------------------------------------------------------------------------------ labels, splits

_FWD = _PX + ", fw AS (SELECT *, " + ", ".join(f"lead(closeadj, {h}) OVER (PARTITION BY ticker ORDER BY date) / closeadj - 1 AS target_{h}d" for h in (5, 21)) + " FROM px)"


@query("label_forward", f"WITH {_FWD} SELECT ticker, date, " + ", ".join(f"{_r(f'target_{h}d')} AS target_{h}d, CAST(target_{h}d > 0 AS INTEGER) AS winner_{h}d" for h in (5, 21)) + " FROM fw")
def _label_forward(spark, d):
    return _round(labels.forward(P.prices(spark, d)).select("ticker", "date", *[f"{x}_{h}d" for h in (5, 21) for x in ("target", "winner")]), {"target_5d": 6, "target_21d": 6})


@query(
    "label_excess",
    f"WITH {_BENCH}, fb AS (SELECT date, " + ", ".join(f"lead(b, {h}) OVER (ORDER BY date) / b - 1 AS s{h}" for h in (30, 60, 90)) + " FROM bench), fs AS (SELECT ticker, date, " + ", ".join(f"lead(closeadj, {h}) OVER (PARTITION BY ticker ORDER BY date) / closeadj - 1 AS r{h}" for h in (30, 60, 90)) + " FROM px) SELECT ticker, date, " + ", ".join(f"{_r(f'r{h}')} AS future_return_{h}d, {_r(f's{h}')} AS future_spy_return_{h}d, {_r(f'r{h} - s{h}')} AS future_excess_return_{h}d" for h in (30, 60, 90)) + " FROM fs LEFT JOIN fb USING (date)",
)
def _label_excess(spark, d):
    px = P.prices(spark, d)
    out = [f"future_{x}_{h}d" for h in (30, 60, 90) for x in ("return", "spy_return", "excess_return")]
    return _round(labels.excess(px, features.benchmark(px)).select("ticker", "date", *out), dict.fromkeys(out, 6))


@query("label_top_decile", f"WITH {_FWD} SELECT ticker, date, CASE WHEN target_21d IS NOT NULL THEN ntile(10) OVER (PARTITION BY date, target_21d IS NULL ORDER BY target_21d DESC NULLS LAST, ticker) = 1 END AS top_decile FROM fw")
def _label_top_decile(spark, d):
    return labels.top_decile(labels.forward(P.prices(spark, d)), "target_21d").select("ticker", "date", "top_decile")


_CAL = "cal AS (SELECT date AS trading_date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM px))"


@query(
    "label_future_buy",
    f"""WITH {_PX}, {_CAL}, ev AS (SELECT DISTINCT ticker, (SELECT min(idx) FROM cal WHERE trading_date >= d) AS e FROM (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 <> 0))
SELECT px.ticker, px.date, EXISTS (SELECT 1 FROM ev WHERE ev.ticker = px.ticker AND ev.e > cal.idx AND ev.e <= cal.idx + 60) AS future_buy FROM px JOIN cal ON px.date = cal.trading_date""",
)
def _label_future_buy(spark, d):
    px = P.prices(spark, d).select("ticker", "date")
    buys = P.trades(spark, d).where("side = 'buy'").select("ticker", F.col("transaction_date").alias("date"))
    return labels.future_event(px, buys, labels.trading_calendar(P.sep(spark, d)), 60)


@query(
    "label_future_sell",
    f"""WITH {_PX}, {_CAL}, ev AS (SELECT DISTINCT ticker, (SELECT min(idx) FROM cal WHERE trading_date >= d) AS e FROM (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 = 0))
SELECT px.ticker, px.date, EXISTS (SELECT 1 FROM ev WHERE ev.ticker = px.ticker AND ev.e > cal.idx AND ev.e <= cal.idx + 60) AS future_sell FROM px JOIN cal ON px.date = cal.trading_date""",
)
def _label_future_sell(spark, d):
    px = P.prices(spark, d).select("ticker", "date")
    sells = P.trades(spark, d).where("side = 'sell'").select("ticker", F.col("transaction_date").alias("date"))
    return labels.future_event(px, sells, labels.trading_calendar(P.sep(spark, d)), 60, "future_sell")


@query(
    "split_purge",
    f"WITH {_PX}, {_CAL} SELECT px.ticker, px.date, CASE WHEN idx <= 1500 THEN 'train' WHEN idx > 1521 AND idx <= 1900 THEN 'validation' WHEN idx > 1921 AND idx <= 2400 THEN 'test' END AS split FROM px JOIN cal ON px.date = cal.trading_date",
)
def _split_purge(spark, d):
    return labels.split_by_purge(P.prices(spark, d).select("ticker", "date"), labels.trading_calendar(P.sep(spark, d)), 1500, 1900, 2400)


@query(
    "walk_forward",
    f"""WITH {_PX}, {_CAL}, n AS (SELECT max(idx) AS n FROM cal), f AS (SELECT unnest(range(0, CAST(floor((n - 1000 - 90 - 1) / 252) AS BIGINT) + 1)) AS fold, n FROM n)
SELECT CAST(fold AS INTEGER) AS fold, a.trading_date AS train_start, b.trading_date AS train_end, c.trading_date AS test_start, e.trading_date AS test_end FROM f JOIN cal a ON a.idx = 1 JOIN cal b ON b.idx = fold * 252 + 1000 JOIN cal c ON c.idx = fold * 252 + 1091 JOIN cal e ON e.idx = least(fold * 252 + 1342, n)""",
)
def _walk_forward(spark, d):
    return labels.walk_forward(labels.trading_calendar(P.sep(spark, d)), 1000, 252)


@query(
    "leakage_violations",
    """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS pred, CAST(o_orderdate AS DATE) + 45 AS disclosure, CAST(o_orderdate AS DATE) - 1 AS action, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 - 1 AS INTEGER) AS filing FROM orders)
SELECT 'trades' AS source, count(*) FILTER (disclosure > pred) AS violations FROM t UNION ALL SELECT 'bills', count(*) FILTER (action > pred) FROM t UNION ALL SELECT 'lobbying', count(*) FILTER (filing > pred) FROM t""",
)
def _leakage(spark, d):
    day = F.col("o_orderdate").cast("date")
    df = P.read(spark, d, "orders").select(day.alias("prediction_date"), F.date_add(day, 45).alias("disclosure_date"), F.date_add(day, -1).alias("action_date"), F.date_add(day, (F.col("o_orderkey") % 3 - 1).cast("int")).alias("filing_date"))
    return labels.leakage(df, {"trades": "disclosure_date", "bills": "action_date", "lobbying": "filing_date"})


# ---------------------------------------------------------------------------------------------- quality reports

_QB = {"price_behavior": ["px_return_1d", "px_return_21d", "px_drawdown_252d"], "valuation": ["val_earnings_yield", "val_sales_yield"], "legacy_rsi": []}
_QCTE = (
    _VAL_CTE
    + ", q AS (SELECT ticker, date, " + ", ".join(f"{_PRICE[c]} AS {c}" for c in _QB["price_behavior"]) + ", 1.0 / NULLIF(pe, 0) AS val_earnings_yield, 1.0 / NULLIF(ps, 0) AS val_sales_yield, CAST(NULL AS DOUBLE) AS liq_turnover, "
    + ", ".join(f"lead(closeadj, {h}) OVER (PARTITION BY ticker ORDER BY date) / closeadj - 1 AS target_{h}d" for h in (5, 21))
    + " FROM px LEFT JOIN dr USING (ticker, date))"
)


def _feature_panel(spark, d):
    df = features.price(P.prices(spark, d)).select("ticker", "date", "closeadj", *_QB["price_behavior"])
    df = features.valuation(df, P.daily_ratios(spark, d)).withColumn("liq_turnover", F.lit(None).cast("double"))
    return labels.forward(df)


_NULLS = [*_QB["price_behavior"], *_QB["valuation"], "liq_turnover", "target_5d", "target_21d"]


@query("quality_nulls", f"WITH {_QCTE} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM q" for c in _NULLS))
def _quality_nulls(spark, d):
    return reports.null_counts(_feature_panel(spark, d), _NULLS)


@query(
    "quality_keys",
    f"WITH {_RAW}, r AS (SELECT CASE WHEN volume <> 13 THEN ticker END AS ticker, CASE WHEN volume <> 17 THEN date END AS date FROM raw) SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM (SELECT 1 FROM r WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY ticker, date HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM r WHERE ticker IS NULL) AS null_tickers, (SELECT count(*) FROM r WHERE date IS NULL) AS null_dates",
)
def _quality_keys(spark, d):
    df = P.sep(spark, d).select(F.when(F.col("volume") != 13, F.col("ticker")).alias("ticker"), F.when(F.col("volume") != 17, F.col("date")).alias("date"))
    return reports.key_report(df)


def _bucket_sql(cols: list[str], extra: str = "") -> str:
    if not cols:
        return "CAST(0 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS rows_any, CAST(0 AS BIGINT) AS rows_all, CAST(0 AS BIGINT) AS null_values" + (", CAST(0 AS BIGINT) AS rows_all_with_target" if extra else "")
    any_, all_, nulls = " OR ".join(f"{c} IS NOT NULL" for c in cols), " AND ".join(f"{c} IS NOT NULL" for c in cols), " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cols)
    return f"CAST({len(cols)} AS BIGINT) AS columns, count(*) FILTER ({any_}) AS rows_any, count(*) FILTER ({all_}) AS rows_all, {nulls} AS null_values" + (f", count(*) FILTER ({all_} AND {extra} IS NOT NULL) AS rows_all_with_target" if extra else "")


@query("quality_buckets", f"WITH {_QCTE} " + " UNION ALL ".join(f"SELECT '{k}' AS bucket, {_bucket_sql(v)}" + (" FROM q" if v else "") for k, v in _QB.items()))
def _quality_buckets(spark, d):
    return reports.bucket_report(_feature_panel(spark, d), _QB)


@query(
    "quality_bucket_splits",
    f"WITH {_QCTE}, s AS (SELECT q.*, CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date >= DATE '2000-01-01' THEN 'test' END AS split FROM q) " + " UNION ALL ".join(f"SELECT '{p}' AS split, count(*) AS split_rows, '{k}' AS bucket, {_bucket_sql(v, 'target_21d')} FROM s WHERE split = '{p}'" for p in ("train", "validation", "test") for k, v in _QB.items()),
)
def _quality_bucket_splits(spark, d):
    df = _feature_panel(spark, d).withColumn("split", F.when(F.col("date") < "1999-01-01", "train").when(F.col("date") >= "2000-01-01", "test"))
    return reports.bucket_split_report(df, _QB, "target_21d")


@query("quality_policy", f"WITH {_QCTE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN count({c}) = 0 THEN 'skipped' WHEN count({c}) < count(*) THEN 'partial' ELSE 'available' END AS status FROM q" for c in ("liq_turnover", "val_sales_yield", "ticker")))
def _quality_policy(spark, d):
    return reports.policy_report(_feature_panel(spark, d), ["liq_turnover", "val_sales_yield", "ticker"])


@query(
    "quality_targets",
    f"WITH {_QCTE} "
    + " UNION ALL ".join(
        f"SELECT '{h}d' AS horizon, count(t) AS target_available, count(*) - count(t) AS target_null, count(w) AS winner_available, count(*) - count(w) AS winner_null, count(*) FILTER (t IS NOT NULL AND w IS NULL) AS unexpected_winner_nulls, count(*) FILTER (t IS NULL AND w IS NOT NULL) AS unexpected_winner_values, count(*) FILTER (w NOT IN (0, 1)) AS invalid_winner_values FROM (SELECT target_{h}d AS t, CAST(target_{h}d > 0 AS INTEGER) AS w FROM q)"
        for h in (5, 21)
    ),
)
def _quality_targets(spark, d):
    return reports.target_report(_feature_panel(spark, d))


# ------------------------------------------------------------------------------------------------ policy signals


@query(
    "pit_disclosed_trades",
    f"""WITH {_PX}, t AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) + 45 AS d, o_orderkey % 3 = 0 AS sell, o_totalprice AS a FROM orders)
SELECT px.ticker, px.date, count(*) FILTER (NOT sell) AS buy_count_90d, count(*) FILTER (sell) AS sell_count_90d, {_r("coalesce(sum(CASE WHEN sell THEN -a ELSE a END), 0)", 3)} AS net_buy_amount_90d FROM px LEFT JOIN t ON t.ticker = px.ticker AND t.d <= px.date AND t.d > px.date - 90 GROUP BY 1, 2""",
)
def _pit(spark, d):
    return _round(asof.disclosed(P.prices(spark, d), P.trades(spark, d)), {"net_buy_amount_90d": 3})


_TRAIL = "t AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2)"


@query("trailing_spend", f"WITH {_TRAIL} SELECT ticker, date, " + ", ".join(f"{_r(f'sum(x) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)', 3)} AS spend_{n}d" for n in (30, 90, 365)) + " FROM t")
def _trailing_spend(spark, d):
    ev = P.trades(spark, d).select("ticker", F.col("transaction_date").alias("date"), "amount")
    return _round(asof.trailing_sum(ev, "ticker", "date", "amount", [30, 90, 365], "spend"), {f"spend_{n}d": 3 for n in (30, 90, 365)})


@query(
    "trailing_yoy",
    f"WITH {_TRAIL} SELECT ticker, date, {_r('sum(x) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW) / NULLIF(sum(x) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 729 DAYS PRECEDING AND INTERVAL 365 DAYS PRECEDING), 0) - 1')} AS spend_yoy FROM t",
)
def _trailing_yoy(spark, d):
    ev = P.trades(spark, d).select("ticker", F.col("transaction_date").alias("date"), "amount")
    return _round(asof.year_over_year(ev, "ticker", "date", "amount", "spend_yoy"), {"spend_yoy": 6})


_ACTION = {"view": "introduced", "click": "committee_hearing", "error": "markup", "purchase": "passed_house", "signup": "other"}


@query(
    "bill_activity",
    """WITH e AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, sum(CASE event_type WHEN 'view' THEN 0.25 WHEN 'click' THEN 1.0 WHEN 'error' THEN 1.5 WHEN 'purchase' THEN 3.0 ELSE 0.0 END) AS w FROM events GROUP BY 1, 2)
SELECT entity, date, CAST(sum(w) OVER (PARTITION BY entity ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS bill_activity_30d, CAST(sum(w) OVER (PARTITION BY entity ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS bill_activity_90d FROM e""",
)
def _bill_activity(spark, d):
    name = F.element_at(F.create_map(*[F.lit(x) for p in _ACTION.items() for x in p]), F.col("event_type"))
    return policy.bill_activity(P.read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("date"), name.alias("action")))


_KEYWORDS = {"metal": ["ring", "bolt", "gear"], "colour": ["RED", "blue"]}


@query("keyword_relevance", "SELECT p_partkey, CAST((contains(lower(p_name), 'ring'))::INT + (contains(lower(p_name), 'bolt'))::INT + (contains(lower(p_name), 'gear'))::INT AS BIGINT) AS relevance_metal, CAST((contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'blue'))::INT AS BIGINT) AS relevance_colour FROM part")
def _keyword_relevance(spark, d):
    return policy.keyword_relevance(P.read(spark, d, "part"), "p_name", _KEYWORDS).select("p_partkey", "relevance_metal", "relevance_colour")


_ASSIGN = "a AS (SELECT c_custkey AS member, c_nationkey AS committee, CASE c_custkey % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'ranking_member' WHEN 2 THEN 'subcommittee_chair' ELSE 'member' END AS role, DATE '1995-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS s, CASE WHEN c_custkey % 3 <> 0 THEN DATE '1997-01-01' + CAST(c_custkey % 700 AS INTEGER) END AS e FROM customer)"


@query(
    "committee_relevance",
    f"""WITH {_ASSIGN}, o AS (SELECT s_nationkey AS committee, s_suppkey AS company, (s_suppkey % 5) / 4.0 AS overlap FROM supplier), q AS (SELECT unnest([DATE '1995-06-01', DATE '1996-06-01', DATE '1997-06-01', DATE '1999-01-01']) AS date),
p AS (SELECT q.date, committee, sum(CASE role WHEN 'chair' THEN 3.0 WHEN 'ranking_member' THEN 2.5 WHEN 'subcommittee_chair' THEN 2.0 ELSE 1.0 END) AS power FROM q JOIN a ON a.s <= q.date AND (a.e IS NULL OR a.e >= q.date) GROUP BY 1, 2)
SELECT q.date, company, {_r("CAST(sum(coalesce(power, 0) * overlap) AS DOUBLE)")} AS committee_relevance_score FROM q CROSS JOIN o LEFT JOIN p ON p.date = q.date AND p.committee = o.committee GROUP BY 1, 2""",
)
def _committee_relevance(spark, d):
    k = F.col("c_custkey")
    roles = F.element_at(F.array(*[F.lit(r) for r in ("chair", "ranking_member", "subcommittee_chair", "member")]), (k % 4 + 1).cast("int"))
    a = P.read(spark, d, "customer").select(k.alias("member"), F.col("c_nationkey").alias("committee"), roles.alias("role"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 1000).cast("int")).alias("start"), F.when(k % 3 != 0, F.date_add(F.lit("1997-01-01").cast("date"), (k % 700).cast("int"))).alias("end"))
    o = P.read(spark, d, "supplier").select(F.col("s_nationkey").alias("committee"), F.col("s_suppkey").alias("company"), (F.col("s_suppkey") % 5 / 4.0).alias("overlap"))
    days = spark.createDataFrame([(x,) for x in ("1995-06-01", "1996-06-01", "1997-06-01", "1999-01-01")], "date string").select(F.col("date").cast("date"))
    return _round(policy.committee_relevance(a, o, days), {"committee_relevance_score": 6})


@query("agency_concentration", f"WITH p AS (SELECT l_suppkey AS entity, l_returnflag || l_linestatus AS part, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2), s AS (SELECT *, a / sum(a) OVER (PARTITION BY entity) AS s FROM p) SELECT entity, {_r('max(s)')} AS top_share, {_r('sum(s * s)')} AS hhi FROM s GROUP BY entity")
def _agency_concentration(spark, d):
    df = P.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("part"), F.col("l_extendedprice").alias("a"))
    return _round(policy.concentration(df, "entity", "part", "a"), {"top_share": 6, "hhi": 6})


_EDGES = """edges AS (SELECT src, dst, edge_type, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'member_of' AS edge_type, 1.0 AS w FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'oversees', 0.5 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 1.0 FROM nation) GROUP BY 1, 2, 3)"""


def _graph(spark, d):
    c = P.read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"), F.lit(1.0).alias("weight"))
    s = P.read(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("a"), F.concat(F.lit("s"), "s_suppkey").alias("b"), F.lit(0.5).alias("weight"))
    n = P.read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"), F.lit(1.0).alias("weight"))
    return policy.edges({"member_of": (c, "a", "b"), "oversees": (s, "a", "b"), "part_of": (n, "a", "b")})


@query("graph_edges", f"WITH {_EDGES} SELECT * FROM edges")
def _graph_edges(spark, d):
    return _graph(spark, d)


@query("graph_two_hop", f"WITH {_EDGES} SELECT a.src, b.dst, count(*) AS paths, sum(a.weight * b.weight) AS weight FROM edges a JOIN edges b ON a.dst = b.src WHERE a.edge_type = 'member_of' AND b.edge_type = 'part_of' GROUP BY 1, 2")
def _graph_two_hop(spark, d):
    return policy.two_hop(_graph(spark, d), "member_of", "part_of")


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'), '\\b(INC|CORP|CORPORATION|CO|COMPANY|LTD|LLC|PLC|GROUP|HOLDINGS)\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query("entity_normalize", f"SELECT c_custkey, {_NORM.format('n')} AS name FROM (SELECT c_custkey, c_name || ', ' || c_mktsegment || ' Holdings Co. Inc' AS n FROM customer)")
def _entity_normalize(spark, d):
    return P.read(spark, d, "customer").select("c_custkey", normal_name(F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" Holdings Co. Inc"))).alias("name"))


_REC = "rec AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'T' || (p_partkey % 40) END AS ticker, CASE WHEN p_partkey % 5 = 1 THEN 'C' || (p_partkey % 40) END AS cik, p_name || CASE p_partkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN 's' ELSE ' works' END AS name FROM part), com AS (SELECT p_partkey AS id, 'T' || p_partkey AS ticker, 'C' || p_partkey AS cik, p_name || ' Corp' AS name FROM part)"
_FUZZY = f"""fa AS (SELECT id AS left_id, {_NORM.format("name")} AS na FROM {{left}}), fb AS (SELECT id AS right_id, {_NORM.format("name")} AS nb FROM com),
fz1 AS (SELECT *, 1 - levenshtein(na, nb) / greatest(length(na), length(nb), 1) AS score FROM fa JOIN fb ON split_part(na, ' ', 1) = split_part(nb, ' ', 1) AND abs(length(na) - length(nb)) <= (1 - 0.8) * greatest(length(na), length(nb))),
fz AS (SELECT left_id, right_id, score FROM fz1 WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1)"""


def _records(spark, d):
    k = F.col("p_partkey")
    part = P.read(spark, d, "part")
    tail = F.element_at(F.array(F.lit(" Inc."), F.lit("s"), F.lit(" works")), (k % 3 + 1).cast("int"))
    rec = part.select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("T"), k % 40)).alias("ticker"), F.when(k % 5 == 1, F.concat(F.lit("C"), k % 40)).alias("cik"), F.concat("p_name", tail).alias("name"))
    com = part.select(k.alias("id"), F.concat(F.lit("T"), k).alias("ticker"), F.concat(F.lit("C"), k).alias("cik"), F.concat("p_name", F.lit(" Corp")).alias("name"))
    return rec, com


@query("entity_fuzzy", f"WITH {_REC}, {_FUZZY.format(left='rec')} SELECT left_id, right_id, {_r('score')} AS score FROM fz")
def _entity_fuzzy(spark, d):
    return _round(policy.fuzzy_matches(*_records(spark, d)), {"score": 6})


_CASCADE = (
    f"""{_REC}, r1 AS (SELECT rec.id AS record_id, min(com.id) AS company_id, 'ticker' AS method, 1.0 AS confidence FROM rec JOIN com USING (ticker) GROUP BY 1),
r2 AS (SELECT rec.id AS record_id, min(com.id) AS company_id, 'cik' AS method, 0.99 AS confidence FROM rec JOIN com USING (cik) WHERE rec.id NOT IN (SELECT record_id FROM r1) GROUP BY 1),
l2 AS (SELECT * FROM rec WHERE id NOT IN (SELECT record_id FROM r1) AND id NOT IN (SELECT record_id FROM r2)),
r3 AS (SELECT l2.id AS record_id, min(com.id) AS company_id, 'exact_name' AS method, 0.95 AS confidence FROM l2 JOIN com ON {_NORM.format("l2.name")} = {_NORM.format("com.name")} GROUP BY 1),
l3 AS (SELECT * FROM l2 WHERE id NOT IN (SELECT record_id FROM r3)), {_FUZZY.format(left="l3")},
res AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT left_id, right_id, 'fuzzy_name', score FROM fz)"""
)


@query("entity_cascade", f"WITH {_CASCADE} SELECT record_id, company_id, method, {_r('CAST(confidence AS DOUBLE)')} AS confidence FROM res")
def _entity_cascade(spark, d):
    return _round(policy.cascade(*_records(spark, d)), {"confidence": 6})


@query("entity_review_queue", f"WITH {_CASCADE} SELECT id AS record_id, 'unmatched' AS reason FROM rec WHERE id NOT IN (SELECT record_id FROM res) UNION ALL SELECT record_id, 'low_confidence' FROM res WHERE confidence < 0.9")
def _entity_review_queue(spark, d):
    rec, com = _records(spark, d)
    return policy.review_queue(rec, policy.cascade(rec, com))


# ------------------------------------------------------------------------------------- confirmation, flows, disclosure

_RSI = "rsi0 AS (SELECT ticker, date, closeadj - lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) AS c FROM px), rsi1 AS (SELECT ticker, date, count(c) OVER k AS n, avg(CASE WHEN c IS NOT NULL THEN greatest(c, 0.0) END) OVER k AS g, avg(CASE WHEN c IS NOT NULL THEN greatest(-c, 0.0) END) OVER k AS l FROM rsi0 WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)), rsi2 AS (SELECT ticker, date, CASE WHEN n = 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi_14 FROM rsi1)"


@query(
    "market_confirmation",
    f"""WITH {_RET}, {_META}, {_RSI}, a AS (SELECT ret.ticker, ret.date, rsi_14, sector, {", ".join(f"closeadj / lag(closeadj, {k}) OVER t - 1 AS return_{k}d" for k in (20, 60, 90))},
  CASE WHEN count(r) OVER (PARTITION BY ret.ticker ORDER BY ret.date ROWS 19 PRECEDING) = 20 THEN stddev_samp(r) OVER (PARTITION BY ret.ticker ORDER BY ret.date ROWS 19 PRECEDING) * sqrt(252) END AS volatility_20d,
  CASE WHEN count(volume) OVER (PARTITION BY ret.ticker ORDER BY ret.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN volume / avg(volume) OVER (PARTITION BY ret.ticker ORDER BY ret.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS volume_surge_20d,
  CASE WHEN count(rsi_14) OVER (PARTITION BY ret.ticker ORDER BY ret.date ROWS 19 PRECEDING) = 20 THEN (rsi_14 - min(rsi_14) OVER (PARTITION BY ret.ticker ORDER BY ret.date ROWS 19 PRECEDING)) / 100 END AS rsi_recovery_score
  FROM ret JOIN rsi2 USING (ticker, date) LEFT JOIN (SELECT ticker, sector FROM meta) m ON m.ticker = ret.ticker WINDOW t AS (PARTITION BY ret.ticker ORDER BY ret.date)),
b AS (SELECT *, CASE WHEN sector IS NOT NULL THEN avg(return_20d) OVER (PARTITION BY sector, date) END AS sector_return_20d FROM a)
SELECT ticker, date, {", ".join(f"{_r(c)} AS {c}" for c in ("return_20d", "return_60d", "return_90d", "volatility_20d", "volume_surge_20d", "rsi_recovery_score", "sector_return_20d"))}, {_r("return_20d - sector_return_20d")} AS sector_excess_return_20d FROM b""",
)
def _market_confirmation(spark, d):
    names = ["return_20d", "return_60d", "return_90d", "volatility_20d", "volume_surge_20d", "rsi_recovery_score", "sector_return_20d", "sector_excess_return_20d"]
    df = signals.market_confirmation(P.prices(spark, d), dedup.latest_metadata(P.tickers(spark, d)))
    return _round(df.select("ticker", "date", *names), dict.fromkeys(names, 6))


_LOB = "lob AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS bill, (o_orderkey % 7) * 0.5 AS relevance, CAST(o_custkey % 5 AS VARCHAR) AS industry, o_orderkey % 13 AS member, o_orderpriority AS award_type FROM orders)"


def _reports(spark, d):
    k = F.col("o_orderkey")
    return P.read(spark, d, "orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("amount"), F.when(k % 7 > 0, k % 7).alias("bill"),
        ((k % 7) * 0.5).cast("double").alias("relevance"), (F.col("o_custkey") % 5).cast("string").alias("industry"), (k % 13).alias("member"), F.element_at(F.create_map(*[F.lit(x) for kind in _KINDS.items() for x in kind]), F.col("o_orderpriority")).alias("award_type"),
    )


_KINDS = {"1-URGENT": "definitive_contract", "2-HIGH": "indefinite_delivery", "3-MEDIUM": "grant", "5-LOW": "purchase_order"}
_ROLL = lambda n, by="ticker": f"sum(x) OVER (PARTITION BY {by} ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"
_YOY = f"{_ROLL(365)} / NULLIF(sum(x) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 729 DAYS PRECEDING AND INTERVAL 365 DAYS PRECEDING), 0) - 1"


@query(
    "lobbying_intensity",
    f"""WITH {_LOB}, t AS (SELECT ticker, date, sum(amount) AS x FROM lob GROUP BY 1, 2),
n AS (SELECT t.ticker, t.date, count(DISTINCT bill) AS c, coalesce(sum(DISTINCT relevance) FILTER (bill IS NOT NULL), 0) AS v FROM t JOIN lob ON lob.ticker = t.ticker AND lob.date <= t.date AND lob.date > t.date - 90 GROUP BY 1, 2)
SELECT t.ticker, t.date, {_r(_ROLL(90, "t.ticker").replace("BY date", "BY t.date"), 3)} AS lobbying_spend_90d, {_r(_ROLL(365, "t.ticker").replace("BY date", "BY t.date"), 3)} AS lobbying_spend_365d, {_r(_YOY.replace("BY ticker", "BY t.ticker").replace("BY date", "BY t.date"))} AS lobbying_spend_yoy, c AS specific_bill_count_90d, CAST(v AS DOUBLE) AS lobbying_bill_relevance_score FROM t JOIN n USING (ticker, date)""",
)
def _lobbying(spark, d):
    return _round(signals.lobbying_intensity(_reports(spark, d)), {"lobbying_spend_90d": 3, "lobbying_spend_365d": 3, "lobbying_spend_yoy": 6})


@query(
    "pac_flows",
    f"""WITH {_LOB}, g AS (SELECT * FROM lob WHERE member < 6), t AS (SELECT ticker, date, any_value(industry) AS industry, sum(amount) AS x FROM g GROUP BY 1, 2), i0 AS (SELECT industry, date, sum(amount) AS x FROM g GROUP BY 1, 2),
i AS (SELECT industry, date, {_ROLL(180, "industry")} AS y FROM i0), own AS (SELECT ticker, date, industry, {_ROLL(180)} AS x, {_YOY} AS yoy FROM t), h0 AS (SELECT ticker, member, sum(amount) AS a FROM lob GROUP BY 1, 2), h AS (SELECT ticker, sum(a * a) / pow(sum(a), 2) AS hhi FROM h0 GROUP BY 1)
SELECT ticker, date, industry, {_r("own.x", 3)} AS company_pac_to_relevant_member_180d, {_r("i.y", 3)} AS industry_pac_to_relevant_committee_180d, {_r("yoy")} AS pac_flow_yoy_change, {_r("hhi")} AS donor_cluster_score FROM own JOIN i USING (industry, date) JOIN h USING (ticker)""",
)
def _pac(spark, d):
    rows = _reports(spark, d)
    df = signals.pac_flows(rows, rows.where("member < 6").select("member"))
    return _round(df, {"company_pac_to_relevant_member_180d": 3, "industry_pac_to_relevant_committee_180d": 3, "pac_flow_yoy_change": 6, "donor_cluster_score": 6})


@query(
    "contract_type_score",
    f"""WITH {_LOB}, t AS (SELECT ticker, date, sum(amount) AS a, sum(amount * CASE award_type WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 WHEN '5-LOW' THEN 0.25 ELSE 0 END) AS w FROM lob GROUP BY 1, 2)
SELECT ticker, date, {_r(_ROLL(365).replace("sum(x)", "sum(w)") + " / " + _ROLL(365).replace("sum(x)", "sum(a)"))} AS contract_type_score FROM t""",
)
def _contract_type(spark, d):
    return _round(signals.contract_type_score(_reports(spark, d)), {"contract_type_score": 6})


@query("trade_invariant", "SELECT count(*) AS n_trades, count(*) FILTER (a > b) AS n_late, count(*) FILTER (p IS DISTINCT FROM b) AS n_misdated FROM (SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 2 AS INTEGER) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 2 AS INTEGER) AS p FROM orders)")
def _trade_invariant(spark, d):
    rows = P.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("transaction_date"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 50 - 2).cast("int")).alias("disclosure_date"))
    return signals.trade_violations(signals.with_public_date(rows, "congress_trades"))


# -------------------------------------------------------------------------------------------- portfolio, metrics

_SCORE = _PX + ", sc0 AS (SELECT ticker, date, round(closeadj / lag(closeadj, 5) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS score, round(lead(closeadj, 5) OVER (PARTITION BY ticker ORDER BY date) / closeadj - 1, 6) AS target FROM px), sc AS (SELECT * FROM sc0 WHERE score IS NOT NULL)"


def _scores(spark, d):
    df = labels.forward(features.price(P.prices(spark, d)), (5,))
    return df.select("ticker", "date", F.round("px_return_5d", 6).alias("score"), F.round("target_5d", 6).alias("target")).where("score IS NOT NULL")


@query(
    "cost_sqrt_impact",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS o, CASE WHEN l_quantity < 3 THEN 0.0 ELSE l_extendedprice * l_quantity END AS adv, 0.01 + l_discount / 10 AS v, l_discount, l_tax, l_quantity FROM lineitem),
b AS (SELECT *, CASE WHEN adv <= 0 THEN 1e9 ELSE 0.75 * v * sqrt(o / adv) * 10000 END AS i FROM a)
SELECT l_orderkey, l_linenumber, o AS order_dollars, {_r("CASE WHEN adv > 0 THEN i END")} AS impact, adv <= 0 AS is_infinite, {_r("CASE WHEN adv > 0 THEN 5 + 1 + i END")} AS total_cost_bps, l_discount > (5 + 1 + i) / 10000 + 0.01 AND l_tax * 10 <= 0.5 AND l_discount * 4 <= 0.25 AND l_quantity >= 10 AS allowed FROM b""",
)
def _cost(spark, d):
    li = P.read(spark, d, "lineitem")
    adv = F.when(F.col("l_quantity") < 3, 0.0).otherwise(F.col("l_extendedprice") * F.col("l_quantity"))
    df = li.withColumns({"adv": adv, "v": 0.01 + F.col("l_discount") / 10}).withColumn("i", impact_bps(F.col("l_extendedprice"), F.col("adv"), F.col("v")))
    total = F.lit(5) + 1 + F.col("i")
    ok = trade_allowed(F.col("l_discount"), total / 10_000, 0.01, F.col("l_tax") * 10, F.col("l_discount") * 4, F.col("l_quantity") >= 10)
    has = F.col("adv") > 0
    return df.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("order_dollars"), rounded(F.when(has, F.col("i"))).alias("impact"), (F.col("i") == float("inf")).alias("is_infinite"), rounded(F.when(has, total)).alias("total_cost_bps"), ok.alias("allowed"))


@query("rank_bands", f"WITH {_SCORE}, p AS (SELECT ticker, date, score, percent_rank() OVER (PARTITION BY date ORDER BY score) AS pct FROM sc) SELECT ticker, date, score, {_r('pct')} AS pct, CASE WHEN pct >= 0.95 THEN 'buy' WHEN pct >= 0.80 THEN 'hold' WHEN pct < 0.60 THEN 'sell' ELSE 'watch' END AS band FROM p")
def _rank_bands(spark, d):
    return _round(portfolio.rank_bands(_scores(spark, d).select("ticker", "date", "score")), {"pct": 6})


@query("topk_per_date", f"WITH {_SCORE} SELECT ticker, date, score, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS rank FROM sc QUALIFY rank <= 25")
def _topk(spark, d):
    return portfolio.top_k(_scores(spark, d).select("ticker", "date", "score"), 25).withColumn("rank", F.col("rank").cast("long"))


@query(
    "metric_rank_ic",
    f"""WITH {_SCORE}, t AS (SELECT * FROM sc WHERE target IS NOT NULL), k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2.0 AS b FROM t)
SELECT date, count(*) AS n, {_r("CASE WHEN var_samp(a) > 0 AND var_samp(b) > 0 THEN corr(a, b) END")} AS rank_ic FROM k GROUP BY date""",
)
def _rank_ic(spark, d):
    return _round(portfolio.rank_ic(_scores(spark, d)), {"rank_ic": 6})


@query("metric_decile", f"WITH {_SCORE}, t AS (SELECT ntile(10) OVER (PARTITION BY date ORDER BY score, ticker) AS decile, target FROM sc WHERE target IS NOT NULL) SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, {_r('avg(target)')} AS mean_target FROM t GROUP BY decile")
def _decile(spark, d):
    return _round(portfolio.decile_means(_scores(spark, d)), {"mean_target": 6})


def _ablation_sql() -> str:
    pr = lambda c: f"CASE WHEN {c} IS NOT NULL THEN percent_rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) END"
    parts = []
    for name, score in (("momentum", "m"), ("momentum_volume", "(m + v) / 2")):
        parts.append(
            f"""SELECT '{name}' AS variant, count(ic) AS n_dates, {_r("avg(ic)")} AS mean_rank_ic FROM (SELECT date, CASE WHEN var_samp(a) > 0 AND var_samp(b) > 0 THEN corr(a, b) END AS ic FROM (SELECT date,
rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2.0 AS b
FROM (SELECT date, round({score}, 9) AS s, target FROM ab WHERE target IS NOT NULL AND {score} IS NOT NULL)) GROUP BY date)"""
        )
    return f"WITH {_SCORE}, sv AS (SELECT sc0.*, px.volume FROM sc0 JOIN px USING (ticker, date)), ab AS (SELECT date, target, {pr('score')} AS m, {pr('volume')} AS v FROM sv) " + " UNION ALL ".join(parts)


@query("ablation", _ablation_sql())
def _ablation(spark, d):
    df = labels.forward(features.price(P.prices(spark, d)), (5,))
    df = df.select("ticker", "date", "volume", F.round("px_return_5d", 6).alias("score"), F.round("target_5d", 6).alias("target"))
    return _round(portfolio.ablation(df, {"momentum": ["score"], "momentum_volume": ["score", "volume"]}), {"mean_rank_ic": 6})


_SERIES = "ser AS (SELECT date, rb / 1000 AS r FROM bench)"
_DD = _BENCH + f", {_SERIES}, eq AS (SELECT date, r, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS equity FROM ser), dd AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY date), 1.0) - 1 AS drawdown FROM eq)"


def _series(spark, d):
    return features.benchmark_returns(features.benchmark(P.prices(spark, d))).select("date", (F.col("rb") / 1000).alias("r"))


@query("metric_drawdown", f"WITH {_DD} SELECT date, {_r('equity')} AS equity, {_r('drawdown')} AS drawdown FROM dd")
def _drawdown(spark, d):
    return _round(portfolio.drawdown(_series(spark, d)), {"equity": 6, "drawdown": 6})


_SUM = ["mean", "volatility", "sharpe", "sortino", "hit_rate", "max_drawdown", "cagr"]


@query(
    "metric_summary",
    f"""WITH {_DD}, a AS (SELECT count(r) AS n_days, avg(r) AS mean, stddev_samp(r) AS volatility, sqrt(avg(pow(least(r, 0.0), 2))) AS d, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM ser WHERE r IS NOT NULL), b AS (SELECT min(drawdown) AS max_drawdown, max_by(equity, date) AS e FROM dd)
SELECT n_days, {_r("mean")} AS mean, {_r("volatility")} AS volatility, {_r("mean / volatility * sqrt(252)")} AS sharpe, {_r("mean / d * sqrt(252)")} AS sortino, {_r("hit_rate")} AS hit_rate, {_r("max_drawdown")} AS max_drawdown, {_r("pow(e, 252.0 / n_days) - 1")} AS cagr FROM a, b""",
)
def _summary(spark, d):
    return _round(portfolio.summary(_series(spark, d)), dict.fromkeys(_SUM, 6))


@query("portfolio_simulate")
def _simulate(spark, d):
    meta = dedup.latest_metadata(P.tickers(spark, d)).select("ticker", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"))
    month = F.last_day("date")
    bands = portfolio.rank_bands(_scores(spark, d).withColumn("m", month).groupBy("ticker", "m").agg(F.max_by("score", "date").alias("score")).select("ticker", F.col("m").alias("date"), "score"))
    return portfolio.simulate(bands.join(few(meta), "ticker").select(F.lit("all").alias("portfolio"), "ticker", "date", "sector", "pct"))
