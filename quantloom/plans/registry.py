"""Every reference operator as a query over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.operators import calendar as cal
from quantloom.operators import factors as fac
from quantloom.operators import frames as fr
from quantloom.operators import least_squares as ls
from quantloom.operators import matrices as mx
from quantloom.operators import portfolio as pf
from quantloom.operators import ranks as rk
from quantloom.operators import statistics as st
from quantloom.plans import panels as P
from quantloom.plans.pipelines import momentum_backtest, performance_block, run_factors, small_tearsheet
from quantloom.sources import universe as uni
from quantloom.sources.files import canonical_prices, standard_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(body: str | None = None, *doubles: str) -> Callable[[Query], Query]:
    """Register a function under its name; body: its SQL, doubles: the columns to round."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (lambda s, d: P.rounded(f(s, d)))
        if body:
            ORACLES[f.__name__] = P.sql(body, *doubles)
        return f

    return add


# Panels, sources and reshaping


@query("SELECT upper(ticker) AS ticker, date, adj_close FROM prices", "adj_close")
def s4_prices(s, d):
    return canonical_prices(P.prices(s, d).withColumnRenamed("ticker", "Symbol ")).select("ticker", "date", "adj_close")


@query("SELECT * FROM funda", "pe_ttm", "shares_out", "net_income_ttm", "shareholders_equity", "total_debt")
def s4_fundamentals(s, d):
    return P.funda(s, d)


@query('SELECT symbol, timestamp, open, high, low, close, close AS adj_close, volume FROM (SELECT upper(symbol) AS symbol, "timestamp", open, high, low, close, volume FROM bars)', "open", "high", "low", "close", "adj_close", "volume")
def s9_standard_bars(s, d):
    return standard_bars(P.bars_1h(s, d))


@query("SELECT ticker AS symbol, date, coalesce(a.pe_ttm, b.total_debt / 1000) AS pe_ttm, shares_out, b.total_debt FROM funda a FULL JOIN (SELECT ticker, date, total_debt FROM funda WHERE month(date) <> 1) b USING (ticker, date)", "pe_ttm", "shares_out", "total_debt")
def s6_merge_fundamentals(s, d):
    df = P.funda(s, d).withColumnRenamed("ticker", "symbol")
    other = df.filter(F.month("date") != 1).select("symbol", "date", (F.col("total_debt") / 1000).alias("pe_ttm"), "total_debt")
    return fr.merge_first_wins(df.select("symbol", "date", "pe_ttm", "shares_out"), other)


@query("SELECT ticker, date, CASE WHEN date >= DATE '1998-01-01' THEN -adj_close ELSE adj_close END AS adj_close FROM prices", "adj_close")
def s12_upsert(s, d):
    px = P.prices(s, d)
    late = px.filter("date >= DATE'1998-01-01'").withColumn("nth", F.explode(F.array(F.lit(1), F.lit(2))))
    late = late.withColumn("adj_close", F.when(F.col("nth") == 2, -F.col("adj_close")).otherwise(F.lit(7.0)))
    return fr.upsert(px, late, ["ticker", "date"], order=F.col("nth"))


@query("SELECT p_brand AS ticker, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(*) > 1")
def s14_duplicate_keys(s, d):
    return fr.duplicate_keys(s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("ticker")), ["ticker"])


@query("SELECT date, upper(ticker) AS ticker, adj_close FROM pgrid", "adj_close")
def r1_wide_to_long(s, d):
    return fr.wide_to_long(fr.long_to_wide(P.prices(s, d), None, "ticker", "adj_close", "adj_close_"))


@query("SELECT date, " + ", ".join(f"max(ret) FILTER (ticker = '{b}') AS \"ret_{b}\"" for b in P.BRANDS) + " FROM rets GROUP BY date", *(f'"ret_{b}"' for b in P.BRANDS))
def r2_long_to_wide(s, d):
    return fr.long_to_wide(pf.asset_returns(P.prices(s, d)), None, "ticker", "ret")


@query("SELECT date, upper(ticker) AS ticker, adj_close AS px, ret FROM prices JOIN rets USING (date, ticker) WHERE ret IS NOT NULL", "px", "ret")
def r4_stack_matrices(s, d):
    px = P.prices(s, d)
    out = fr.stack_panels(px.withColumnRenamed("adj_close", "px"), pf.asset_returns(px), "px", "ret")
    return out.withColumn("ticker", F.upper("ticker"))


@query("SELECT ticker, date, adj_close FROM prices QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date) = 1", "adj_close")
def r9_dedup_first(s, d):
    px = P.prices(s, d).withColumn("month", F.date_trunc("month", "date"))
    return fr.dedup_first(px, ["ticker", "month"], [F.col("date")]).drop("month")


@query("SELECT ticker, date, adj_close FROM prices QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) = 1", "adj_close")
def r10_dedup_last(s, d):
    px = P.prices(s, d).withColumn("month", F.date_trunc("month", "date"))
    return fr.dedup_first(px, ["ticker", "month"], [F.desc("date")]).drop("month")


@query("SELECT date FROM weekly GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM weekly)")
def r11_common_dates(s, d):
    return fr.common_times(P.prices(s, d, "week"))


@query("SELECT date, ticker, adj_close FROM prices ORDER BY adj_close DESC, date, ticker LIMIT 20", "adj_close")
def r13_top_k(s, d):
    return P.prices(s, d).orderBy(F.desc("adj_close"), "date", "ticker").limit(20).select("date", "ticker", "adj_close")


@query("SELECT date, ticker, rank, coalesce(rank = 5, false) AS is_long, coalesce(rank = 1, false) AS is_short FROM ranks", "rank")
def r14_flags(s, d):
    return pf.flags(ranked(s, d)).select("date", "ticker", "rank", "is_long", "is_short")


@query("SELECT date, ticker, rank FROM ranks WHERE rank IN (1, 5)", "rank")
def r15_extremes(s, d):
    return pf.extremes(ranked(s, d)).select("date", "ticker", "rank")


@query("SELECT ticker, date, last_value(pe_ttm IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pe_ttm FROM funda", "pe_ttm")
def r16_fill_forward(s, d):
    return fr.fill_forward(P.funda(s, d), ["pe_ttm"]).select("ticker", "date", "pe_ttm")


# Universe and calendar


_OPEN = "isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('01-01', '07-04', '12-25')"
P.VIEWS["odays"] = "SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders)"
P.VIEWS["osessions"] = "SELECT unnest(range(a, b + INTERVAL 16 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders)"


def orders(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet")


@query(f"SELECT day, {_OPEN} AS open, n FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)")
def c1_is_trading_day(s, d):
    by = orders(s, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return by.select("day", cal.is_trading_day(F.col("day")).alias("open"), "n")


_SESSIONS = "SELECT day::date AS session FROM range(DATE '1992-01-01', DATE '1999-02-01', INTERVAL 1 DAY) t(day) WHERE isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('01-01', '07-04', '12-25')"


@query(f"SELECT ticker, date, (SELECT min(session) FROM ({_SESSIONS}) WHERE session >= funda.date) AS session FROM funda")
def c2_next_trading_day(s, d):
    days = cal.trading_days(s, "1992-01-01", "1999-01-31")
    return cal.next_trading_day(P.funda(s, d).select("ticker", "date"), days)


@query(f"SELECT day AS session FROM odays WHERE {_OPEN}")
def c3_sessions(s, d):
    return cal.opened(cal.days_over(orders(s, d), "o_orderdate"))


@query(f"SELECT day + m * INTERVAL 1 MINUTE AS session FROM (SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events)), (SELECT unnest([540, 600, 660, 720, 780, 840, 900, 930]) AS m) WHERE {_OPEN}")
def c3h_hourly_sessions(s, d):
    return cal.hours_of(cal.opened(cal.days_over(s.read.parquet(f"{d}/events.parquet"), "ts")))


@query(f"SELECT DISTINCT freq, (SELECT min(day) FROM osessions WHERE {_OPEN} AND day >= a) AS session FROM (SELECT 'M' AS freq, day AS a FROM odays WHERE day = last_day(day) UNION ALL SELECT 'Q', day FROM odays WHERE day = last_day(day) AND month(day) % 3 = 0 UNION ALL SELECT 'W', day FROM odays WHERE isodow(day) = 7)")
def c4_rebalance_dates(s, d):
    one = lambda f: cal.rebalance_dates_over(orders(s, d), "o_orderdate", f).select(F.lit(f).alias("freq"), "session")
    return one("M").unionByName(one("Q")).unionByName(one("W"))


@query(f"SELECT g.symbol, g.session AS date, f.total_debt, f.pe_ttm FROM (SELECT * FROM (SELECT DISTINCT ticker AS symbol FROM funda), ({_SESSIONS})) g ASOF LEFT JOIN (SELECT ticker AS symbol, date, total_debt, pe_ttm FROM funda) f ON g.symbol = f.symbol AND g.session >= f.date", "total_debt", "pe_ttm")
def c5_align_to_sessions(s, d):
    df = P.funda(s, d).withColumnRenamed("ticker", "symbol")
    return cal.align_to_sessions(df, cal.trading_days(s, "1992-01-01", "1999-01-31"), ["total_debt", "pe_ttm"])


@query("SELECT greatest(52, least(8760, round(365 * 86400.0 / median(gap))))::BIGINT AS periods_per_year FROM (SELECT epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS gap FROM (SELECT DISTINCT \"timestamp\" AS t FROM bars))")
def c7_periods_per_year(s, d):
    return cal.periods_per_year(P.bars_1h(s, d), "timestamp")


@query("SELECT DISTINCT upper(replace(trim(ticker), '/', '_')) AS symbol, CAST(NULL AS VARCHAR) AS sector FROM prices")
def u1_universe(s, d):
    return uni.cleaned(P.prices(s, d).select("ticker")).select("symbol", "sector")


@query("SELECT symbol FROM (SELECT symbol FROM universe WHERE adv > 25 UNION SELECT 'EXTRA') WHERE symbol NOT IN ('Brand#11', 'Brand#55')")
def u2_include_exclude(s, d):
    names = lambda *v: s.createDataFrame([(x,) for x in v], "symbol string")
    return uni.include_exclude(P.universe(s, d).filter("adv > 25"), names("EXTRA"), names("Brand#11", "Brand#55"))


@query("SELECT * FROM universe WHERE last_price >= 1000 AND adv * last_price >= 26000 AND market_cap >= 1000000", "last_price", "adv", "market_cap")
def u3_investable(s, d):
    return uni.investable(P.universe(s, d), 1000, 26000, 1e6)


# Joins


@query("SELECT date, ticker, adj_close, shareholders_equity, pe_ttm FROM pf", "adj_close", "shareholders_equity", "pe_ttm")
def j1_asof(s, d):
    return fr.asof(P.prices(s, d), P.funda(s, d), values=["shareholders_equity", "pe_ttm"])


P.VIEWS["hot"] = "SELECT l_orderkey, l_linenumber, date, CASE WHEN l_orderkey % 3 = 0 THEN 'Brand#1' ELSE ticker END AS ticker FROM lines"


@query("SELECT l_orderkey, l_linenumber, h.date, h.ticker, shares_out, pe_ttm FROM hot h ASOF LEFT JOIN funda f ON h.ticker = f.ticker AND h.date >= f.date", "shares_out", "pe_ttm")
def j1_asof_skewed(s, d):
    """Each line with its ticker's last filing, one ticker having a third of all lines and more."""
    hot = F.when(F.col("l_orderkey") % 3 == 0, "Brand#1").otherwise(F.col("ticker"))
    rows = P.lines(s, d).select("l_orderkey", "l_linenumber", "date", hot.alias("ticker"))
    return fr.asof(rows, P.funda(s, d), values=["shares_out", "pe_ttm"], most=5000)


@query("SELECT p.date, p.ticker, grp FROM prices p ASOF LEFT JOIN cls c ON p.ticker = c.ticker AND p.date >= c.date")
def j3_classification(s, d):
    return fr.asof(P.prices(s, d).select("date", "ticker"), P.labels(s, d))


@query("SELECT date, ticker, ret, momentum_z FROM rets LEFT JOIN momz USING (date, ticker)", "ret", "momentum_z")
def j4_left_join(s, d):
    px = P.prices(s, d)
    return pf.asset_returns(px).join(fac.momentum_scores(px).select("date", "ticker", "momentum_z"), ["date", "ticker"], "left")


@query("SELECT ticker, date, adj_close FROM prices WHERE ticker IN (SELECT symbol FROM universe WHERE adv > 25)", "adj_close")
def j6_semi_join(s, d):
    keep = P.universe(s, d).filter("adv > 25").select(F.col("symbol").alias("ticker"))
    return fr.only_in(P.prices(s, d), keep, "ticker")


@query("SELECT ticker, date, adj_close FROM prices WHERE ticker NOT IN (SELECT symbol FROM universe WHERE adv > 25)", "adj_close")
def j7_anti_join(s, d):
    return fr.except_in(P.prices(s, d), P.universe(s, d).filter("adv > 25").select(F.col("symbol").alias("ticker")), "ticker")


# Scores and bins


def ranked(s, d) -> DataFrame:
    return fac.assign_bins(fac.momentum_scores(P.prices(s, d)), "momentum_z", "rank", min_assets=5)


def grouped(s, d) -> DataFrame:
    """Ranks with market values and groups."""
    px = P.prices(s, d)
    held = fr.asof(px, P.funda(s, d), values=["shares_out"]).select("date", "ticker", (F.col("adj_close") * F.col("shares_out")).alias("market_cap"))
    return fr.asof(ranked(s, d).join(held, ["date", "ticker"]), P.labels(s, d))


@query("SELECT date, ticker, CASE WHEN x IS NOT NULL THEN least(greatest(x, quantile_cont(x, 0.05) OVER (PARTITION BY date)), quantile_cont(x, 0.95) OVER (PARTITION BY date)) END AS w FROM sig", "w")
def x1_winsorize(s, d):
    return signals(s, d).select("date", "ticker", C.winsorize("x", C.xs(), 0.05, 0.95).alias("w"))


@query("SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.01) AS low, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.99) AS high FROM lineitem GROUP BY 1", "low", "mid", "high")
def x1_large_quantiles(s, d):
    """The cuts of cross-sections of very many rows."""
    df = rk.exact_quantiles(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", [0.01, 0.5, 0.99], ["l_returnflag"])
    return df.select(F.col("l_returnflag").alias("flag"), *(F.col("quantiles")[i].alias(n) for i, n in enumerate(("low", "mid", "high"))))


@query("SELECT date, ticker, CASE WHEN stddev_pop(x) OVER (PARTITION BY date) > 1e-12 THEN (x - avg(x) OVER (PARTITION BY date)) / stddev_pop(x) OVER (PARTITION BY date) END AS z FROM sig", "z")
def x2_zscore(s, d):
    return signals(s, d).select("date", "ticker", C.zscore("x", C.xs()).alias("z"))


def signals(s, d) -> DataFrame:
    return P.factor_panel(P.prices(s, d, "week"))


P.VIEWS.update({"momg": "SELECT m.*, grp FROM mom m ASOF LEFT JOIN cls c ON m.ticker = c.ticker AND m.date >= c.date"})
P.VIEWS.update(P._z("momgz", "momg", "mom_ret", "momentum_z", "date, grp", " AND grp IS NOT NULL"))


@query("SELECT date, ticker, grp, mom_ret, momentum_z FROM momgz", "mom_ret", "momentum_z")
def x3_score_by_group(s, d):
    out = fac.momentum_scores(P.prices(s, d), P.labels(s, d), fac.Scoring(group="grp"))
    return out.select("date", "ticker", "grp", "mom_ret", "momentum_z")


@query("SELECT date, ticker, roe, de, roe_pre, de_pre, quality_raw FROM qual", "roe", "de", "roe_pre", "de_pre", "quality_raw")
def x5_quality_components(s, d):
    return fac.quality(P.prices(s, d), P.funda(s, d))


@query("SELECT date, ticker, raw AS composite FROM comp0", "composite")
def x6_composite(s, d):
    cfg = fac.Composite(rescore=False)
    return fac.composite(fac.factors(P.prices(s, d), P.funda(s, d)), cfg).select("date", "ticker", "composite")


@query("SELECT date, ticker, composite FROM compz", "composite")
def x7_composite_score(s, d):
    return run_factors(P.prices(s, d), P.funda(s, d)).select("date", "ticker", "composite")


@query(f"SELECT date, ticker, rank FROM ({P.bins_sql('momz', 'momentum_z', 'rank', floor=5)})", "rank")
def b1_qcut(s, d):
    return ranked(s, d).select("date", "ticker", "rank")


P.VIEWS["tied"] = "SELECT date, ticker, floor(x * 20) AS t FROM sig"


@query(f"SELECT date, ticker, t, bin FROM ({P.bins_sql('tied', 't', 'bin')})", "t", "bin")
def b2_tied_bins(s, d):
    return fac.assign_bins(signals(s, d).select("date", "ticker", F.floor(F.col("x") * 20).cast("double").alias("t")), "t", "bin")


def _rank_bins(source: str, c: str) -> str:
    width = " + ".join(f"(CASE WHEN share > ((mx - mn) / 5) * {i} + mn THEN 1 ELSE 0 END)" for i in range(1, 5))
    return f"""SELECT date, ticker, CASE WHEN {c} IS NULL THEN NULL WHEN mx > mn THEN 1 + {width} ELSE 3 END::DOUBLE AS bin
        FROM (SELECT *, min(share) OVER (PARTITION BY date) AS mn, max(share) OVER (PARTITION BY date) AS mx FROM (SELECT *, r / max(r) OVER (PARTITION BY date) AS share
        FROM (SELECT *, CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0 END AS r FROM {source})))"""


@query(_rank_bins("tied", "t"), "bin")
def b3_rank_bins(s, d):
    df = signals(s, d).select("date", "ticker", F.floor(F.col("x") * 20).cast("double").alias("t"))
    return fac.assign_bins(df, "t", "bin", method="rank").select("date", "ticker", "bin")


@query(f"SELECT date, ticker, 6 - rank AS rank FROM ({P.bins_sql('momgz', 'momentum_z', 'rank', part='date, grp', floor=5)})", "rank")
def b4_low_is_best_by_group(s, d):
    df = fac.momentum_scores(P.prices(s, d), P.labels(s, d), fac.Scoring(group="grp"))
    return fac.assign_bins(df, "momentum_z", "rank", group="grp", min_assets=5, high_is_best=False).select("date", "ticker", "rank")


@query("SELECT date, ticker, CASE WHEN x IS NOT NULL AND n >= 2 THEN greatest(1, (5 * (r - 1) + n - 2) // greatest(n - 1, 1))::DOUBLE END AS quintile FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST, ticker) AS r, count(x) OVER (PARTITION BY date) AS n FROM sig)", "quintile")
def b5_row_quintiles(s, d):
    return fac.row_quintiles(signals(s, d), "x").select("date", "ticker", "quintile")


@query("SELECT date, ticker, CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY t NULLS LAST) + (count(*) OVER (PARTITION BY date, t) - 1) / 2.0 END AS r FROM tied", "r")
def b6_average_rank(s, d):
    df = signals(s, d).select("date", "ticker", F.floor(F.col("x") * 20).cast("double").alias("t"))
    return df.select("date", "ticker", C.average_rank("t", "date").alias("r"))


# Series of a ticker


@query("SELECT date, ticker, ret FROM rets", "ret")
def t1_simple_return(s, d):
    return pf.asset_returns(P.prices(s, d))


@query("SELECT date, ticker, ln(adj_close) - lag(ln(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS ret FROM prices", "ret")
def t2_log_return(s, d):
    return pf.asset_returns(P.prices(s, d), "log")


@query("SELECT date, ticker, lead(adj_close, 21) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS fwd_ret FROM prices", "fwd_ret")
def t3_forward_return(s, d):
    return pf.forward_returns(P.prices(s, d))


@query("SELECT date, ticker, mom_ret FROM mom", "mom_ret")
def t4_momentum(s, d):
    return fac.momentum(P.prices(s, d)).select("date", "ticker", "mom_ret")


@query("SELECT date, ticker, CASE WHEN raw IS NOT NULL THEN min(raw) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS mom_6m FROM (SELECT date, ticker, lag(adj_close, 21) OVER w / lag(adj_close, 147) OVER w - 1 AS raw FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date))", "mom_6m")
def t5_row_momentum(s, d):
    return fac.row_momentum(P.prices(s, d)).select("date", "ticker", "mom_6m")


@query("SELECT date, CASE WHEN count(port_ret) OVER w = 63 THEN stddev_samp(port_ret) OVER w * sqrt(252) END AS vol, CASE WHEN count(port_ret) OVER w = 63 AND stddev_samp(port_ret) OVER w > 1e-12 THEN avg(port_ret) OVER w / stddev_samp(port_ret) OVER w * sqrt(252) END AS sharpe FROM port WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", "vol", "sharpe")
def t8_rolling_risk(s, d):
    return pf.rolling_risk(backtest(s, d)["port"])


# Factors and weights


def backtest(s, d) -> dict[str, DataFrame]:
    return momentum_backtest(P.prices(s, d))


@query("SELECT date, ticker, earnings_yield FROM ey", "earnings_yield")
def k1_earnings_yield(s, d):
    return fac.earnings_yield(P.prices(s, d), P.funda(s, d))


@query("SELECT ticker, date, CASE WHEN pe > 0 THEN 1 / pe END AS earnings_yield FROM (SELECT ticker, date, pe_ttm - 20 AS pe FROM funda)", "earnings_yield")
def k2_simple_earnings_yield(s, d):
    df = P.funda(s, d).select("ticker", "date", (F.col("pe_ttm") - 20).alias("pe"))
    return fac.simple_earnings_yield(df).select("ticker", "date", "earnings_yield")


@query("SELECT date, ticker, earnings_yield, value_z FROM valz", "earnings_yield", "value_z")
def k3_value_scores(s, d):
    return fac.value_scores(P.prices(s, d), P.funda(s, d))


@query("SELECT date, ticker, mom_ret, momentum_z FROM momz", "mom_ret", "momentum_z")
def k4_momentum_scores(s, d):
    return fac.momentum_scores(P.prices(s, d))


@query("SELECT date, ticker, quality_raw, quality_z FROM qualz", "quality_raw", "quality_z")
def k6_quality_scores(s, d):
    return fac.quality_scores(P.prices(s, d), P.funda(s, d)).select("date", "ticker", "quality_raw", "quality_z")


@query("SELECT ticker, date, CASE WHEN roe IS NOT NULL AND de IS NOT NULL THEN ((roe - mr) / sr - (de - md) / sd) / 2 WHEN roe IS NOT NULL THEN (roe - mr) / sr WHEN de IS NOT NULL THEN -(de - md) / sd END AS quality_score FROM (SELECT *, avg(roe) OVER () AS mr, stddev_pop(roe) OVER () AS sr, avg(de) OVER () AS md, stddev_pop(de) OVER () AS sd FROM (SELECT ticker, date, CASE WHEN pe_ttm IS NOT NULL THEN net_income_ttm / shareholders_equity END AS roe, total_debt / shareholders_equity AS de FROM funda))", "quality_score")
def k7_simple_quality(s, d):
    e = F.col("shareholders_equity")
    df = P.funda(s, d).select("ticker", "date", F.when(F.col("pe_ttm").isNotNull(), F.col("net_income_ttm") / e).alias("roe"), (F.col("total_debt") / e).alias("de"))
    return fac.simple_quality(df).select("ticker", "date", "quality_score")


@query("SELECT date, ticker, value_z, momentum_z, quality_z FROM fac", "value_z", "momentum_z", "quality_z")
def k8_factors(s, d):
    return fac.factors(P.prices(s, d), P.funda(s, d))


@query(f"SELECT date, ticker, composite, quintile FROM ({P.bins_sql('compz', 'composite', 'quintile')})", "composite", "quintile")
def k9_run_factors(s, d):
    return run_factors(P.prices(s, d), P.funda(s, d)).select("date", "ticker", "composite", "quintile")


@query("SELECT date, ticker, rank, weight FROM weights", "rank", "weight")
def p2_equal_weights(s, d):
    return pf.equal_weights(ranked(s, d)).select("date", "ticker", "rank", "weight")


@query("SELECT date, ticker, grp, CASE WHEN side = 0 OR grp IS NULL THEN 0.0 ELSE side * 0.5 / (SELECT count(DISTINCT grp) FROM sides t WHERE t.date = sides.date AND t.side = sides.side) / count(*) OVER (PARTITION BY date, side, grp) END AS weight FROM sides", "weight")
def p2_equal_weights_by_group(s, d):
    return pf.equal_weights(grouped(s, d), pf.Weights(group="grp")).select("date", "ticker", "grp", "weight")


P.VIEWS["capw"] = "SELECT date, ticker, side, CASE WHEN side = 0 THEN 0.0 ELSE side * 0.5 * coalesce(cap / sum(cap) OVER (PARTITION BY date, side), CASE WHEN sum(cap) OVER (PARTITION BY date, side) IS NULL THEN 1.0 / count(*) OVER (PARTITION BY date, side) ELSE 0.0 END) END AS weight FROM (SELECT *, CASE WHEN market_cap > 0 THEN market_cap END AS cap FROM sides)"


@query("SELECT date, ticker, weight FROM capw", "weight")
def p3_cap_weights(s, d):
    return pf.cap_weights(grouped(s, d)).select("date", "ticker", "weight")


@query("SELECT date, ticker, CASE WHEN side = 0 THEN weight ELSE coalesce(cut * side * 0.5 / nullif(sum(cut) OVER (PARTITION BY date, side), 0), 0) END AS weight FROM (SELECT *, greatest(least(weight, 0.2), -0.2) AS cut FROM capw)", "weight")
def p4_capped_weights(s, d):
    return pf.cap_weights(grouped(s, d), pf.Weights(max_abs=0.2)).select("date", "ticker", "weight")


@query("SELECT date, ticker, CASE WHEN abs(sum(cut) OVER (PARTITION BY date, sign(weight))) > 1e-12 THEN cut * sum(weight) OVER (PARTITION BY date, sign(weight)) / sum(cut) OVER (PARTITION BY date, sign(weight)) ELSE cut END AS weight FROM (SELECT *, greatest(least(weight, 0.2), -0.2) AS cut FROM capw)", "weight")
def p5_cap_max_weight(s, d):
    return pf.cap_max_weight(pf.cap_weights(grouped(s, d)), 0.2).select("date", "ticker", "weight")


@query("SELECT date, ticker, CASE WHEN grp IS NULL OR weight = 0 OR hi <= 0 OR lo >= 0 THEN weight ELSE weight * least(l, s) / CASE WHEN weight > 0 THEN l ELSE s END END AS weight FROM (SELECT *, max(weight) OVER (PARTITION BY date) AS hi, min(weight) OVER (PARTITION BY date) AS lo, coalesce(sum(weight) FILTER (weight > 0) OVER (PARTITION BY date, grp), 0) AS l, -coalesce(sum(weight) FILTER (weight < 0) OVER (PARTITION BY date, grp), 0) AS s FROM weights)", "weight")
def p6_group_neutral(s, d):
    return pf.group_neutral(pf.equal_weights(grouped(s, d)), "grp").select("date", "ticker", "weight")


P.VIEWS["quint"] = "SELECT date, ticker, fwd_ret, x, CASE WHEN x IS NOT NULL AND n >= 2 THEN greatest(1, (5 * (r - 1) + n - 2) // greatest(n - 1, 1))::DOUBLE END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST, ticker) AS r, count(x) OVER (PARTITION BY date) AS n FROM sig)"


def quintiles(s, d) -> DataFrame:
    return fac.row_quintiles(signals(s, d), "x", "rank").select("date", "ticker", "fwd_ret", "x", "rank")


@query("SELECT date, ticker, CASE WHEN rank = 5 THEN 1.0 / count(*) FILTER (rank = 5) OVER (PARTITION BY date) ELSE 0.0 END AS weight FROM quint", "weight")
def p7_long_only(s, d):
    return pf.long_only_bin(quintiles(s, d)).select("date", "ticker", "weight")


@query("SELECT date, ticker, CASE WHEN rank = 5 THEN CASE WHEN ns > 0 THEN 0.75 ELSE 0.5 END / nl WHEN rank = 1 THEN CASE WHEN nl > 0 THEN -0.25 ELSE -1.0 END / ns ELSE 0.0 END AS weight FROM (SELECT *, count(*) FILTER (rank = 5) OVER (PARTITION BY date) AS nl, count(*) FILTER (rank = 1) OVER (PARTITION BY date) AS ns FROM quint)", "weight")
def p8_long_short(s, d):
    return pf.long_short_bins(quintiles(s, d), 1.0, 0.5).select("date", "ticker", "weight")


# Performance


@query("SELECT date, port_ret FROM port", "port_ret")
def f1_portfolio_returns(s, d):
    return backtest(s, d)["port"]


P.VIEWS["legw"] = "SELECT date, ticker, fwd_ret AS ret, CASE WHEN rank = 5 THEN 1.0 / count(*) FILTER (rank = 5) OVER (PARTITION BY date) ELSE 0.0 END AS weight FROM quint"


@query("SELECT date, coalesce(sum(weight * ret), 0.0) AS port_ret FROM legw GROUP BY date", "port_ret")
def f2_weighted_returns(s, d):
    q = quintiles(s, d)
    return pf.weighted_returns(pf.long_only_bin(q), q.select("date", "ticker", F.col("fwd_ret").alias("ret")))


@query("SELECT date, turnover FROM turn", "turnover")
def f3_turnover(s, d):
    return pf.turnover(backtest(s, d)["weights"])


@query("SELECT date, wealth, peak, drawdown FROM curve", "wealth", "peak", "drawdown")
def f4_drawdown_curve(s, d):
    return pf.drawdown_curve(backtest(s, d)["port"], "year")


@query("SELECT min(drawdown) AS max_drawdown FROM curve", "max_drawdown")
def f5_max_drawdown(s, d):
    return pf.drawdown_curve(backtest(s, d)["port"]).agg(F.min("drawdown").alias("max_drawdown"))


P.VIEWS["perf"] = """SELECT product(1 + port_ret) ^ (252.0 / count(*)) - 1 AS cagr, stddev_pop(port_ret) * sqrt(252) AS vol_annual, avg(port_ret) / stddev_pop(port_ret) * sqrt(252) AS sharpe,
    avg(port_ret) / sqrt(avg(least(port_ret, 0) ^ 2)) * sqrt(252) AS sortino, (SELECT min(drawdown) FROM curve) AS max_drawdown,
    (product(1 + port_ret) ^ (252.0 / count(*)) - 1) / abs((SELECT min(drawdown) FROM curve)) AS calmar, avg((port_ret > 0)::int) AS hit_rate, avg(port_ret) FILTER (port_ret > 0) AS avg_win,
    avg(port_ret) FILTER (port_ret < 0) AS avg_loss, (SELECT avg(turnover) FROM turn) AS avg_turnover, count(*) AS periods FROM port"""


@query("SELECT * FROM perf", "cagr", "vol_annual", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "avg_win", "avg_loss", "avg_turnover")
def f6_summary(s, d):
    run = backtest(s, d)
    return pf.summary(run["port"], pf.turnover(run["weights"]))


@query('SELECT start, valley, "end", depth, length_days, recovery_days FROM episodes', "depth")
def f7_drawdown_episodes(s, d):
    return pf.drawdown_episodes(backtest(s, d)["port"], "year")


@query('SELECT row_number() OVER (ORDER BY depth, start) AS rank, start, valley, "end", round_even(depth, 4) AS depth, length_days, recovery_days FROM (SELECT * FROM episodes ORDER BY depth, start LIMIT 5)', "depth")
def f8_drawdown_table(s, d):
    return pf.drawdown_table(backtest(s, d)["port"])


@query("SELECT g.bin, lo + (hi - lo) / 40 * g.bin AS left, CASE WHEN g.bin = 39 THEN hi ELSE lo + (hi - lo) / 40 * (g.bin + 1) END AS right, count(p.port_ret) AS n FROM range(40) g(bin) CROSS JOIN (SELECT min(port_ret) AS lo, max(port_ret) AS hi FROM port) LEFT JOIN (SELECT port_ret, (SELECT count(*) FROM range(1, 40) e(i) WHERE port_ret >= l + (h - l) / 40 * i) AS bin FROM port, (SELECT min(port_ret) AS l, max(port_ret) AS h FROM port)) p ON p.bin = g.bin GROUP BY ALL", '"left"', '"right"')
def f9_histogram(s, d):
    return pf.histogram(backtest(s, d)["port"])


P.VIEWS |= {
    "tick_wealth": "SELECT date, product(1 + port_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM ticks",
    "tick_curve": "SELECT date, wealth, max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM tick_wealth",
}


@query("SELECT date, wealth, peak, wealth / peak - 1 AS drawdown FROM tick_curve", "wealth", "peak", "drawdown")
def f4_drawdown_curve_ticks(s, d):
    return pf.drawdown_curve(P.ticks(s, d), "day")


@query("SELECT date, CASE WHEN count(port_ret) OVER w = 63 THEN stddev_samp(port_ret) OVER w * sqrt(252) END AS vol, CASE WHEN count(port_ret) OVER w = 63 AND stddev_samp(port_ret) OVER w > 1e-12 THEN avg(port_ret) OVER w / stddev_samp(port_ret) OVER w * sqrt(252) END AS sharpe FROM ticks WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", "vol", "sharpe")
def t8_rolling_risk_ticks(s, d):
    return pf.rolling_risk(P.ticks(s, d), chunk="day")


# Information coefficients


def _ranks(source: str, part: str) -> str:
    one = lambda c: f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0"
    return f"SELECT *, {one('f')} AS rf, {one('g')} AS rg FROM {source}"


_SAFE = "CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
P.VIEWS["icp"] = "SELECT m.date, m.ticker, momentum_z AS f, fwd AS g FROM momz m JOIN (SELECT date, ticker, lead(adj_close, 21) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS fwd FROM prices) q USING (date, ticker) WHERE momentum_z IS NOT NULL AND fwd IS NOT NULL"
P.VIEWS["icg"] = "SELECT i.*, grp FROM icp i ASOF LEFT JOIN cls c ON i.ticker = c.ticker AND i.date >= c.date"
P.VIEWS["icr"] = _ranks("icp", "date")
P.VIEWS["icgr"] = _ranks("icg", "date, grp")
P.VIEWS["ics"] = f"SELECT date, {_SAFE.format(a='rf', b='rg')} AS ic FROM icr GROUP BY date"


@query("SELECT date, ic FROM ics", "ic")
def i1_ic_spearman(s, d):
    px = P.prices(s, d)
    return pf.ic_by_date(fac.momentum_scores(px), px, "momentum_z")


@query(f"SELECT date, {_SAFE.format(a='f', b='g')} AS ic FROM icp GROUP BY date", "ic")
def i1_ic_pearson(s, d):
    px = P.prices(s, d)
    return pf.ic_by_date(fac.momentum_scores(px), px, "momentum_z", method="pearson")


@query(f"SELECT date, sum(ic * n) / nullif(sum(n) FILTER (ic IS NOT NULL), 0) AS ic FROM (SELECT date, grp, count(*) AS n, {_SAFE.format(a='rf', b='rg')} AS ic FROM icgr WHERE grp IS NOT NULL GROUP BY date, grp) GROUP BY date", "ic")
def i2_ic_by_group(s, d):
    px = P.prices(s, d)
    return pf.ic_by_date(fr.asof(fac.momentum_scores(px), P.labels(s, d)), px, "momentum_z", group="grp")


@query("SELECT avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, avg(ic) / stddev_pop(ic) AS ic_ir, count(ic) AS n_obs FROM ics", "ic_mean", "ic_std", "ic_ir")
def i3_ic_stats(s, d):
    px = P.prices(s, d)
    return pf.ic_stats(pf.ic_by_date(fac.momentum_scores(px), px, "momentum_z"))


P.VIEWS["sigp"] = "SELECT date, ticker, x AS f, fwd_ret AS g FROM sig WHERE x IS NOT NULL AND fwd_ret IS NOT NULL"
P.VIEWS["sigr"] = _ranks("sigp", "date")


@query(f"SELECT date, {_SAFE.format(a='rf', b='rg')} AS ic FROM sigr GROUP BY date", "ic")
def i4_cross_section_ic(s, d):
    return pf.cross_section_ic(signals(s, d).filter("x IS NOT NULL AND fwd_ret IS NOT NULL"), "x", "fwd_ret")


@query("SELECT 'momentum_z' AS factor, round_even(avg(ic), 2) AS ic_mean, round_even(stddev_pop(ic), 2) AS ic_std, round_even(avg(ic) / stddev_pop(ic), 2) AS ic_ir, count(ic) AS n_obs FROM ics", "ic_mean", "ic_std", "ic_ir")
def i5_ic_table(s, d):
    px = P.prices(s, d)
    return pf.ic_table(fac.momentum_scores(px), px, ["momentum_z"])


# Correlations


def _cells(source: str, by: str, names: str = "xyz", ranked: bool = False, where: str = "TRUE") -> str:
    """All ordered pairs of columns, complete rows for each pair."""
    own = {c: (f"CASE WHEN {c} IS NOT NULL THEN rank() OVER ({by and 'PARTITION BY ' + by} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2.0 END" if ranked else c) for c in names}
    inner = f"SELECT {by + ', ' if by else ''}{', '.join(f'{e} AS r{c}' for c, e in own.items())}, {' OR '.join(f'{c} IS NOT NULL' for c in names)} AS used FROM {source}"
    parts = []
    for a in names:
        for b in names:
            p, q = (f"r{c}" for c in (a, b))
            aa, bb = f"CASE WHEN {q} IS NOT NULL THEN {p} END", f"CASE WHEN {p} IS NOT NULL THEN {q} END"
            parts.append(f"SELECT {by + ', ' if by else ''}'{a}' AS row, '{b}' AS col, {_SAFE.format(a=aa, b=bb)} AS corr, count(*) FILTER (used) AS n_used FROM ({inner}) {'GROUP BY ' + by if by else ''}")
    return f"SELECT {by + ', ' if by else ''}\"row\", col, corr FROM ({' UNION ALL '.join(parts)}) WHERE {where}"


P.VIEWS["cells"] = _cells("sig", "date", ranked=True, where="n_used >= 5")


@query(_cells("sig", "", ranked=True), "corr")
def rc1_spearman_whole(s, d):
    return st.corr_long(signals(s, d), ["x", "y", "z"], method="spearman")


@query(_cells("sig", ""), "corr")
def rc1_corr_matrix(s, d):
    return st.corr_long(signals(s, d), ["x", "y", "z"])


@query("SELECT * FROM cells", "corr")
def rc2_corr_by_date(s, d):
    return st.corr_long(signals(s, d), ["x", "y", "z"], ["date"], "spearman", 5)


@query('SELECT "row", col, avg(corr) AS corr FROM cells GROUP BY 1, 2', "corr")
def rc3_mean_corr(s, d):
    return st.mean_corr(signals(s, d), ["x", "y", "z"])


@query('SELECT "row", col, sum(corr * w) / sum(w) FILTER (corr IS NOT NULL) AS corr FROM cells JOIN (SELECT date, count(DISTINCT ticker) AS w FROM sig GROUP BY date) USING (date) GROUP BY 1, 2', "corr")
def rc3_weighted_mean_corr(s, d):
    return st.mean_corr(signals(s, d), ["x", "y", "z"], weighted=True)


_PAIR = "CASE WHEN stddev_pop(CASE WHEN y.ret IS NOT NULL THEN x.ret END) {o} > 1e-12 AND stddev_pop(CASE WHEN x.ret IS NOT NULL THEN y.ret END) {o} > 1e-12 THEN covar_pop(x.ret, y.ret) {o} / (stddev_pop(CASE WHEN y.ret IS NOT NULL THEN x.ret END) {o} * stddev_pop(CASE WHEN x.ret IS NOT NULL THEN y.ret END) {o}) END"


@query(f'SELECT x.ticker AS "row", y.ticker AS col, {_PAIR.format(o="")} AS corr FROM wrets x JOIN wrets y USING (date) WHERE date IN (SELECT date FROM wrets GROUP BY date HAVING count(ret) > 0) GROUP BY 1, 2', "corr")
def rc5_series_corr(s, d):
    return mx.panel_corr(pf.asset_returns(P.prices(s, d, "week")))


P.VIEWS["wranks"] = "SELECT date, ticker, CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY ticker ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY ticker, ret) - 1) / 2.0 END AS ret FROM wrets"


@query(f'SELECT x.ticker AS "row", y.ticker AS col, {_PAIR.format(o="")} AS corr FROM wranks x JOIN wranks y USING (date) GROUP BY 1, 2', "corr")
def rc5_series_spearman(s, d):
    return mx.panel_corr(pf.asset_returns(P.prices(s, d, "week")), method="spearman")


@query(f'SELECT x.ticker AS "row", y.ticker AS col, {_PAIR.format(o="")} AS corr FROM users x JOIN users y USING (date) GROUP BY 1, 2', "corr")
def rc5_many_series(s, d):
    return mx.panel_corr(P.hourly_users(s, d))


_ROLL = "SELECT {k}date, CASE WHEN count(a + b) OVER w = {n} AND stddev_pop(CASE WHEN b IS NOT NULL THEN a END) OVER w > 1e-12 AND stddev_pop(CASE WHEN a IS NOT NULL THEN b END) OVER w > 1e-12 THEN covar_pop(a, b) OVER w / (stddev_pop(CASE WHEN b IS NOT NULL THEN a END) OVER w * stddev_pop(CASE WHEN a IS NOT NULL THEN b END) OVER w) END AS corr FROM {t} WINDOW w AS ({p}ORDER BY date ROWS BETWEEN {m} PRECEDING AND CURRENT ROW)"


@query(_ROLL.format(k="ticker, ", t="series", p="PARTITION BY ticker ", n=26, m=25), "corr")
def rc6_rolling_corr(s, d):
    return st.rolling_corr(P.market(s, d), "a", "b", 26, by=["ticker"])


@query(_ROLL.format(k="", t="ticks", p="", n=63, m=62), "corr")
def rc6_rolling_corr_ticks(s, d):
    return st.rolling_corr(P.ticks(s, d), "a", "b", 63, chunk="day")


@query("""SELECT * FROM (WITH n AS (SELECT date, ticker, a, b, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM series),
    p AS (SELECT e.ticker, e.date, m.i, m.a, m.b FROM n e JOIN n m ON m.ticker = e.ticker AND m.i BETWEEN e.i - 12 AND e.i), r AS (SELECT ticker, date, a, b,
    rank() OVER (PARTITION BY ticker, date ORDER BY a) + (count(*) OVER (PARTITION BY ticker, date, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY ticker, date ORDER BY b) + (count(*) OVER (PARTITION BY ticker, date, b) - 1) / 2.0 AS rb FROM p)
    SELECT ticker, date, CASE WHEN count(a + b) = 13 AND stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS corr FROM r GROUP BY ticker, date)""", "corr")
def rc6_rolling_spearman(s, d):
    return st.rolling_corr(P.market(s, d), "a", "b", 13, "spearman", by=["ticker"])


@query(f"""SELECT date, "row", col, corr FROM (SELECT x.date, x.ticker AS "row", y.ticker AS col, count(*) OVER w AS n, {_PAIR.format(o="OVER w")} AS corr FROM wgrid x JOIN wgrid y ON x.date = y.date AND x.ticker < y.ticker
    WINDOW w AS (PARTITION BY x.ticker, y.ticker ORDER BY x.date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)) WHERE n = 26""", "corr")
def rc7_rolling_matrices(s, d):
    return mx.panel_rolling(pf.asset_returns(P.prices(s, d, "week")), 26)


@query(f"SELECT * FROM ({_cells('sig', '')}) WHERE \"row\" < col", "corr")
def rc8_upper_triangle(s, d):
    return st.upper_triangle(st.corr_long(signals(s, d), ["x", "y", "z"]), ["x", "y", "z"])


# Regressions


P.VIEWS["ab"] = "SELECT date, ticker, a, b FROM series WHERE a IS NOT NULL AND b IS NOT NULL"
P.VIEWS["fit"] = "SELECT ticker, regr_slope(a, b) AS slope, regr_intercept(a, b) AS icept, regr_r2(a, b) AS r2, count(*) AS n, sum(b) AS sb, sum(b * b) AS sbb FROM ab GROUP BY ticker"
P.VIEWS["u"] = "SELECT date, ticker, a - icept - slope * b AS u, b FROM ab JOIN fit USING (ticker)"
P.VIEWS["gg"] = "SELECT *, " + ", ".join(f"lag(u, {h}) OVER w AS u{h}, lag(b, {h}) OVER w AS b{h}" for h in range(1, 5)) + " FROM u WINDOW w AS (PARTITION BY ticker ORDER BY date)"
_S = lambda left, right: " + ".join([f"sum(u * u * {left.format(b='b')} * {right.format(b='b')})"] + [f"{1 - h / 5!r} * coalesce(sum(u{h} * u * ({left.format(b=f'b{h}')} * {right.format(b='b')} + {left.format(b='b')} * {right.format(b=f'b{h}')})), 0)" for h in range(1, 5)])
P.VIEWS["meat"] = f"SELECT ticker, {_S('1', '1')} AS s00, {_S('1', '{b}')} AS s01, {_S('{b}', '{b}')} AS s11 FROM gg GROUP BY ticker"
P.VIEWS["sandwich"] = """SELECT *, sqrt((sbb * sbb * s00 - 2 * sbb * sb * s01 + sb * sb * s11) / (n * sbb - sb * sb) ^ 2) AS se0,
    sqrt((sb * sb * s00 - 2 * n * sb * s01 + n::DOUBLE * n * s11) / (n * sbb - sb * sb) ^ 2) AS se1 FROM fit JOIN meat USING (ticker)"""


@query("SELECT ticker, 'alpha' AS param, icept AS coef, se0 AS stderr, icept / se0 AS tstat, r2, n AS n_obs FROM sandwich UNION ALL SELECT ticker, 'b', slope, se1, slope / se1, r2, n FROM sandwich", "coef", "stderr", "tstat", "r2")
def e3_ts_regression(s, d):
    return st.ts_regression(P.market(s, d), "a", ["b"], by=["ticker"])


def _two_regressors() -> dict[str, str]:
    """Views of a on b and c for each ticker: the 3 x 3 sums of products, their inverse by cofactors, scores and their lagged products."""
    inverse = {"00": "sbb * scc - sbc * sbc", "01": "sc * sbc - sb * scc", "02": "sb * sbc - sc * sbb", "11": "n * scc - sc * sc", "12": "sb * sc - n * sbc", "22": "n * sbb - sb * sb"}
    at = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    product = lambda i, j: " + ".join(f"{1 - h / 5!r} * (sum(g{i}_{h} * g{j}) + sum(g{j}_{h} * g{i}))" for h in range(1, 5))
    error = lambda j: " + ".join(f"{at(j, k)} * s{k}{m} * {at(m, j)}" for k in range(3) for m in range(3))
    return {
        "abc_rows": "SELECT date, ticker, a, b, c FROM series WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL",
        "abc_sums": "SELECT ticker, count(*)::DOUBLE AS n, sum(b) AS sb, sum(c) AS sc, sum(b * b) AS sbb, sum(c * c) AS scc, sum(b * c) AS sbc, sum(a) AS sa, sum(a * b) AS sab, sum(a * c) AS sac, var_pop(a) AS va FROM abc_rows GROUP BY ticker",
        "abc_inverse": "SELECT *, " + ", ".join(f"({v}) / det AS i{k}" for k, v in inverse.items()) + " FROM (SELECT *, n * (sbb * scc - sbc * sbc) - sb * (sb * scc - sbc * sc) + sc * (sb * sbc - sbb * sc) AS det FROM abc_sums)",
        "abc_coef": "SELECT *, " + ", ".join(f"{at(i, 0)} * sa + {at(i, 1)} * sab + {at(i, 2)} * sac AS k{i}" for i in range(3)) + " FROM abc_inverse",
        "abc_scores": "SELECT date, ticker, e, e AS g0, e * b AS g1, e * c AS g2 FROM (SELECT date, ticker, b, c, a - k0 - k1 * b - k2 * c AS e FROM abc_rows JOIN abc_coef USING (ticker))",
        "abc_lagged": "SELECT *, " + ", ".join(f"lag(g{i}, {h}) OVER w AS g{i}_{h}" for i in range(3) for h in range(1, 5)) + " FROM abc_scores WINDOW w AS (PARTITION BY ticker ORDER BY date)",
        "abc_products": "SELECT ticker, sum(e * e) AS see, " + ", ".join(f"sum(g{i} * g{j}) + {product(i, j)} AS s{i}{j}" for i in range(3) for j in range(3)) + " FROM abc_lagged GROUP BY ticker",
        "abc_fit": "SELECT ticker, n, 1 - see / (va * n) AS r2, k0, k1, k2, " + ", ".join(f"sqrt({error(j)}) AS e{j}" for j in range(3)) + " FROM abc_coef JOIN abc_products USING (ticker)",
    }


P.VIEWS |= _two_regressors()


@query(" UNION ALL ".join(f"SELECT ticker, '{p}' AS param, k{i} AS coef, e{i} AS stderr, k{i} / e{i} AS tstat, r2, n::BIGINT AS n_obs FROM abc_fit" for i, p in enumerate(("alpha", "b", "c"))), "coef", "stderr", "tstat", "r2")
def e3_ts_regression_two(s, d):
    return st.ts_regression(P.market(s, d), "a", ["b", "c"], by=["ticker"])


#: y on x and on z, a thousandth of another signal beside x: from the well-conditioned regression on x and the signal.
P.VIEWS["near_rows"] = "SELECT ticker, fwd_ret AS r, x, z FROM sig WHERE x IS NOT NULL AND z IS NOT NULL AND fwd_ret IS NOT NULL"
P.VIEWS["near_dev"] = "SELECT ticker, r - avg(r) OVER w AS dr, x - avg(x) OVER w AS dx, z - avg(z) OVER w AS dz, avg(r) OVER w AS mr, avg(x) OVER w AS mx, avg(z) OVER w AS mz FROM near_rows WINDOW w AS (PARTITION BY ticker)"
P.VIEWS["near_sums"] = "SELECT ticker, sum(dx * dr) AS sxr, sum(dz * dr) AS szr, sum(dx * dx) AS sxx, sum(dz * dz) AS szz, sum(dx * dz) AS sxz, any_value(mr) AS mr, any_value(mx) AS mx, any_value(mz) AS mz FROM near_dev GROUP BY ticker"
P.VIEWS["near_fit"] = "SELECT *, (sxr * szz - szr * sxz) / (sxx * szz - sxz * sxz) AS bx, (szr * sxx - sxr * sxz) / (sxx * szz - sxz * sxz) AS bz FROM near_sums"


@query("SELECT ticker, mr - bx * mx - bz * mz AS alpha, bx - 1000 * bz AS x, 1000 * bz AS near FROM near_fit", "alpha", "x", "near")
def e1_near_collinear(s, d):
    df = signals(s, d).withColumn("near", F.col("x") + F.col("z") / 1000)
    return ls.least_squares(df, "fwd_ret", ["x", "near"], ["ticker"]).select("ticker", "alpha", "x", "near")


@query("SELECT ticker, date, CASE WHEN regr_count(a, b) OVER w > 0 THEN regr_intercept(a, b) OVER w END AS alpha, regr_slope(a, b) OVER w AS b FROM series WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 52", "alpha", "b")
def e4_rolling_regression(s, d):
    return st.rolling_regression(P.market(s, d), "a", ["b"], 52, by=["ticker"])


@query("SELECT date, regr_intercept(a, b) OVER w AS alpha, regr_slope(a, b) OVER w AS b FROM ticks WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 63", "alpha", "b")
def e4_rolling_regression_ticks(s, d):
    return st.rolling_regression(P.ticks(s, d), "a", ["b"], 63, chunk="day")


P.VIEWS["fmx"] = "SELECT date, ticker, fwd_ret, least(greatest(x, quantile_cont(x, 0.01) OVER (PARTITION BY date)), quantile_cont(x, 0.99) OVER (PARTITION BY date)) AS xw, x FROM sig QUALIFY count(*) OVER (PARTITION BY date) >= 10"
P.VIEWS["fmb"] = "SELECT date, regr_intercept(fwd_ret, xw) AS alpha, regr_slope(fwd_ret, xw) AS x FROM fmx WHERE x IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY date"
P.VIEWS["fml"] = "SELECT date, 'alpha' AS param, alpha AS beta FROM fmb UNION ALL SELECT date, 'x', x FROM fmb"
P.VIEWS["fmu"] = "SELECT *, beta - avg(beta) OVER (PARTITION BY param) AS v FROM fml"
P.VIEWS["fmg"] = "SELECT *, " + ", ".join(f"lag(v, {h}) OVER (PARTITION BY param ORDER BY date) AS v{h}" for h in range(1, 5)) + " FROM fmu"


@query("SELECT date, param, beta FROM fml", "beta")
def e5_cross_section_betas(s, d):
    return st.cross_section_betas(signals(s, d), "fwd_ret", ["x"])


_ERROR = "sqrt(greatest(sum(v * v) + " + " + ".join(f"{2 * (1 - h / 5)!r} * coalesce(sum(v * v{h}), 0)" for h in range(1, 5)) + ", 0)) / count(*)"
_MEANS = f"SELECT param, avg(beta) AS mean_beta, {_ERROR} AS stderr, avg(beta) / ({_ERROR}) AS tstat, count(*) AS n_dates FROM {{0}} GROUP BY param"


@query(_MEANS.format("fmg"), "mean_beta", "stderr", "tstat")
def e5_fama_macbeth(s, d):
    return st.fama_macbeth(st.cross_section_betas(signals(s, d), "fwd_ret", ["x"]))


@query("SELECT count(*) AS n_dates_used, avg(n) AS mean_cs_obs, 4::BIGINT AS hac_lags_time, true AS add_intercept FROM (SELECT date, count(DISTINCT ticker) AS n FROM sig GROUP BY date HAVING count(DISTINCT ticker) >= 10)", "mean_cs_obs")
def e5_fama_macbeth_summary(s, d):
    return st.fama_macbeth_summary(signals(s, d))


@query("SELECT date, 'x' AS param, sum(xw * fwd_ret) / sum(xw * xw) AS beta FROM fmx WHERE x IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY date", "beta")
def e5_betas_through_origin(s, d):
    return st.cross_section_betas(signals(s, d), "fwd_ret", ["x"], intercept=False)


def _cut(c: str) -> str:
    return f"least(greatest({c}, quantile_cont({c}, 0.01) OVER (PARTITION BY date)), quantile_cont({c}, 0.99) OVER (PARTITION BY date)) AS {c}w"


#: Within a date, dummies take out each group's means: betas by sums within the groups, intercepts from what is left.
P.VIEWS |= {
    "grp_rows": "SELECT g.date, g.ticker, grp, fwd_ret, x, y FROM sig g ASOF JOIN cls k ON g.ticker = k.ticker AND g.date >= k.date WHERE grp IS NOT NULL",
    "grp_cut": f"SELECT date, grp, fwd_ret, x, y, {_cut('x')}, {_cut('y')} FROM grp_rows QUALIFY count(*) OVER (PARTITION BY date) >= 10",
    "grp_full": "SELECT date, grp, fwd_ret, xw, yw, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY date, grp) AS {d}" for c, d in (("fwd_ret", "dr"), ("xw", "dx"), ("yw", "dy"))) + " FROM grp_cut WHERE x IS NOT NULL AND y IS NOT NULL AND fwd_ret IS NOT NULL",
    "grp_beta": "SELECT date, (sxr * syy - syr * sxy) / (sxx * syy - sxy * sxy) AS bx, (syr * sxx - sxr * sxy) / (sxx * syy - sxy * sxy) AS byy FROM (SELECT date, sum(dx * dr) AS sxr, sum(dy * dr) AS syr, sum(dx * dx) AS sxx, sum(dy * dy) AS syy, sum(dx * dy) AS sxy FROM grp_full GROUP BY date)",
    "grp_left": "SELECT date, grp, avg(fwd_ret) - any_value(bx) * avg(xw) - any_value(byy) * avg(yw) AS rest FROM grp_full JOIN grp_beta USING (date) GROUP BY date, grp",
    "grp_base": "SELECT date, arg_min(rest, grp) AS base, min(grp) AS least FROM grp_left GROUP BY date",
    "grp_long": "SELECT date, 'alpha' AS param, base AS beta FROM grp_base UNION ALL SELECT date, 'x', bx FROM grp_beta UNION ALL SELECT date, 'y', byy FROM grp_beta UNION ALL SELECT date, 'grp_' || grp, rest - base FROM grp_left JOIN grp_base USING (date) WHERE grp > least",
    "grp_dev": "SELECT *, beta - avg(beta) OVER (PARTITION BY param) AS v FROM grp_long",
    "grp_lag": "SELECT *, " + ", ".join(f"lag(v, {h}) OVER (PARTITION BY param ORDER BY date) AS v{h}" for h in range(1, 5)) + " FROM grp_dev",
}


def by_group(s, d) -> DataFrame:
    df = fr.asof(signals(s, d), P.labels(s, d)).filter("grp IS NOT NULL")
    return st.cross_section_betas(df, "fwd_ret", ["x", "y"], group="grp")


@query("SELECT date, param, beta FROM grp_long", "beta")
def e5_cross_section_betas_groups(s, d):
    return by_group(s, d)


@query(_MEANS.format("grp_lag"), "mean_beta", "stderr", "tstat")
def e5_fama_macbeth_groups(s, d):
    return st.fama_macbeth(by_group(s, d))


@query("SELECT date, ticker, u AS resid FROM u", "resid")
def e6_residuals(s, d):
    return st.residuals(P.market(s, d), "a", ["b"], ["ticker"])


# Reports


@query("SELECT " + ", ".join(f"round_even({c}, 4) AS {c}" for c in ("cagr", "vol_annual", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "avg_win", "avg_loss", "avg_turnover")) + ", periods FROM perf", "cagr", "vol_annual", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "avg_win", "avg_loss", "avg_turnover")
def g1_performance_block(s, d):
    px = P.prices(s, d)
    return performance_block(px, momentum_backtest(px)["weights"])[0]


@query(f"SELECT avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, avg(ic) / stddev_pop(ic) AS ic_ir, count(ic) AS n_obs, any_value(m) AS mean_return, any_value(v) AS vol, any_value(m / v) AS sharpe FROM (SELECT date, {_SAFE.format(a='rf', b='rg')} AS ic FROM sigr GROUP BY date), (SELECT avg(p) AS m, stddev_samp(p) AS v FROM (SELECT date, coalesce(sum(weight * ret), 0.0) AS p FROM legw GROUP BY date))", "ic_mean", "ic_std", "ic_ir", "mean_return", "vol", "sharpe")
def g4_small_tearsheet(s, d):
    q = quintiles(s, d)
    port = pf.weighted_returns(pf.long_only_bin(q), q.select("date", "ticker", F.col("fwd_ret").alias("ret")))
    return small_tearsheet(q, port, "x")


#: The backtest of daily momentum quintiles, at a grain that has enough tickers at the smallest scale.
def flagship(s: SparkSession, d: str) -> DataFrame:
    return P.rounded(momentum_backtest(P.prices(s, d, "week"))["port"])


from quantloom.plans import inventory as inventory  # noqa: E402  registers the queries of sources, sinks and reports
