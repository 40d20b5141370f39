"""Queries of sources, sinks, reports and small helpers, registered beside those of registry.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.operators import calendar as cal
from quantloom.operators import frames as fr
from quantloom.operators import portfolio as pf
from quantloom.operators import statistics as st
from quantloom.plans import etl
from quantloom.plans import panels as P
from quantloom.plans import pipelines as pl
from quantloom.plans.registry import ORACLES, grouped, query, signals
from quantloom.sources import files
from quantloom.sources import fundamentals as fun
from quantloom.sources import partitions as pt
from quantloom.sources import schemas as sc
from quantloom.sources import universe as uni
from quantloom.sources import vendor

def same(name: str):
    """Register a function whose SQL is that of another query."""

    def add(f):
        query()(f)
        ORACLES[f.__name__] = ORACLES[name]
        return f

    return add


# Sources and sinks: each writes to a new shared folder and reads what is there


@query("SELECT n_nationkey, n_name FROM nation")
def s1_read_table(s, d):
    return files.read_table(s, f"{d}/nation.parquet").select("n_nationkey", "n_name")


@query("SELECT date, ticker, adj_close, year(date) AS year FROM weekly", "adj_close")
def s2_write_table(s, d):
    path = files.scratch(s)
    files.write_table(P.prices(s, d, "week").withColumn("year", F.year("date")), path, by="year")
    return files.read_table(s, path).select("date", "ticker", "adj_close", F.col("year").cast("long").alias("year"))


@query("SELECT ticker, date, grp FROM cls")
def s3_csv(s, d):
    path = files.scratch(s)
    files.write_report(P.labels(s, d), path)
    return files.read_csv(s, path, "ticker STRING, date DATE, grp STRING")


_FUNDA = ("pe_ttm", "shares_out", "net_income_ttm", "shareholders_equity", "total_debt")


def _filed(s: SparkSession, d: str) -> str:
    """The fundamentals as CSV under other headers, each row twice, the first of them wrong, and rows without keys."""
    df, path = P.funda(s, d), files.scratch(s)
    wrong = df.withColumn("shares_out", F.lit(-1.0))
    keyless = df.limit(1).select(F.lit("").alias("ticker"), "date", *_FUNDA)
    rows = wrong.withColumn("nth", F.lit(0)).unionByName(df.withColumn("nth", F.lit(1))).unionByName(keyless.withColumn("nth", F.lit(2)))
    rows = rows.coalesce(1).sortWithinPartitions("nth").drop("nth")
    rows.withColumnsRenamed({"ticker": "Tickers", "date": "Filing-Date", "shares_out": "Shares Out"}).write.option("header", True).csv(path)
    return path


@query("SELECT upper(ticker) AS symbol, date, " + ", ".join(_FUNDA) + " FROM funda", *_FUNDA)
def s5_fundamentals_csv(s, d):
    return fun.load_csv(s, _filed(s, d)).select("symbol", "date", *_FUNDA)


@query("SELECT upper(ticker) AS symbol, date, total_debt FROM funda", "total_debt")
def s7_fundamentals(s, d):
    df = fun.fundamentals(s, [_filed(s, d)], uni.cleaned(P.prices(s, d).select("ticker")))
    return s.read.parquet(fun.write_fundamentals(df, files.scratch(s))).select("symbol", "date", "total_debt")


def _symbols(s: SparkSession, d: str) -> list[str]:
    """All brands of the part table, as a user would list them."""
    return [r[0].lower() for r in s.read.parquet(f"{d}/part.parquet").select("p_brand").distinct().collect()]


@query("SELECT date, upper(ticker) AS symbol, adj_close FROM prices", "adj_close")
def s8_ingest_prices(s, d):
    bars = P.prices(s, d).withColumnsRenamed({"date": "Datetime", "ticker": "Symbol", "adj_close": "Adj Close"}).withColumn("Close", F.lit(1.0))

    def fetch(symbols, start, end, bar):
        if "BROKEN" in symbols:
            raise ConnectionError("no such symbol")
        return bars.filter(F.upper("Symbol").isin(symbols))

    got = etl.ingest_prices(s, fetch, [*_symbols(s, d), "broken", "none"], batch=7)
    return got.select(F.col("timestamp").cast("date").alias("date"), "symbol", "adj_close")


@query("SELECT upper(event_type) AS symbol, \"timestamp\"::DATE AS date, count(*) AS n, sum(volume) AS volume, any_value(NULL::VARCHAR) AS error FROM (SELECT symbol AS event_type, * FROM bars) GROUP BY 1, 2 UNION ALL SELECT 'BROKEN', NULL, 0, NULL, 'ValueError: broken'", "volume")
def s8_bars_source(s, d):
    """Hourly bars of the events through format("quantloom_bars"), with a symbol whose file can't be read."""
    path, bars = files.scratch(s), P.bars_1h(s, d)
    names = [r[0] for r in bars.select("symbol").distinct().collect()]
    vendor.store(bars, path)
    df = vendor.read_bars(s, [*names, "broken"], vendor.Stored(path, broken=("BROKEN",)), "2020-01-01", "2030-01-01", "1h", batch=2)
    return df.groupBy("symbol", F.col("timestamp").cast("date").alias("date")).agg(F.count("timestamp").alias("n"), F.sum("volume").alias("volume"), F.first("error").alias("error"))


@query("SELECT date, upper(ticker) AS ticker, adj_close FROM pgrid", "adj_close")
def s10_tidy_prices(s, d):
    return files.canonical_prices(fr.long_to_wide(P.prices(s, d), None, "ticker", "adj_close", "Adj_Close_"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def s15_orphans(s, d):
    parents = s.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return fr.orphans(s.read.parquet(f"{d}/lineitem.parquet"), parents, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def melted(df: DataFrame, artifact: str, fields: list[str], key: str | None = None) -> DataFrame:
    """(artifact, date, key, field, value): a cell of the table a row."""
    none = lambda kind: F.lit(None).cast(kind)
    date = F.col("date") if "date" in df.columns else none("date")
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields)))
    return df.select(F.lit(artifact).alias("artifact"), date.alias("date"), (F.expr(key) if key else none("string")).alias("key"), each)


def _cells_sql(source: str, artifact: str, fields: dict[str, str], date: str = "date", key: str = "NULL::VARCHAR") -> str:
    return " UNION ALL ".join(f"SELECT '{artifact}' AS artifact, {date} AS date, {key} AS key, '{f}' AS field, ({e})::DOUBLE AS value FROM {source}" for f, e in fields.items())


P.VIEWS |= {
    "rolled": "SELECT date, CASE WHEN count(port_ret) OVER w = 63 THEN stddev_samp(port_ret) OVER w * sqrt(252) END AS vol, CASE WHEN count(port_ret) OVER w = 63 AND stddev_samp(port_ret) OVER w > 1e-12 THEN avg(port_ret) OVER w / stddev_samp(port_ret) OVER w * sqrt(252) END AS sharpe FROM port WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)",
    "span": "SELECT min(port_ret) AS lo, max(port_ret) AS hi FROM port",
    "placed": "SELECT port_ret, (SELECT count(*) FROM range(1, 40) e(i) WHERE port_ret >= lo + (hi - lo) / 40 * i) AS bin FROM port, span",
    "hist": "SELECT g.bin, lo + (hi - lo) / 40 * g.bin AS bin_left, CASE WHEN g.bin = 39 THEN hi ELSE lo + (hi - lo) / 40 * (g.bin + 1) END AS bin_right, count(p.port_ret) AS freq FROM range(40) g(bin) CROSS JOIN span LEFT JOIN placed p ON p.bin = g.bin GROUP BY ALL",
    "selfcorr": "SELECT 'momentum_z' AS \"row\", 'momentum_z' AS col, avg(c) AS corr FROM (SELECT CASE WHEN stddev_pop(momentum_z) > 1e-12 THEN 1.0 END AS c FROM momz GROUP BY date HAVING count(momentum_z) >= 5)",
}


_KEPT = {
    "customer": "SELECT c_custkey FROM customer WHERE c_nationkey % 5 <> 0",
    "orders": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0)",
    "lineitem": "SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0))",
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, k, count(*) AS n FROM ({q}) t(k) GROUP BY 2" for t, q in _KEPT.items()))
def s15_cascade(s, d):
    """Customers of every fifth nation deleted, and with them their orders and these orders' lines."""
    keys = {"customer": ("c_custkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")}
    parents = {"orders": (("o_custkey", "customer"),), "lineitem": (("l_orderkey", "orders"),)}
    tables = {t: s.read.parquet(f"{d}/{t}.parquet") for t in keys}
    left = sc.cascaded(tables, "customer", F.col("c_nationkey") % 5 == 0, keys, parents)
    each = [left[t].groupBy(F.lit(t).alias("name"), F.col(keys[t][0]).alias("k")).agg(F.count("*").alias("n")) for t in keys]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT ticker, date, adj_close, ret FROM prices JOIN rets USING (ticker, date)", "adj_close", "ret")
def s14_bucketed_join(s, d):
    """Two tables bucketed and sorted by ticker and date; their join needs no exchange."""
    px = P.prices(s, d)
    left = sc.bucketed(px, files.scratch(s), ["ticker", "date"])
    right = sc.bucketed(pf.asset_returns(px), files.scratch(s), ["ticker", "date"])
    return left.join(right, ["ticker", "date"])


@query(
    " UNION ALL ".join(
        [
            _cells_sql("curve", "equity", {"equity": "wealth"}),
            _cells_sql("port", "returns", {"port_ret": "port_ret"}),
            _cells_sql("curve", "drawdown", {"drawdown": "drawdown"}),
            _cells_sql("rolled", "rolling_vol", {"rolling_vol": "vol"}),
            _cells_sql("rolled", "rolling_sharpe", {"rolling_sharpe": "sharpe"}),
            _cells_sql("hist", "returns_hist", {"bin_left": "bin_left", "bin_right": "bin_right", "freq": "freq"}, "NULL::DATE"),
            _cells_sql("momz", "factors", {"momentum_z": "momentum_z", "composite": "momentum_z"}, key="ticker"),
            _cells_sql("ranks", "ranks", {"composite": "momentum_z", "rank": "rank"}, key="ticker"),
            _cells_sql("weights", "weights", {"rank": "rank", "weight": "weight"}, key="ticker"),
            _cells_sql("selfcorr", "correlations", {"corr": "corr"}, "NULL::DATE", "\"row\" || '/' || col"),
            _cells_sql("perf", "perf_summary", {"cagr": "cagr", "vol_ann": "vol_annual", "sharpe": "sharpe", "max_dd": "max_drawdown"}, "NULL::DATE"),
        ]
    ),
    "value",
)
def s16_dashboard(s, d):
    """Every file of the dashboard, read back."""
    path = files.scratch(s)
    pl.dashboard(P.prices(s, d), path)
    one = lambda name, fields, key=None: melted(s.read.parquet(f"{path}/{name}.parquet"), name, fields, key)
    out = one("equity", ["equity"])
    for name, fields, key in (
        ("returns", ["port_ret"], None),
        ("drawdown", ["drawdown"], None),
        ("rolling_vol", ["rolling_vol"], None),
        ("rolling_sharpe", ["rolling_sharpe"], None),
        ("returns_hist", ["bin_left", "bin_right", "freq"], None),
        ("factors", ["momentum_z", "composite"], "ticker"),
        ("ranks", ["composite", "rank"], "ticker"),
        ("weights", ["rank", "weight"], "ticker"),
        ("correlations", ["corr"], "row || '/' || col"),
    ):
        out = out.unionByName(one(name, fields, key))
    return out.unionByName(melted(s.read.schema("cagr DOUBLE, vol_ann DOUBLE, sharpe DOUBLE, max_dd DOUBLE").json(f"{path}/perf_summary.json"), "perf_summary", ["cagr", "vol_ann", "sharpe", "max_dd"]))


_SUMMARY = ("cagr", "vol_annual", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "avg_win", "avg_loss", "avg_turnover", "periods")
P.VIEWS["deepest"] = 'SELECT row_number() OVER (ORDER BY depth, start) AS rank, start, valley, "end", round_even(depth, 4) AS depth, length_days, recovery_days FROM (SELECT * FROM episodes ORDER BY depth, start LIMIT 5)'


@query(
    " UNION ALL ".join(
        [
            _cells_sql("port", "portfolio_returns", {"port_ret": "port_ret"}),
            _cells_sql("perf", "performance_summary", {c: c for c in _SUMMARY}, "NULL::DATE"),
            _cells_sql("deepest", "drawdowns", {c: c for c in ("rank", "depth", "length_days", "recovery_days")}, "NULL::DATE", "start || '/' || valley || '/' || coalesce(\"end\"::VARCHAR, '')"),
            _cells_sql("curve", "drawdown_curve", {c: c for c in ("wealth", "peak", "drawdown")}),
            _cells_sql("curve", "equity", {"wealth": "wealth"}),
            _cells_sql("selfcorr", "cs_corr_mean", {"corr": "corr"}, "NULL::DATE", "\"row\" || '/' || col"),
        ]
    ),
    "value",
)
def s17_reports(s, d):
    """Every report, read back."""
    path = files.scratch(s)
    pl.reports(P.prices(s, d), path)
    tables = {
        "portfolio_returns": ("date DATE, port_ret DOUBLE", ["port_ret"], None),
        "performance_summary": (", ".join(f"{c} DOUBLE" for c in _SUMMARY), list(_SUMMARY), None),
        "drawdowns": ("rank LONG, start DATE, valley DATE, `end` DATE, depth DOUBLE, length_days LONG, recovery_days LONG", ["rank", "depth", "length_days", "recovery_days"], "start || '/' || valley || '/' || coalesce(string(`end`), '')"),
        "drawdown_curve": ("date DATE, wealth DOUBLE, peak DOUBLE, drawdown DOUBLE", ["wealth", "peak", "drawdown"], None),
        "equity": ("date DATE, wealth DOUBLE", ["wealth"], None),
        "cs_corr_mean": ("row STRING, col STRING, corr DOUBLE", ["corr"], "row || '/' || col"),
    }
    each = [melted(files.read_csv(s, f"{path}/{name}.csv", ddl), name, fields, key) for name, (ddl, fields, key) in tables.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT DISTINCT upper(replace(trim(ticker), '/', '_')) AS symbol FROM prices")
def u1_saved_universe(s, d):
    df = uni.cleaned(P.prices(s, d).select("ticker").distinct())
    return uni.save_universe(df, files.scratch(s)).select("symbol")


@query("SELECT ticker, date, CASE WHEN date >= DATE '1998-01-01' THEN -adj_close ELSE adj_close END AS adj_close, year(date) AS year FROM weekly", "adj_close")
def s12_upsert_partitions(s, d):
    """A batch that changes two years' rows, put twice into a table by year: the second time nothing is rewritten."""
    path, px = files.scratch(s), P.prices(s, d, "week").withColumn("year", F.year("date"))
    batch = px.withColumn("adj_close", F.when(F.col("date") >= "1998-01-01", -F.col("adj_close")).otherwise(F.col("adj_close")))
    keys = ["ticker", "date", "year"]
    pt.upsert_partitions(s, path, px, keys, "year")
    pt.upsert_partitions(s, path, batch, keys, "year")
    if pt.upsert_partitions(s, path, batch, keys, "year"):
        raise AssertionError("a repeated batch rewrote partitions")
    return s.read.parquet(path).select("ticker", "date", "adj_close", F.col("year").cast("long").alias("year"))


# Small helpers


@query("SELECT bar, CASE bar WHEN ' 1H' THEN 1638 ELSE 252 END AS periods, n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN '1d' WHEN 1 THEN ' 1H' ELSE '5m' END AS bar, count(*) AS n FROM orders GROUP BY 1)")
def c6_periods_from_bar(s, d):
    bar = F.element_at(F.array(F.lit("1d"), F.lit(" 1H"), F.lit("5m")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    by = s.read.parquet(f"{d}/orders.parquet").groupBy(bar.alias("bar")).agg(F.count("*").alias("n"))
    return by.select("bar", cal.periods_of(F.col("bar")).alias("periods"), "n")


@query("SELECT freq, CASE freq WHEN 'daily' THEN 252 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 END AS factor, n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'hourly' END AS freq, count(*) AS n FROM orders GROUP BY 1)")
def c8_annual_factor(s, d):
    freq = F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly", "hourly"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    by = s.read.parquet(f"{d}/orders.parquet").groupBy(freq.alias("freq")).agg(F.count("*").alias("n"))
    return by.select("freq", cal.factor_of(F.col("freq")).alias("factor"), "n")


@query("SELECT l_orderkey, l_linenumber, '$' || format('{:,.2f}', l_extendedprice) AS price, format('{:.2f}', 100 * l_discount) || '%' AS discount, format('{:.4f}', l_quantity::DOUBLE) AS quantity FROM lineitem")
def z_formats(s, d):
    df = s.read.parquet(f"{d}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", C.money("l_extendedprice").alias("price"), C.percent("l_discount").alias("discount"), C.fixed("l_quantity").alias("quantity"))


@query("SELECT date, \"row\", col, corr FROM cells WHERE corr IS NOT NULL", "corr")
def r3_stacked_matrices(s, d):
    return st.corr_long(signals(s, d), ["x", "y", "z"], ["date"], "spearman", 5).filter(F.col("corr").isNotNull())


@query("SELECT r.date, r.ticker, 'grp_' || s.grp AS param, coalesce(r.grp = s.grp, false)::INT::DOUBLE AS value FROM grouped r JOIN (SELECT date, grp FROM grouped WHERE grp IS NOT NULL GROUP BY 1, 2 QUALIFY grp > min(grp) OVER (PARTITION BY date)) s USING (date)")
def r5_dummies(s, d):
    return fr.dummies(grouped(s, d), "grp")


@query("SELECT ticker, date, adj_close FROM prices", "adj_close")
def r6_normalized(s, d):
    odd = P.prices(s, d).select(F.col("ticker").alias(" Ticker"), F.col("date").cast("string").alias("DATE "), F.col("adj_close").cast("string").alias("Adj_Close"))
    return fr.normalize(odd, ("ticker", "date", "adj_close"), ("adj_close",))


@query("SELECT ticker, date, adj_close FROM prices UNION ALL SELECT ticker, date, adj_close FROM weekly", "adj_close")
def r8_concat(s, d):
    return P.prices(s, d).unionByName(P.prices(s, d, "week")).select("ticker", "date", "adj_close")


@query("SELECT ticker, date, adj_close FROM weekly ORDER BY ticker, date", "adj_close")
def r12_sorted(s, d):
    return P.prices(s, d, "week").orderBy("ticker", "date").select("ticker", "date", "adj_close")


@query("SELECT ticker, date, adj_close, 2 AS nth FROM prices", "adj_close")
def r18_price_frame(s, d):
    twice = P.prices(s, d).withColumn("nth", F.explode(F.array(F.lit(1), F.lit(2)))).withColumnRenamed("adj_close", "Adj Close")
    return fr.price_frame(twice, order=F.col("nth")).select("ticker", "date", "adj_close", "nth")


# Reports


@same("rc3_mean_corr")
def g2_cross_section_block(s, d):
    return pl.correlation_block(signals(s, d), ["x", "y", "z"])["cs_corr"]


@same("rc5_series_corr")
def g2_series_block(s, d):
    return pl.correlation_block(signals(s, d), ["x"], series=P.wide_returns(s, d), series_names=P.BRANDS, dropna="all")["ts_corr"]


def sheet(s: SparkSession, d: str) -> dict[str, DataFrame]:
    run = pl.momentum_backtest(P.prices(s, d))
    return pl.tearsheet(P.prices(s, d), run["weights"], run["factors"], ["momentum_z"])


@same("g1_performance_block")
def g3_tearsheet_summary(s, d):
    return sheet(s, d)["summary"]


@same("f8_drawdown_table")
def g3_tearsheet_drawdowns(s, d):
    return sheet(s, d)["drawdowns"]


@same("f1_portfolio_returns")
def g3_tearsheet_returns(s, d):
    return sheet(s, d)["returns"]


@same("f1_portfolio_returns")
def g5_pilot_returns(s, d):
    return pl.momentum_backtest(P.prices(s, d))["port"]


@query("SELECT 'prices' AS type, upper(ticker) AS symbol, count(*) AS n_rows, min(date) AS start, max(date) AS \"end\", '1d' AS bar FROM prices GROUP BY ticker UNION ALL SELECT 'fundamentals', upper(ticker), count(*), min(date), max(date), NULL FROM funda GROUP BY ticker")
def g8_etl(s, d):
    bars = P.prices(s, d).withColumnsRenamed({"date": "timestamp", "ticker": "symbol"}).withColumn("close", F.col("adj_close"))
    job = etl.Etl(symbols=tuple(_symbols(s, d)), fundamentals=(_filed(s, d),), folder=files.scratch(s))
    return etl.run_etl(s, job, lambda symbols, start, end, bar: bars.filter(F.upper("symbol").isin(symbols)))
