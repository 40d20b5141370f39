"""Panels made from the driver's tables, as DataFrames and as SQL. Prices are integer sums divided once, so both agree to the bit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.portfolio import asset_returns
from quantloom.streaming.bars import bars


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part's brand as ticker; the part side is small beside it and left to the optimizer."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return items.join(parts, "l_partkey").withColumn("date", F.to_date("l_shipdate"))


def prices(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    date = F.col("date") if grain == "day" else F.to_date(F.date_trunc(grain, "date"))
    by = lines(spark, sf_dir).groupBy("ticker", date.alias("date"))
    return by.agg((F.sum(cents("l_extendedprice")).cast("double") / F.sum(F.col("l_quantity").cast("long")).cast("double")).alias("adj_close"))


def funda(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, odd = cents("l_extendedprice"), F.quarter("date") % 2
    by = lines(spark, sf_dir).groupBy("ticker", F.to_date(F.date_trunc("quarter", "date")).alias("_q"), odd.alias("_odd"))
    df = by.agg(
        F.sum(price).alias("_cents"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("shares_out"),
        (F.sum(price * F.round((1 - F.col("l_discount")) * 100).cast("long")).cast("double") / 10000).alias("net_income_ttm"),
        (F.sum(price * cents("l_tax")).cast("double") / 10000).alias("total_debt"),
    )
    pe = F.when(F.col("_odd") == 0, 5 + (F.col("_cents") % 4000).cast("double") / 100)
    equity = F.col("_cents").cast("double") / 100
    return df.select("ticker", F.add_months("_q", 3).alias("date"), pe.alias("pe_ttm"), "shares_out", "net_income_ttm", equity.alias("shareholders_equity"), "total_debt")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("ticker")).distinct()
    nth = F.substring("ticker", 7, 10).cast("int")
    first = brands.select("ticker", F.lit("1995-01-01").cast("date").alias("date"), F.concat(F.lit("G"), nth % 2).alias("grp"))
    later = brands.filter(nth % 5 == 0).select("ticker", F.lit("1998-07-01").cast("date").alias("date"), F.concat(F.lit("G"), (nth + 1) % 2).alias("grp"))
    return first.unionByName(later)


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price, average quantity and market value of each ticker."""
    px = prices(spark, sf_dir)
    last = px.groupBy("ticker").agg(F.max_by("adj_close", "date").alias("last_price"))
    adv = lines(spark, sf_dir).groupBy("ticker").agg((F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count("*")).alias("adv"))
    shares = funda(spark, sf_dir).groupBy("ticker").agg(F.max_by("shares_out", "date").alias("shares_out"))
    out = last.join(adv, "ticker").join(shares, "ticker")
    return out.select(F.col("ticker").alias("symbol"), "last_price", "adv", (F.col("last_price") * F.col("shares_out")).alias("market_cap"))


#: All brands of the part table.
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
def wide_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, each of BRANDS): weekly returns as a wide frame of return series."""
    rets = asset_returns(prices(spark, sf_dir, "week"))
    return rets.groupBy("date").pivot("ticker", BRANDS).agg(F.first("ret", ignorenulls=True))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, a, b, c): each ticker's weekly return, the market's (the mean of all) and the market's of the week before."""
    rets = asset_returns(prices(spark, sf_dir, "week"))
    means = rets.groupBy("date").agg(F.avg("ret").alias("b"))
    means = means.withColumn("c", F.lag("b").over(W.orderBy("date")))
    return rets.join(means, "date").select("date", "ticker", F.col("ret").alias("a"), "b", "c")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, a, b, port_ret): a series with a row an event, at its time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("value")
    return events.select(F.col("ts").alias("date"), value.alias("a"), F.col("user_id").cast("double").alias("b"), ((F.round(value * 100) % 2001 - 1000) / 1000000).alias("port_ret"))


def hourly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, ret): the hourly sums of each user's events, a panel of many names."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    by = events.groupBy(F.date_trunc("hour", "ts").alias("date"), F.concat(F.lit("u"), "user_id").alias("ticker"))
    return by.agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("ret"))


def factor_panel(df: DataFrame) -> DataFrame:
    """Three signals of a price panel: the change, the change before, and the price against its mean of five rows."""
    over = W.partitionBy("ticker").orderBy("date")
    p, q, r = F.col("adj_close"), F.lag("adj_close", 1).over(over), F.lag("adj_close", 2).over(over)
    mean = F.avg("adj_close").over(over.rowsBetween(-4, 0))
    ahead = F.lead("adj_close", 1).over(over)
    return df.select("date", "ticker", (p / q - 1).alias("x"), (q / r - 1).alias("y"), (p / mean - 1).alias("z"), (ahead / p - 1).alias("fwd_ret"))


_PRICE = "sum(round(l_extendedprice*100)::bigint)::double / sum(l_quantity::bigint)::double"

VIEWS = {
    "lines": "SELECT l.*, p_brand AS ticker, l_shipdate::date AS date FROM lineitem l JOIN part ON l_partkey = p_partkey",
    "prices": f"SELECT ticker, date, {_PRICE} AS adj_close FROM lines GROUP BY 1, 2",
    "weekly": f"SELECT ticker, date_trunc('week', date)::date AS date, {_PRICE} AS adj_close FROM lines GROUP BY 1, 2",
    "funda": """SELECT ticker, (date_trunc('quarter', date) + INTERVAL 3 MONTH)::date AS date,
        CASE WHEN quarter(date) % 2 = 0 THEN 5 + (sum(round(l_extendedprice*100)::bigint) % 4000)::double / 100 END AS pe_ttm,
        sum(l_quantity::bigint)::double AS shares_out,
        sum(round(l_extendedprice*100)::bigint * round((1 - l_discount)*100)::bigint)::double / 10000 AS net_income_ttm,
        sum(round(l_extendedprice*100)::bigint)::double / 100 AS shareholders_equity,
        sum(round(l_extendedprice*100)::bigint * round(l_tax*100)::bigint)::double / 10000 AS total_debt
        FROM lines GROUP BY ticker, date_trunc('quarter', date), quarter(date)""",
    "cls": """SELECT DISTINCT p_brand AS ticker, DATE '1995-01-01' AS date, 'G' || (substr(p_brand, 7)::int % 2) AS grp FROM part
        UNION ALL SELECT DISTINCT p_brand, DATE '1998-07-01', 'G' || ((substr(p_brand, 7)::int + 1) % 2) FROM part WHERE substr(p_brand, 7)::int % 5 = 0""",
    "bars": """SELECT event_type AS symbol, date_trunc('hour', ts) AS "timestamp", min_by(value, event_id) AS open, max(value) AS high,
        min(value) AS low, max_by(value, event_id) AS close, count(*)::double AS volume FROM events GROUP BY 1, 2""",
    "universe": """SELECT p.ticker AS symbol, last_price, adv, last_price * shares_out AS market_cap
        FROM (SELECT ticker, max_by(adj_close, date) AS last_price FROM prices GROUP BY 1) p
        JOIN (SELECT ticker, sum(l_quantity::bigint)::double / count(*) AS adv FROM lines GROUP BY 1) q USING (ticker)
        JOIN (SELECT ticker, max_by(shares_out, date) AS shares_out FROM funda GROUP BY 1) r USING (ticker)""",
    "rets": "SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices",
    "wrets": "SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM weekly",
    "mkt": "SELECT date, b, lag(b) OVER (ORDER BY date) AS c FROM (SELECT date, avg(ret) AS b FROM wrets GROUP BY date)",
    "series": "SELECT w.date, w.ticker, w.ret AS a, m.b, m.c FROM wrets w JOIN mkt m ON w.date = m.date",
    "ticks": "SELECT ts AS date, value AS a, user_id::DOUBLE AS b, (round(value * 100) % 2001 - 1000) / 1000000 AS port_ret FROM events",
    "users": "SELECT date_trunc('hour', ts) AS date, 'u' || user_id AS ticker, sum(round(value * 100)::BIGINT) / 100 AS ret FROM events GROUP BY 1, 2",
    "wgrid": "SELECT d.date, t.ticker, w.ret FROM (SELECT DISTINCT date FROM wrets) d CROSS JOIN (SELECT DISTINCT ticker FROM wrets) t LEFT JOIN wrets w ON w.date = d.date AND w.ticker = t.ticker",
    "pgrid": "SELECT d.date, t.ticker, w.adj_close FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT ticker FROM prices) t LEFT JOIN prices w ON w.date = d.date AND w.ticker = t.ticker",
    "sig": """SELECT date, ticker, adj_close / lag(adj_close, 1) OVER w - 1 AS x, lag(adj_close, 1) OVER w / lag(adj_close, 2) OVER w - 1 AS y,
        adj_close / avg(adj_close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 AS z,
        lead(adj_close, 1) OVER w / adj_close - 1 AS fwd_ret FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
}


def _z(name: str, source: str, signal: str, out: str, part: str = "date", where: str = "", floor: int = 5) -> dict[str, str]:
    """Views that winsorize and score a signal."""
    known = f"{signal} IS NOT NULL{where}"
    return {
        f"{name}_q": f"SELECT *, quantile_cont({signal}, 0.01) OVER (PARTITION BY {part}) AS lo, quantile_cont({signal}, 0.99) OVER (PARTITION BY {part}) AS hi FROM {source} WHERE {known}",
        f"{name}_c": f"SELECT * EXCLUDE (lo, hi), least(greatest({signal}, lo), hi) AS w FROM {name}_q",
        name: f"""SELECT * EXCLUDE (w), CASE WHEN count(*) OVER (PARTITION BY {part}) >= {floor} AND stddev_pop(w) OVER (PARTITION BY {part}) > 1e-12
            THEN (w - avg(w) OVER (PARTITION BY {part})) / stddev_pop(w) OVER (PARTITION BY {part}) END AS {out} FROM {name}_c""",
    }


def _pre(name: str) -> str:
    w = f"CASE WHEN {name} IS NOT NULL THEN least(greatest({name}, quantile_cont({name}, 0.01) OVER (PARTITION BY date)), quantile_cont({name}, 0.99) OVER (PARTITION BY date)) END"
    return w


def bins_sql(source: str, c: str, out: str, n: int = 5, part: str = "date", floor: int = 0) -> str:
    """The rows of source with a bin column; the fallback by rank widths as assign_bins has it."""
    edge = lambda k: f"quantile_cont({c}, {k / n!r}) OVER p"
    above = " + ".join(f"(CASE WHEN {c} > e{k} THEN 1 ELSE 0 END)" for k in range(1, n))
    width = " + ".join(f"(CASE WHEN share > ((mx - mn) / {n}) * {i} + mn THEN 1 ELSE 0 END)" for i in range(1, n))
    rising = " AND ".join(f"e{k} < e{k + 1}" for k in range(n))
    return f"""SELECT * EXCLUDE (r, mr, share, mn, mx, nk, {", ".join(f"e{k}" for k in range(n + 1))}), CASE WHEN {c} IS NULL OR nk < {floor} THEN NULL
        WHEN {rising} THEN 1 + {above} WHEN mx > mn THEN 1 + {width} ELSE {(n + 1) // 2} END::DOUBLE AS {out}
        FROM (SELECT *, min(share) OVER (PARTITION BY {part}) AS mn, max(share) OVER (PARTITION BY {part}) AS mx
        FROM (SELECT *, r / max(r) OVER (PARTITION BY {part}) AS share, max(r) OVER (PARTITION BY {part}) AS mr FROM (SELECT *,
        CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0 END AS r,
        count({c}) OVER p AS nk, {", ".join(f"{edge(k)} AS e{k}" for k in range(n + 1))} FROM {source} WINDOW p AS (PARTITION BY {part}))))"""


VIEWS |= {
    "mom": """SELECT b.date, b.ticker, CASE WHEN datediff('day', t_start, b.date) >= 120 THEN e.adj_close / s.adj_close - 1 END AS mom_ret
        FROM (SELECT date, ticker, (date - INTERVAL 1 MONTH)::date AS t_end, (date - INTERVAL 7 MONTH)::date AS t_start FROM prices) b
        ASOF LEFT JOIN prices e ON b.ticker = e.ticker AND b.t_end >= e.date ASOF LEFT JOIN prices s ON b.ticker = s.ticker AND b.t_start >= s.date""",
    **_z("momz", "mom", "mom_ret", "momentum_z"),
    "pf": "SELECT p.date, p.ticker, adj_close, f.* EXCLUDE (date, ticker) FROM prices p ASOF LEFT JOIN funda f ON p.ticker = f.ticker AND p.date >= f.date",
    "ey": "SELECT date, ticker, coalesce(1 / nullif(pe_ttm, 0), net_income_ttm / nullif(adj_close * shares_out, 0)) AS earnings_yield FROM pf",
    **_z("valz", "ey", "earnings_yield", "value_z"),
    "qr": """SELECT date, ticker, CASE WHEN abs(shareholders_equity) >= 1000 THEN net_income_ttm / shareholders_equity END AS roe,
        CASE WHEN abs(shareholders_equity) >= 1000 THEN least(total_debt / shareholders_equity, 20.0) END AS de FROM pf""",
    "qw": f"SELECT *, {_pre('roe')} AS roe_w, {_pre('de')} AS de_w FROM qr",
    "qp": "SELECT date, ticker, roe, de, "
    + ", ".join(
        f"""CASE WHEN count({c}) OVER (PARTITION BY date) >= 5 AND stddev_pop({c}_w) OVER (PARTITION BY date) > 1e-12
        THEN ({c}_w - avg({c}_w) OVER (PARTITION BY date)) / stddev_pop({c}_w) OVER (PARTITION BY date) END AS {c}_pre"""
        for c in ("roe", "de")
    )
    + " FROM qw",
    "qual": "SELECT *, roe_pre - de_pre AS quality_raw FROM qp",
    **_z("qualz", "qual", "quality_raw", "quality_z"),
    "fac": """SELECT coalesce(v.date, m.date, q.date) AS date, coalesce(v.ticker, m.ticker, q.ticker) AS ticker, value_z, momentum_z, quality_z
        FROM valz v FULL JOIN momz m ON v.date = m.date AND v.ticker = m.ticker
        FULL JOIN qualz q ON q.date = coalesce(v.date, m.date) AND q.ticker = coalesce(v.ticker, m.ticker)""",
    "comp0": """SELECT *, CASE WHEN coalesce(value_z, momentum_z, quality_z) IS NOT NULL THEN coalesce(value_z * 0.3333333333333333, 0)
        + coalesce(momentum_z * 0.3333333333333333, 0) + coalesce(quality_z * 0.3333333333333333, 0) END AS raw FROM fac""",
    "compq": "SELECT *, quantile_cont(raw, 0.01) OVER (PARTITION BY date) AS lo, quantile_cont(raw, 0.99) OVER (PARTITION BY date) AS hi FROM comp0",
    "compw": "SELECT * EXCLUDE (lo, hi), CASE WHEN raw IS NOT NULL THEN least(greatest(raw, lo), hi) END AS w FROM compq",
    "compz": """SELECT * EXCLUDE (raw, w), CASE WHEN stddev_pop(w) OVER (PARTITION BY date) > 1e-12
        THEN (w - avg(w) OVER (PARTITION BY date)) / stddev_pop(w) OVER (PARTITION BY date) END AS composite FROM compw""",
    "ranks": bins_sql("momz", "momentum_z", "rank", floor=5),
    "capped": "SELECT r.*, p.adj_close * p.shares_out AS market_cap FROM ranks r JOIN pf p USING (date, ticker)",
    "grouped": "SELECT r.*, c.grp FROM capped r ASOF LEFT JOIN cls c ON r.ticker = c.ticker AND r.date >= c.date",
    "sides": """SELECT *, CASE WHEN rank = 5 THEN 1 WHEN rank = 1 THEN -1 ELSE 0 END AS side FROM grouped""",
    "weights": "SELECT *, CASE side WHEN 0 THEN 0.0 ELSE side * 0.5 / count(*) OVER (PARTITION BY date, side) END AS weight FROM sides",
    "eff": "SELECT date, ticker, lag(weight) OVER (PARTITION BY ticker ORDER BY date) AS w FROM weights",
    "port": "SELECT r.date, coalesce(sum(w * ret), 0.0) AS port_ret FROM rets r LEFT JOIN eff USING (date, ticker) GROUP BY r.date",
    "turn": """SELECT date, 0.5 * coalesce(sum(abs(dw)), 0.0) AS turnover FROM (SELECT date, weight - lag(weight) OVER (PARTITION BY ticker ORDER BY date) AS dw FROM weights) GROUP BY date""",
    "wealth": "SELECT date, port_ret, product(1 + port_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM port",
    "curve": """SELECT date, wealth, max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak,
        wealth / max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM wealth""",
    "spells": """SELECT *, abs(drawdown) <= 1e-12 AS flat, sum(CASE WHEN abs(drawdown) <= 1e-12 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell FROM curve""",
    "episodes": """SELECT start, valley, "end", depth, datediff('day', start, coalesce("end", last_day)) AS length_days, datediff('day', valley, "end") AS recovery_days
        FROM (SELECT spell, min(date) AS start, arg_min(date, round(drawdown, 12)) AS valley, min(drawdown) AS depth, max(date) AS last_day FROM
          (SELECT * FROM spells WHERE NOT flat AND drawdown < 0 ORDER BY date) GROUP BY spell)
        LEFT JOIN (SELECT spell - 1 AS spell, date AS "end" FROM spells WHERE flat) USING (spell)""",
}


def sql(body: str, *doubles: str) -> str:
    """body over the views it needs; the named columns rounded to 6 places."""
    need, new = set(), {body}
    while new:
        words = {w for text in new for w in re.findall(r"\b[a-z_0-9]+\b", text) if w in VIEWS} - need
        need |= words
        new = {VIEWS[w] for w in words}
    order = [v for v in VIEWS if v in need]
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    if doubles:
        body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in doubles)}) FROM ({body})"
    return (f"WITH {views}\n" if views else "") + body


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, as sql() rounds them."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
