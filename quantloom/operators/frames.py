"""Normalising, as-of joins, reshaping and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import finite, last_known, ts


#: The numeric columns of a price table.
PRICES = ("open", "high", "low", "close", "adj_close", "volume")


def normalize(df: DataFrame, required: Sequence[str] = (), numeric: Sequence[str] = (), date: str | None = "date") -> DataFrame:
    """Lower-case column names, checked; the date column as DATE, rows without one dropped; numeric ones as finite doubles."""
    df = df.toDF(*(c.lower().strip() for c in df.columns))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if date and date in df.columns:
        df = df.withColumn(date, F.to_date(F.try_to_timestamp(F.col(date).cast("string")))).filter(F.col(date).isNotNull())
    return df.withColumns({c: finite(F.col(c).try_cast("double")) for c in numeric if c in df.columns}) if numeric else df


def stretched(both: DataFrame, most: int) -> DataFrame:
    """both with _slot: stretches of a key's time of about most rows, from its counts by day; a key with fewer is one stretch."""
    day = F.date_trunc("day", "_at")
    counts = both.groupBy("_by", day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_by").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    slots = counts.select("_by", "_day", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / most).alias("_slot"))
    return both.withColumn("_day", day).join(slots, ["_by", "_day"], "left").drop("_day")


def asof(left: DataFrame, right: DataFrame, by: str = "ticker", on: str = "date", at: Column | None = None, values: Sequence[str] | None = None, chunk: str | None = None, most: int | None = None) -> DataFrame:
    """left with the values of the latest right row at or before each left row's time; one row out for each row in.

    at: another time of left than its own, such as a month earlier. Both sides are merged in one sort by key and
    time, with right rows first on a tie; there is no join, so no row multiplies.

    For keys with more rows than one task should sort, a key is sorted by stretches of time, and what the stretches
    before hand on, one row a key and stretch, comes to the rows by a join. chunk (year, month, day ...): all keys
    by the same stretches. most: each key by stretches of about so many rows, or a day's if that has more, chosen
    from its counts; most keys are one stretch then, and a hot one is as many as it needs.
    """
    values = list(values or (c for c in right.columns if c not in (by, on)))
    here = left.select(F.col(by).alias("_by"), (F.col(on) if at is None else at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    there = right.select(F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    both = here.unionByName(there, allowMissingColumns=True)
    if chunk is None and most is None:
        both = both.withColumn("_right", last_known("_right", W.partitionBy("_by").orderBy("_at", "_side")))
    else:
        both = stretched(both, most) if chunk is None else both.withColumn("_slot", F.date_trunc(chunk, "_at"))
        ends = both.groupBy("_by", "_slot").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
        before = W.partitionBy("_by").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select("_by", "_slot", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        both = both.withColumn("_right", last_known("_right", W.partitionBy("_by", "_slot").orderBy("_at", "_side")))
        both = both.join(ends, ["_by", "_slot"], "left").withColumn("_right", F.coalesce("_right", "_before"))
    both = both.filter(F.col("_side") == 1)
    return both.select("_left.*", *(F.col(f"_right.{v}").alias(v) for v in values))


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row by order of each key."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def wide_to_long(df: DataFrame, prefix: str = "adj_close_", value: str = "adj_close") -> DataFrame:
    """(date, ticker, value) of a frame with a column for each ticker."""
    wide = [c for c in df.columns if c.lower().startswith(prefix)]
    long = df.unpivot(["date"], wide, "_name", value)
    return long.select("date", F.upper(F.substring("_name", len(prefix) + 1, 1000)).alias("ticker"), value)


def long_to_wide(df: DataFrame, names: Sequence[str] | None, name: str, value: str, prefix: str = "ret_", most: int = 5000) -> DataFrame:
    """A row a date and a column for each of names, its first known value of the date.

    Without names, those of the table in order, at most so many: a wide frame is for the eye, panels of more names
    stay long (see matrices and stack_panels).
    """
    if names is None:
        names = [r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"more than {most} names of {name}: keep the frame long")
    out = df.groupBy("date").pivot(name, list(names)).agg(F.first(value, ignorenulls=True))
    return out.select("date", *(F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names))


def stack_panels(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """(date, ticker) rows where both of two long panels have a value; no list of names."""
    left = a.select("date", "ticker", a_name).filter(F.col(a_name).isNotNull())
    return left.join(b.select("date", "ticker", b_name).filter(F.col(b_name).isNotNull()), ["date", "ticker"])


def stack_matrices(a: DataFrame, b: DataFrame, names: Sequence[str], a_name: str, b_name: str) -> DataFrame:
    """(date, ticker) rows where both of two wide frames have a value."""
    left = a.unpivot(["date"], list(names), "ticker", a_name).filter(F.col(a_name).isNotNull())
    right = b.unpivot(["date"], list(names), "ticker", b_name).filter(F.col(b_name).isNotNull())
    return left.join(right, ["date", "ticker"])


def merge_first_wins(first: DataFrame, *more: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Full outer joins on keys; in a cell, the first frame that has a value wins."""
    out, keys = first, list(keys)
    for other in more:
        own, new = out.columns, [c for c in other.columns if c not in out.columns]
        both = [c for c in other.columns if c in own and c not in keys]
        other = other.withColumnsRenamed({c: f"_other_{c}" for c in both})
        out = out.join(other, keys, "outer")
        out = out.select(*(F.coalesce(c, f"_other_{c}").alias(c) if c in both else F.col(c) for c in own), *new)
    return out


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """target with source's rows put in by key; columns that source lacks stay NULL for its rows.

    Of source's rows of one key the last by order is put in; without order, the one with the greatest values. A
    null in a key is a value like others.
    """
    rest = [c for c in source.columns if c not in keys]
    rank = [order.desc_nulls_last()] if order is not None else []
    source = dedup_first(source, keys, [*rank, *(F.desc_nulls_last(c) for c in (rest or keys))])
    own = source.select(*(F.col(k).alias(f"_key_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return target.join(own, same, "left_anti").unionByName(source, allowMissingColumns=True).select(*target.columns)


def price_frame(df: DataFrame, required: Sequence[str] = ("adj_close",), key: str | None = "ticker", on: str = "date", order: Column | None = None) -> DataFrame:
    """A price table checked: names in lower case with _ for blanks, required columns there, times without a zone,
    numbers as finite doubles, and of rows of one (key, time) the last by order (else the greatest) alone.
    """
    df = df.toDF(*(c.lower().strip().replace(" ", "_") for c in df.columns))
    missing = [c for c in (on, *required) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kind = dict(df.dtypes)[on]
    time = F.col(on) if kind in ("date", "timestamp_ntz") else F.try_to_timestamp(F.col(on).cast("string")).cast("timestamp_ntz")
    df = df.withColumn(on, time).filter(F.col(on).isNotNull())
    df = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in PRICES if c in df.columns})
    keys = [k for k in (key, on) if k and k in df.columns]
    rank = [order.desc_nulls_last()] if order is not None else []
    return dedup_first(df, keys, [*rank, *(F.desc_nulls_last(c) for c in df.columns if c not in keys)])


def fill_forward(df: DataFrame, columns: Sequence[str], key: str = "ticker") -> DataFrame:
    return df.withColumns({c: last_known(c, ts(key)) for c in columns})


def common_times(df: DataFrame, name: str = "ticker", on: str = "date") -> DataFrame:
    """The times that all names of a long panel have, from counts by time."""
    all_ = df.agg(F.count_distinct(name).alias("_all"))
    return df.groupBy(on).agg(F.count_distinct(name).alias("_n")).join(F.broadcast(all_)).filter("_n = _all").select(on)


def only_in(df: DataFrame, universe: DataFrame, key: str = "symbol") -> DataFrame:
    return df.join(universe.select(key).distinct(), key, "left_semi")


def except_in(df: DataFrame, excluded: DataFrame, key: str = "symbol") -> DataFrame:
    return df.join(excluded.select(key), key, "left_anti")


def dummies(df: DataFrame, group: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(date, keys, param, value): 1 or 0 for each group of a date but its first, named group_<name>; a null group has zeros."""
    seen = df.select("date", F.col(group).alias("_g")).filter(F.col("_g").isNotNull()).distinct()
    seen = seen.withColumn("_first", F.min("_g").over(W.partitionBy("date"))).filter(F.col("_g") > F.col("_first"))
    value = F.coalesce(F.col(group) == F.col("_g"), F.lit(False)).cast("double")
    return df.join(seen, "date").select("date", *keys, F.concat(F.lit(f"{group}_"), "_g").alias("param"), value.alias("value"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a primary key would refuse, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child that a foreign key would refuse."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
