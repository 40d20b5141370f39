"""Average ranks and exact quantiles of very many values, in ranges of values instead of one sort.

Edges of ranges come from a mergeable sketch, which decides only how even the ranges are: counts of what is below a
range are exact, so ranks and quantiles are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges at most, and values that a range is meant to hold.
RANGES, PER_RANGE = 512, 1_000_000
#: A group with at least one row in SHARE is large.
SHARE = 1000


def edges_of(df: DataFrame, columns: Sequence[str], per_range: int) -> dict[str, list[float]]:
    """For each column the values that part it into ranges of about per_range; one aggregate, some hundred numbers to the driver."""
    if not columns:
        return {}
    n = df.agg(F.count(F.lit(1))).first()[0]
    parts = min(RANGES, max(1, -(-n // per_range)))
    if parts == 1:
        return {c: [] for c in columns}
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = df.agg(*(F.percentile_approx(c, shares, 20 * parts).alias(c) for c in columns)).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def range_of(value: Column, edges: list[float]) -> Column:
    """The number of edges below the value; the ranges are halved as in a search, so the expression is small."""
    if not edges:
        return F.lit(0)
    middle = len(edges) // 2
    if len(edges) <= 8:
        return sum(((value > F.lit(e)).cast("int") for e in edges), F.lit(0))
    high = range_of(value, edges[middle + 1 :]) + middle + 1
    return F.when(value > F.lit(edges[middle]), high).otherwise(range_of(value, edges[:middle]))


def whole_ranks(df: DataFrame, columns: Sequence[str], prefix: str = "_r_", per_range: int = PER_RANGE) -> DataFrame:
    """df with the average rank of each column among all rows' known values, as average_rank has it, as prefix and name.

    Distinct values are counted first, then ranges number them: a range's window holds its distinct values, and
    between ranges goes one row a range. Ranks come back to the rows by value.
    """
    edges = edges_of(df, columns, per_range)
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_range", range_of(F.col("_value"), edges[c]))
        within = W.partitionBy("_range").orderBy("_value").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        sizes = counts.groupBy("_range").agg(F.sum("_n").alias("_size"))
        before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = counts.join(sizes.select("_range", before.alias("_before")), "_range")
        ranked = ranked.select("_value", (F.col("_before") + F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(f"{prefix}{c}"))
        df = df.join(ranked, F.col(c) == F.col("_value"), "left").drop("_value")
    return df


def with_bounds(known: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """known with its group's bounds, one row a group with _all, its number of rows.

    Groups with at least a SHARE-th of all rows number at most SHARE: theirs pass through the driver and are
    broadcast, so that no group's rows meet in a task. The others go through a shuffle join, if there are any.
    """
    n = known.agg(F.count(F.lit(1))).first()[0]
    floor = max(2, -(-n // SHARE))
    large = bounds.filter(F.col("_all") >= floor).collect()
    sent = F.broadcast(known.sparkSession.createDataFrame(large, bounds.schema))
    met = known.join(sent, by)
    if sum(r["_all"] for r in large) == n:
        return met
    rest = known.join(sent.select(*by), by, "left_anti").join(bounds.filter(F.col("_all") < floor), by)
    return met.unionByName(rest)


def exact_quantiles(df: DataFrame, c: str, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """by and quantiles (array<double>): the interpolated quantiles of each group, bit for bit those of percentile.

    percentile holds a group's distinct values in one task. Here a sketch, which combines on the map side, brackets
    each quantile within a few accuracy-ths of the group's rows; what is below a bracket is counted, and only
    distinct values within brackets, with their counts, are put in order; a group of up to accuracy rows is one
    bracket. Rows get their group's brackets by with_bounds, for which two small jobs count the rows and sketch the
    groups. Groups without values have no result.
    """
    by = list(by)
    known = df.select(*by, F.col(c).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    slack = 2 / accuracy
    ends_of = [F.lit(min(max(p + d, 0.0), 1.0)) for d in (-slack, slack) for p in shares]
    sketch = F.percentile_approx("_v", F.array(*ends_of), accuracy).alias("_ends")
    bounds = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch)
    at = lambda name, i: F.col(name)[i]
    few = F.col("_all") <= accuracy
    first = [F.when(few | F.lit(p <= slack), F.col("_min")).otherwise(at("_ends", i)) for i, p in enumerate(shares)]
    last = [F.when(few | F.lit(p >= 1 - slack), F.col("_max")).otherwise(at("_ends", i + len(shares))) for i, p in enumerate(shares)]
    bounds = bounds.select(*by, "_all", F.array(*first).alias("_first"), F.array(*last).alias("_last"))
    met = with_bounds(known, bounds, by) if by else known.join(F.broadcast(bounds))
    below = [F.sum((F.col("_v") < at("_first", i)).cast("long")).alias(f"_below{i}") for i in range(len(shares))]
    counted = met.groupBy(*by).agg(*below)
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: (F.col("_v") >= F.get(F.col("_first"), i)) & (F.col("_v") <= F.get(F.col("_last"), i)))
    values = met.select(*by, "_all", "_v", F.explode(inside).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    values = values.join(counted, by) if by else values.join(F.broadcast(counted))
    start = F.array(*(F.col(f"_below{i}") for i in range(len(shares))))[F.col("_i")]
    over = W.partitionBy(*by, "_i").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    values = values.withColumn("_from", start + F.coalesce(F.sum("_n").over(over), F.lit(0)))
    place = (F.col("_all") - 1) * F.array(*map(F.lit, shares))[F.col("_i")]
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n"))
    ends = values.withColumn("_place", place).groupBy(*by, "_i").agg(
        F.max(F.when(holds(F.floor("_place")), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil("_place")), F.col("_v"))).alias("_b"), F.first("_place").alias("_place")
    )
    a, b, p = F.col("_a"), F.col("_b"), F.col("_place")
    value = F.when((F.floor(p) == F.ceil(p)) | (a == b), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
    listed = F.array_sort(F.collect_list(F.struct("_i", value.alias("v"))))
    return ends.groupBy(*by).agg(F.transform(listed, lambda s: s["v"]).alias("quantiles")).filter(F.size("quantiles") > 0)
