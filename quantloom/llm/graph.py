"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, dropped, staged


def _known(least: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether they are stars: no node has two that are less, or both less and larger ones."""
    twice, odd = least.agg(F.sum("n"), F.max((F.col("n_less") > 1) | (F.col("n_less") > 0) & (F.col("n_less") < F.col("n")))).first()
    return (twice or 0) // 2, not odd


def components(links: DataFrame) -> DataFrame:
    """v and m, the least node of v's component, for each node v of links (a, b) that isn't itself the least.

    Each round points every node's larger neighbours, then all its neighbours, to the least it knows, which
    takes rounds in the order of the logarithm of the nodes. Counts are pre-aggregated and go back to hubs'
    links by counted_join; the links stay in the cluster. Self-links, repeats and nulls don't matter. It ends as soon
    as the links are stars, which the nodes' own counts tell: links that are stars already take no round.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    edges = staged(edges, "links")
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        lesser = F.sum((F.col("w") < F.col("u")).cast("long"))
        least = staged(both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"), F.count("*").alias("n"), lesser.alias("n_less")), "least")
        n_links, stars = _known(least)
        if stars:
            dropped(least)
            return edges
        large = counted_join(both.filter(F.col("w") > F.col("u")), least.drop("n_less"), ["u"], 2 * n_links)
        large = staged(large.select(F.col("w").alias("v"), "m").distinct(), "large")
        dropped(least)
        least = staged(large.groupBy("v").agg(F.min("m").alias("least"), F.count("*").alias("n")), "least")
        small = counted_join(large, least, ["v"], n_links).select(F.col("m").alias("v"), F.col("least").alias("m"))
        small = small.filter(F.col("v") != F.col("m")).unionByName(least.select("v", F.col("least").alias("m")))
        old, edges = edges, staged(small.distinct(), "edges")
        for used in (old, large, least):
            dropped(used)
