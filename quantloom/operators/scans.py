"""Series without a key, worked on in blocks of time: scans in two levels, and rolling frames with carried edges.

A window over all rows of a series would put them in one task. Here a slot of time (year, month, day ...) is a
task's share; between slots goes one row a slot, and a frame's edge is copied from the block before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import running

#: How two stretches of a scan are put together: the aggregate, what the earlier and the later stretch make, and what nothing counts as.
KINDS = {
    "sum": (F.sum, lambda before, own: before + own, 0.0),
    "product": (F.product, lambda before, own: before * own, 1.0),
    "max": (F.max, F.greatest, None),
    "min": (F.min, F.least, None),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before), None),
}


def slot_of(on: str, chunk: str) -> Column:
    """The slot of time that a row belongs to; rows without a time come first."""
    return F.coalesce(F.date_trunc(chunk, F.col(on)), F.lit("0001-01-01").cast("timestamp"))


def handed_on(here: DataFrame, on: str, kinds: dict[str, str]) -> DataFrame:
    """_slot with what all earlier slots make of each column, from its running value in each slot's last row.

    here is partitioned by _slot already, so this takes no shuffle of its rows; between slots goes one row a slot.
    """
    last = F.max_by(F.struct(*kinds), F.struct(F.col(on).isNotNull(), F.col(on)))
    before = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    ends = here.groupBy("_slot").agg(last.alias("_last"))
    return ends.select("_slot", *(KINDS[kind][0](F.col("_last")[c]).over(before).alias(f"_{c}") for c, kind in kinds.items()))


def scanned(df: DataFrame, on: str, chunk: str, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with running values in the order of on: columns gives kind (see KINDS) and expression of each."""
    over = running(W.partitionBy("_slot").orderBy(on))
    here = df.withColumn("_slot", slot_of(on, chunk)).withColumns({name: KINDS[kind][0](c).over(over) for name, (kind, c) in columns.items()})
    out = here.join(handed_on(here, on, {name: kind for name, (kind, _) in columns.items()}), "_slot")
    for name, (kind, _) in columns.items():
        _, combine, nothing = KINDS[kind]
        earlier, own = F.col(f"_{name}"), F.col(name)
        if nothing is not None:
            earlier, own = F.coalesce(earlier, F.lit(nothing)), F.coalesce(own, F.lit(nothing))
        out = out.withColumn(name, combine(earlier, own))
    return out.drop("_slot", *(f"_{name}" for name in columns))


def numbered(df: DataFrame, on: str = "date", chunk: str = "year", name: str = "_at") -> DataFrame:
    """df with each row's place from 0 in the order of on."""
    nth = F.row_number().over(W.partitionBy("_slot").orderBy(on)).cast("long")
    here = df.withColumn("_slot", slot_of(on, chunk)).withColumn(name, nth)
    out = here.join(handed_on(here, on, {name: "sum"}), "_slot")
    return out.withColumn(name, F.col(name) - 1 + F.coalesce(f"_{name}", F.lit(0).cast("long"))).drop("_slot", f"_{name}")


def halo(at: Column, size: int, edge: int) -> Column:
    """The blocks that a row at a place is needed in: its own and, within edge rows of its end, the next."""
    own = F.floor(at / size).cast("long")
    near = at % size >= size - edge
    return F.when(near, F.array(own, own + 1)).otherwise(F.array(own))


def framed(df: DataFrame, window: int, on: str = "date", chunk: str = "year", size: int = 4096, by: Sequence[str] = ()) -> DataFrame:
    """df in blocks of size rows, each with the window - 1 rows before it: _at, _block, and _own where a row isn't of another block.

    A frame of window rows in block_order(by) holds for own rows what it would hold in the whole series. by: the
    series' key, where there are many; each is numbered by itself then, without slots.
    """
    size = max(size, window - 1, 1)
    if by:
        df = df.withColumn("_at", (F.row_number().over(W.partitionBy(*by).orderBy(on)) - 1).cast("long"))
    else:
        df = numbered(df, on, chunk)
    df = df.withColumn("_block", F.explode(halo(F.col("_at"), size, window - 1)))
    return df.withColumn("_own", F.col("_block") == F.floor(F.col("_at") / size))


def block_order(by: Sequence[str] = ()) -> WindowSpec:
    return W.partitionBy(*by, "_block").orderBy("_at")


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block", "_at")
