"""Operator 12: a Merkle manifest of a dataset, over a trie keyed by the digits of exact ranks.

Ranks within a group come from histograms of the digits of doc_id: counts by all but the last digits are summed up
to those by the first digits, and each digit's siblings are summed from the least on, so that no sort or window
holds more than the siblings of one prefix. The digits of a rank in the tree's fanout are its path in the trie:
nodes with the longest prefixes are reduced first, DIGITS digits at a time, a task holding a few thousand nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, read, staged

#: Children of a node as bits, and the digits that are reduced at a time.
BITS, DIGITS = 3, 4
FANOUT, BLOCK_BITS = 1 << BITS, BITS * DIGITS
#: Bits of a digit of doc_id, and digits before its last one.
ID_BITS, HIGHER = 12, 4
#: The prefix of rows without a doc_id, below that of any number.
NO_ID = -(1 << 60)


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A dash for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def siblings_before(rows: DataFrame, by: Sequence[str], digit: str, n: str = "n") -> Column:
    """What the siblings with a smaller digit sum to; siblings are as many as there are values of a digit."""
    window = W.partitionBy(*by).orderBy(digit).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(window), F.lit(0).cast("long"))


def buckets(rows: DataFrame, bits: int) -> DataFrame:
    """group, high (doc_id without its last digit), n, start (rows of the group with a smaller high) and size (of the group)."""
    levels = [staged(rows.groupBy("group", "high").agg(F.count("*").alias("n")), "histogram")]
    for _ in range(HIGHER):
        above = levels[-1].groupBy("group", F.shiftright("high", bits).alias("high")).agg(F.sum("n").alias("n"))
        levels.append(staged(above, "histogram"))
    out = levels[-1].withColumn("start", siblings_before(levels[-1], ["group"], "high")).withColumn("size", F.sum("n").over(W.partitionBy("group")))
    for level in reversed(levels[:-1]):
        parents = out.select("group", F.col("high").alias("parent"), F.col("start").alias("parent_start"), "size")
        below = level.withColumn("parent", F.shiftright("high", bits)).join(parents, ["group", "parent"])
        start = F.col("parent_start") + siblings_before(below, ["group", "parent"], "high")
        out = below.withColumn("start", start).select("group", "high", "n", "start", "size")
    return staged(out, "buckets")


def ranks(rows: DataFrame, most: int = 1 << ID_BITS) -> DataFrame:
    """rows (row, group, id, leaf, ...) with rank and n: the place in its group from 0, by id (null first), leaf, row, and the group's rows.

    A bucket of more than most rows has repeated ids; it is parted by further digits, of the id, then of the leaf,
    then of row, which is unique. All others are numbered in a window of at most most rows. rows: staged.
    """
    rows = rows.withColumn("high", F.coalesce(F.shiftright("id", ID_BITS), F.lit(NO_ID).cast("long")))
    found = buckets(rows, ID_BITS)
    placed = counted_join(rows, found, ["group", "high"], rows.count()).withColumn("path", F.lit(""))
    leaf_digits = [F.conv(F.substring("leaf", 1 + 3 * j, 3), 16, 10).cast("long") for j in range(4)]
    row_digits = [F.shiftright("row", ID_BITS * j).bitwiseAND(4095) for j in reversed(range(6))]
    digits = [F.coalesce(F.col("id").bitwiseAND(4095), F.lit(0).cast("long")), *leaf_digits, *row_digits]
    order = W.partitionBy("group", "high", "path").orderBy("id", "leaf", "row")
    done = []
    largest = found.agg(F.max("n")).first()[0] or 0
    while True:
        small = placed.filter(F.col("n") <= most) if largest > most else placed
        done.append(small.withColumn("rank", F.col("start") + F.row_number().over(order) - 1).withColumn("n", F.col("size")).drop("high", "path", "start", "size"))
        if largest <= most or not digits:
            break
        open_ = staged(placed.filter(F.col("n") > most).withColumn("digit", digits.pop(0)).drop("n"), "open")
        keys = ["group", "high", "path", "digit"]
        parts = open_.groupBy(*keys, "start").agg(F.count("*").alias("n"))
        parts = parts.withColumn("start", F.col("start") + siblings_before(parts, keys[:3], "digit"))
        parts = staged(parts, "parts")
        placed = counted_join(open_.drop("start"), parts, keys, open_.count())
        placed = placed.withColumn("path", F.concat_ws(".", "path", "digit")).drop("digit")
        largest = parts.agg(F.max("n")).first()[0] or 0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ordered(groups: DataFrame, by: str) -> DataFrame:
    """groups with rank, its place in the order of a string column (null first, bytewise), from 0.

    Sorted by ranges; the driver gets one count a partition.
    """
    numbered = staged(groups.orderBy(F.asc_nulls_first(by)).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p] = total
        total += n
    start = F.create_map(*(F.lit(x) for item in starts.items() for x in item)) if starts else F.lit(None).cast("map<bigint,bigint>")
    return numbered.withColumn("rank", start[part] + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def levels_of(hashes: list[str], total: int) -> list[list[str]]:
    """The block's nodes digit by digit, as far up as a block goes or until the group has one node left."""
    levels = [hashes]
    while len(levels) <= DIGITS and total > 1:
        below = levels[-1]
        levels.append([sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
        total = -(-total // FANOUT)
    return levels


def around(level: list[str], i: int) -> tuple[str, str]:
    """The siblings left and right of node i in its run, as text."""
    first = i - i % FANOUT
    return "".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])


def by_rank(table: pa.Table) -> pa.Table:
    return table.sort_by("rank")


def reduced(nodes: DataFrame) -> DataFrame:
    """The trie's nodes DIGITS digits up: from (group, rank, hash, n) with n nodes in the group to the same of prefixes."""

    def up(table: pa.Table) -> pa.Table:
        table = by_rank(table)
        n = table.column("n")[0].as_py()
        top = levels_of(table.column("hash").to_pylist(), n)[-1]
        prefix = table.column("rank")[0].as_py() >> BLOCK_BITS
        rest = -(-n // (1 << BLOCK_BITS))
        return pa.table([table.column("group")[:1].combine_chunks(), pa.array([prefix], pa.int64()), pa.array(top), pa.array([rest], pa.int64())], names=["group", "rank", "hash", "n"])

    keyed = nodes.select("group", "rank", "hash", "n", F.shiftright("rank", BLOCK_BITS).alias("prefix"))
    return keyed.groupBy("group", "prefix").applyInArrow(up, "group string, rank long, hash string, n long")


PATH = "group string, rank long, left array<string>, right array<string>, top string"


def descended(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The path to the root of each node: what is left and right of it, level by level, and top, as in parents.

    parents: paths of the nodes DIGITS digits up. A node and its parent meet by prefix.
    """

    def down(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = by_rank(table)
        levels = levels_of(table.column("hash").to_pylist(), table.column("n")[0].as_py())[:-1]
        upper_left, upper_right, top = parent.column("left")[0].as_py(), parent.column("right")[0].as_py(), parent.column("top")[0].as_py()
        left, right = [], []
        for i in range(table.num_rows):
            own = [around(level, i >> BITS * k) for k, level in enumerate(levels)]
            left.append([x for x, _ in own] + upper_left)
            right.append([x for _, x in own] + upper_right)
        lists = pa.list_(pa.string())
        return pa.table([table.column("group").combine_chunks(), table.column("rank").combine_chunks(), pa.array(left, lists), pa.array(right, lists), pa.array([top] * table.num_rows)], names=["group", "rank", "left", "right", "top"])

    keyed = nodes.select("group", "rank", "hash", "n", F.shiftright("rank", BLOCK_BITS).alias("prefix"))
    return keyed.groupBy("group", "prefix").cogroup(parents.groupBy("group", "rank")).applyInArrow(down, PATH)


def folded(leaf: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in zip(left, right, strict=True):
        leaf = sha256((before + leaf + after).encode()).hexdigest()
    return leaf


OUT = (("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("rank", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()))
OUT_DDL = "row long, doc_id long, leaf string, rank long, subroot string, root string, proof_sha256 string, folded_root string, left array<string>, right array<string>"


def proven(leaves: DataFrame, parents: DataFrame, root: str, proofs: bool) -> DataFrame:
    """Each leaf with the digest of its proof and the root that its probe folds to, in blocks as descended."""
    lists = pa.list_(pa.string())

    def down(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = by_rank(table)
        levels = levels_of(table.column("leaf").to_pylist(), table.column("n")[0].as_py())[:-1]
        upper_left, upper_right, top = parent.column("left")[0].as_py(), parent.column("right")[0].as_py(), parent.column("top")[0].as_py()
        upper = "".join(x + y for x, y in zip(upper_left, upper_right))
        cells: list[list] = [[], [], [], []]
        for i, probe in enumerate(table.column("probe").to_pylist()):
            own = [around(level, i >> BITS * k) for k, level in enumerate(levels)]
            left, right = [x for x, _ in own], [x for _, x in own]
            cells[0].append(sha256(("".join(x + y for x, y in own) + upper).encode()).hexdigest())
            cells[1].append(folded(folded(probe, left, right), upper_left, upper_right))
            cells[2].append(left + upper_left if proofs else None)
            cells[3].append(right + upper_right if proofs else None)
        n = table.num_rows
        held = [table.column(k).combine_chunks() for k in ("row", "id", "leaf", "rank")]
        arrays = [*held, pa.array([top] * n), pa.array([root] * n), pa.array(cells[0]), pa.array(cells[1]), pa.array(cells[2], lists), pa.array(cells[3], lists)]
        return pa.table(arrays, names=[*(k for k, _ in OUT), "left", "right"])

    keyed = leaves.select("row", "id", "group", "leaf", "probe", "rank", "n", F.shiftright("rank", BLOCK_BITS).alias("prefix"))
    return keyed.groupBy("group", "prefix").cogroup(parents.groupBy("group", "rank")).applyInArrow(down, OUT_DDL)


def climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes and what they are reduced to, until each group has one node; most: nodes of the largest group."""
    tries = [nodes]
    while most > 1:
        tries.append(staged(reduced(tries[-1]), "nodes"))
        most = -(-most // (1 << BLOCK_BITS))
    return tries


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", probe: Column | None = None, proofs: bool = False, most: int = 1 << ID_BITS) -> DataFrame:
    """row, doc_id, leaf, rank, subroot, root, proof_sha256, folded_root and verified for each row of docs.

    A leaf is the digest of columns. Leaves of a group ascend by doc_id (null first; equal ids by leaf, and equal
    leaves are alike whichever comes first), each 8 consecutive nodes become one until one is left, the group's
    subroot; subroots, ordered by group (null first, bytewise), likewise become the root. The proof are the
    siblings on the way from leaf to root; folded_root is what they make of probe (an altered leaf; the leaf
    itself by default), and verified whether that is the root. proofs: with left and right, the proof itself, a
    level an item, else null. An empty table gives no rows. Columns that are not asked for are ignored. A null
    text, id or group is a value of its own. most: rows that are numbered in one window.
    """
    leaf = hashed(*(field(F.col(c)) for c in columns))
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))
    bare = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), name.alias("group"), leaf.alias("leaf"), (leaf if probe is None else F.coalesce(probe, leaf)).alias("probe"))
    leaves = staged(bare, "leaves")
    ranked = staged(ranks(leaves, most), "ranked")
    n_groups, largest = ranked.filter("rank = 0").agg(F.count("*"), F.max("n")).first()
    tries = climbed(ranked.select("group", "rank", F.col("leaf").alias("hash"), "n"), largest or 0)
    order = F.when(F.col("group") != "null", F.substring("group", 2, 1 << 30))
    tops = ordered(tries[-1].select("group", "hash", order.alias("order")), "order").drop("order")
    tops = staged(tops.select(F.lit("").alias("group"), "rank", "hash", F.lit(n_groups).cast("long").alias("n"), F.col("group").alias("named")), "tops")
    upper = climbed(tops, n_groups)
    root = upper[-1].select("hash").first()
    if root is None:
        return proven(ranked, tops.select("group", "rank", F.array("hash").alias("left"), F.array("hash").alias("right"), F.lit("").alias("top")), "", proofs).withColumn("verified", F.lit(False))
    none = F.array().cast("array<string>")
    paths = upper[-1].select("group", "rank", none.alias("left"), none.alias("right"), F.col("hash").alias("top"))
    for nodes in reversed(upper[:-1]):
        paths = staged(descended(nodes, paths), "paths")
    names = tops.select("rank", F.col("named"), F.col("hash").alias("subroot"))
    paths = staged(paths.join(names, "rank").select(F.col("named").alias("group"), F.lit(0).cast("long").alias("rank"), "left", "right", F.col("subroot").alias("top")), "paths")
    for nodes in reversed(tries[1:-1]):
        paths = staged(descended(nodes, paths), "paths")
    return proven(ranked, paths, root[0], proofs).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, the rest as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = hashed(*(field(lowered(F.col(c)) if c == "text" else F.col(c)) for c in columns))
    probe = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, altered)
    return manifest(docs, columns, probe=probe).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
