"""Operator 5: near-duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

The bands only propose pairs; every link is confirmed on the full shingle sets. In a bucket, each member is
compared with the hub. Where that leaves a bucket with several components, the members outside the largest one
are held against all members in blocks within tasks, so that no pair is ever a row. Two bounds tell which members
can be similar enough to another: shingles that no other candidate has are in no intersection, and an intersection
has no more shingles in each part of the hash space than the side with fewer there. Those are compared on their
full sets, and of what is similar enough as many links come out as it takes to join the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, dropped, read, record, release, staged, utf8
from quantloom.llm.graph import components

KEY = ["n_shingles", "fp_high", "fp_low"]
MULTIPLY, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SCHEMA = (("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("fp_high", pa.int64()), ("fp_low", pa.int64()), ("bands", pa.list_(pa.int64())))
DDL = "doc_id long, row long, n_shingles long, fp_high long, fp_low long, bands array<long>"


@dataclass(frozen=True)
class NearDuplicates:
    """Links need 100 * intersection >= percent * union of the sets of shingle-word shingles.

    bands of rows values: at 75 % a pair is in no common bucket with a probability of (1 - 0.75 ** 6) ** 64, or
    4 in a million; at 10 % it is in one with 6 in a hundred thousand, so that a passage which many documents
    share doesn't make them candidates. share: rows of a hub or a bucket that meet in one task, about; larger ones
    are dealt over more tasks. parts: of the hash space, for the bound on intersections.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 6
    share: int = 2000
    parts: int = 128
    load: int = 1_000_000


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of words, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * MULTIPLY + h[i : n + i]
    out ^= out >> np.uint64(32)
    out *= FINISH
    out ^= out >> np.uint64(29)
    return np.unique(out)


class OnePermutation:
    """Signatures of bins values (a power of two): the least hash of each bin, empty bins filled by optimal densification."""

    def __init__(self, bins: int, tries: int = 4096):
        self.bins, self.shift = bins, np.uint64(64 - bins.bit_length() + 1)
        at = np.arange(tries * bins, dtype=np.uint64) * MULTIPLY
        at ^= at >> np.uint64(31)
        self.probe = ((at * FINISH) >> self.shift).astype(np.int64).reshape(tries, bins)

    def __call__(self, distinct: np.ndarray) -> np.ndarray:
        """distinct: sorted hashes, at least one."""
        bins = (distinct >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]], filled[bins[first]] = distinct[first], True
        if len(first) == 1:
            out[:] = distinct[0]
            return out
        empty = np.flatnonzero(~filled)
        for t in range(0, len(self.probe), 16):
            if not len(empty):
                return out
            from_bin = self.probe[t : t + 16, empty]
            hit = filled[from_bin]
            which = hit.argmax(0)
            done = hit[which, np.arange(len(empty))]
            out[empty[done]] = out[from_bin[which, np.arange(len(empty))][done]]
            empty = empty[~done]
        out[empty] = distinct[0]
        return out


def banded(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64) * FINISH
    for i in range(rows):
        out = (out ^ (out >> np.uint64(32))) * MULTIPLY + parts[:, i]
    return ((out ^ (out >> np.uint64(32))) * FINISH).view(np.int64)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a hash of the whole set."""
    return np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")


def keyed(docs: DataFrame, row: str | None) -> DataFrame:
    key = F.col(row).cast("long") if row else F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row"), "text")


def signatures(docs: DataFrame, rules: NearDuplicates, row: str | None) -> DataFrame:
    """Set size, fingerprint and band hashes of each row of docs, with the column row, or else a hash of the text."""

    def scan(batches):
        used = rules.bands * rules.rows
        sign = OnePermutation(1 << (used - 1).bit_length())
        for batch in batches:
            sizes, high, low, bands = [], [], [], []
            for text in utf8(batch):
                own = shingles(text, rules.shingle)
                digest = fingerprint(own)
                sizes.append(len(own))
                high.append(digest[0])
                low.append(digest[1])
                bands.append(banded(sign(own)[:used], rules.rows) if len(own) else np.empty(0, np.int64))
            yield record(SCHEMA, [batch.column(0), batch.column(1), sizes, high, low, bands])

    return keyed(docs, row).mapInArrow(scan, DDL)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingle hashes for the wanted nodes, made again from the texts of their least rows.

    docs: as keyed. wanted: node, fingerprint, least_id and least_row, the doc_id and row to read.
    """

    def scan(batches):
        for batch in batches:
            nodes, sets = [], []
            for node, high, low, text in zip(*(batch.column(k).to_pylist() for k in ("node", "fp_high", "fp_low")), utf8(batch), strict=True):
                own = shingles(text, size)
                if (fingerprint(own) == (high, low)).all():
                    nodes.append(node)
                    sets.append(own.view(np.int64))
            yield record((("node", pa.int64()), ("held", pa.list_(pa.int64()))), [nodes, sets])

    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("row") == F.col("least_row")))
    return texts.select("node", "fp_high", "fp_low", "text").mapInArrow(scan, "node long, held array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough.

    A hub's set is fetched once for each share of its pairs, so that these are dealt over as many tasks.
    """
    pairs = staged(pairs, "pairs")
    n_shares = max(64, -(-pairs.count() // (64 * rules.share)))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(n_shares)).alias("salt"))
    asked = dealt.select("a", "salt").distinct().join(sets.withColumnsRenamed({"node": "a", "held": "held_a"}), "a")
    both = dealt.join(asked, ["a", "salt"]).join(sets.withColumnsRenamed({"node": "b", "held": "held_b"}), "b")
    common = F.size(F.array_intersect("held_a", "held_b"))
    union = F.size("held_a") + F.size("held_b") - F.col("common")
    both = both.select("a", "b", "held_a", "held_b", common.alias("common"))
    return both.filter(100 * F.col("common") >= rules.percent * union).select("a", "b")


def starred(rows: DataFrame, label: str) -> DataFrame:
    """Bucket rows (key, node, size) with n, hub and hub_size, staged, without those of buckets of one."""
    rows = staged(rows, label)
    hub = F.min(F.struct(F.col("node").alias("node"), F.col("size").alias("size"))).alias("hub")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), hub).filter(F.col("n") > 1)
    buckets = staged(buckets.select("key", "n", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")), "buckets")
    out = staged(counted_join(rows, buckets, ["key"], rows.count()), "members")
    dropped(rows)
    return out


def alike(a, b, percent: int, a_max=None, b_max=None):
    """Whether sets of sizes a and b, of which a_max and b_max may be in both, can be similar enough."""
    both = F.least(a if a_max is None else a_max, b if b_max is None else b_max)
    return (100 + percent) * both >= percent * (a + b)


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The values of each list; of a null none."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets, offsets[1:]))


def shared_parts(sets: DataFrame, rules: NearDuplicates) -> DataFrame:
    """node, shared (how many of its shingles other sets have too) and parts (these, by part of the hash space).

    parts is null for a set with more in a part than a short holds; the bound by parts doesn't bear on it then.
    """
    once = sets.select("node", F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = once.filter("n = 1").groupBy("node").agg(F.collect_list("shingle").alias("alone"))

    def scan(batches):
        for batch in batches:
            shared, parts = [], []
            for held, alone in zip(lists(batch.column("held")), lists(batch.column("alone")), strict=True):
                own = np.setdiff1d(held, alone, assume_unique=True).view(np.uint64)
                counts = np.bincount(((own * FINISH) >> np.uint64(32)).astype(np.int64) % rules.parts, minlength=rules.parts)
                shared.append(len(own))
                parts.append(counts if counts.max(initial=0) < 1 << 15 else None)
            yield record((("node", pa.int64()), ("shared", pa.int64()), ("parts", pa.list_(pa.int16()))), [batch.column("node"), shared, parts])

    return sets.join(alone, "node", "left").select("node", "held", "alone").mapInArrow(scan, "node long, shared long, parts array<short>")


def in_cells(rows: DataFrame, shares: Column, columns: list[str]) -> DataFrame:
    """rows by cell: key, i, j, as_x, as_y and columns, partitioned and sorted by cell; rows has key, node and minor.

    A bucket's members are dealt into shares. Its members outside the largest component (minor) of share i, as_x,
    meet all members of share j, as_y, in the cell (i, j): as rows of one task, and no pair is a row.
    """
    own, each = F.col("own"), F.sequence(F.lit(0), F.col("shares") - 1)
    rows = rows.withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    as_y = F.transform(each, lambda k: F.struct(k.alias("i"), own.alias("j"), ((k == own) & F.col("minor")).alias("as_x"), F.lit(True).alias("as_y")))
    others = F.filter(each, lambda k: (k != own) & F.col("minor"))
    as_x = F.transform(others, lambda k: F.struct(own.alias("i"), k.alias("j"), F.lit(True).alias("as_x"), F.lit(False).alias("as_y")))
    dealt = rows.withColumn("cell", F.explode(F.concat(as_y, as_x))).select("key", "cell.*", *columns)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, dict]]:
    """Key and columns of the as_x and the as_y rows of each cell of sorted batches, one cell at a time."""

    def told(parts: list[pa.RecordBatch]) -> tuple[int, dict, dict]:
        table = pa.Table.from_batches(parts).combine_chunks()
        sides = [table.filter(table.column(c)) for c in ("as_x", "as_y")]
        return table.column("key")[0].as_py(), *({c: one(t.column(c)) for c in t.column_names} for t in sides)

    def one(column: pa.ChunkedArray) -> pa.Array:
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        starts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
        for a, b in zip(starts, starts[1:]):
            here = tuple(cells[a].tolist())
            if held and here != last:
                yield told(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield told(held)


def possible(x: dict, y: dict, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each of x with the places of those of y, in another component, that can be similar enough by both bounds."""
    nodes = [d["node"].to_numpy() for d in (x, y)]
    labels, sizes, shared = ([d[k].to_numpy() for d in (x, y)] for k in ("label", "size", "shared"))
    some = [d["parts"].is_valid().to_numpy(zero_copy_only=False) for d in (x, y)]
    parts = [np.stack(list(lists(d["parts"].filter(d["parts"].is_valid())))).astype(np.int32) if k.any() else None for d, k in zip((x, y), some)]
    row = np.cumsum(some[0]) - 1
    for i in range(len(nodes[0])):
        both = np.minimum(shared[0][i], shared[1])
        near = ((100 + percent) * both >= percent * (sizes[0][i] + sizes[1])) & (labels[1] != labels[0][i])
        if some[0][i] and parts[1] is not None and near.any():
            at = np.flatnonzero(near & some[1])
            inside = np.minimum(parts[1][(np.cumsum(some[1]) - 1)[at]], parts[0][row[i]]).sum(1)
            near[at] = (100 + percent) * inside >= percent * (sizes[0][i] + sizes[1][at])
        if near.any():
            yield i, np.flatnonzero(near)


def with_partners(cells: DataFrame, rules: NearDuplicates) -> DataFrame:
    """(key, node, label, size, minor), distinct: the members of a cell that can be similar enough to another."""

    def scan(batches):
        schema = (("key", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("size", pa.int64()), ("minor", pa.bool_()))
        for key, x, y in each_cell(batches):
            left, right = [], np.zeros(len(y["node"]), bool)
            for i, near in possible(x, y, rules.percent):
                left.append(i)
                right[near] = True
            if left:
                at = (pa.array(left), pa.array(np.flatnonzero(right)))
                own = [pa.concat_arrays([x[c].take(at[0]), y[c].take(at[1])]) for c in ("node", "label", "size", "minor")]
                yield record(schema, [pa.array([key] * len(own[0]), pa.int64()), *own])

    return cells.mapInArrow(scan, "key long, node long, label long, size long, minor boolean").distinct()


def links_within(cells: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Links (a, b) between members of a cell on their full sets, as many as it takes to join the components that they join.

    For each of few, its shingles' lists of owners among every are added up, which gives all its intersections.
    """

    def scan(batches):
        for _, x, y in each_cell(batches):
            held = y["held"].flatten().to_numpy()
            sizes = np.diff(y["held"].offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(held, kind="stable")
            known, owner = held[order], owner[order]
            nodes, labels = y["node"].to_numpy(), y["label"].to_numpy()
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while (up := parent.get(v, v)) != v:
                    parent[v] = parent.get(up, up)
                    v = up
                return v

            a, b = [], []
            for node, label, own in zip(x["node"].to_pylist(), x["label"].to_pylist(), lists(x["held"]), strict=True):
                low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
                runs = high - low
                at = np.repeat(high - np.cumsum(runs), runs) + np.arange(runs.sum())
                common = np.bincount(owner[at], minlength=len(sizes))
                near = (100 * common >= rules.percent * (len(own) + sizes - common)) & (labels != label)
                for other, its in zip(nodes[near].tolist(), labels[near].tolist()):
                    one, two = root(label), root(its)
                    if one != two:
                        parent[one] = two
                        a.append(min(node, other))
                        b.append(max(node, other))
            if a:
                yield record((("a", pa.int64()), ("b", pa.int64())), [a, b])

    return cells.mapInArrow(scan, "a long, b long")


def cross_links(nodes: DataFrame, sets: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Links (a, b) across components in a bucket, enough to join the components that similar members join.

    nodes: node, size, shared, parts (see shared_parts), label (component) and bands. Of the members outside a
    bucket's largest component, those that no partner of the bucket's least size can match go; only buckets with
    others left are gone through. There they are held against all members within tasks, first by the bounds, then
    on the full sets of those that the bounds leave, of buckets with the same such members once. What is read and
    written are members and links, whatever the pairs: comparisons may grow with a bucket's square, rows do not,
    but for a copy of each member for every share rows of its bucket.
    """
    rows = nodes.select(F.explode("bands").alias("key"), "node", "size", "shared", "label")
    by = rows.groupBy("key", "label").agg(F.count("*").alias("own"), F.min("size").alias("least"))
    by = by.groupBy("key").agg(F.max(F.struct("own", "label"))["label"].alias("major"), F.sum("own").alias("n"), F.count("*").alias("components"), F.min("least").alias("least"))
    mixed = staged(by.filter("components > 1 AND n > 2").select("key", "major", "n", "least"), "mixed")
    n_rows = rows.count()
    partner = F.greatest(F.col("least").cast("double"), F.lit(rules.percent / 100) * F.col("size"))
    is_minor = (F.col("label") != F.col("major")) & alike(F.col("size"), partner, rules.percent, F.col("shared"), F.col("size"))
    flagged = staged(counted_join(rows, mixed, ["key"], n_rows).withColumn("minor", is_minor), "flagged")
    open_ = staged(flagged.filter("minor").groupBy("key").agg(F.first("n").alias("n")), "open")
    members = counted_join(flagged.drop("n", "major", "least"), open_, ["key"], n_rows).join(nodes.select("node", "parts"), "node")
    cells = in_cells(members, F.ceil(F.col("n") / rules.share).cast("int"), ["node", "label", "size", "shared", "minor", "parts"])
    left = staged(with_partners(cells, rules), "left")
    print_ = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("node", "minor").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("minor", "node", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    alike_keys = left.groupBy("key").agg(print_.alias("print"), F.sum("size").alias("load"), F.count("*").alias("n"))
    once = staged(alike_keys.groupBy("print").agg(F.min("key").alias("key"), F.first("load").alias("load"), F.first("n").alias("n")).drop("print"), "once")
    held = counted_join(left, once, ["key"], left.count()).join(sets, "node")
    by_load = F.ceil(F.greatest(F.col("load") / rules.load, F.col("n") / rules.share)).cast("int")
    out = links_within(in_cells(held, by_load, ["node", "label", "held"]), rules).distinct()
    out = staged(out, "across")
    for used in (mixed, flagged, open_, left, once):
        dropped(used)
    return out


def near_duplicates(docs: DataFrame, rules: NearDuplicates = NearDuplicates(), row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Copies (equal sets) are one node, whatever their number; one of them is compared. component_id is the least
    doc_id of the component, and rows with that doc_id are kept. A null or empty text, or one without words, has
    no shingles and no links. A null doc_id has no links, a null component_id, and is kept. Rows that share a
    doc_id are linked each by its own text. An empty table gives no rows; other columns are ignored.

    row: a column of longs, one for each row, which the result has too. Then nulls of doc_id are linked as well
    and come last, and of each component the one row with the least doc_id, then row, is kept.
    """
    spark = docs.sparkSession
    signed = staged(signatures(docs, rules, row), "signatures")
    linkable = F.col("n_shingles") > 0
    if not row:
        linkable = linkable & F.col("doc_id").isNotNull()
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    groups = signed.filter(linkable).groupBy(*KEY).agg(F.min(first).alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    groups = staged(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    plain = staged(signed.select("doc_id", "row", *KEY), "plain")
    dropped(signed)
    release(spark)
    members = starred(groups.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("size")), "banded")
    release(spark)
    wanted = groups.join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", "fp_high", "fp_low", F.col("least.doc_id").alias("least_id"), F.col("least.row").alias("least_row"))
    sets = staged(full_sets(keyed(docs, row), wanted, rules.shingle), "sets")
    release(spark)
    star = members.filter((F.col("node") != F.col("hub")) & alike(F.col("size"), F.col("hub_size"), rules.percent))
    links = staged(confirmed(star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, rules), "confirmed")
    dropped(members)
    stars = components(links)
    labels = stars.select(F.col("v").alias("node"), F.col("m").alias("label"))
    nodes = groups.select("node", F.col("n_shingles").alias("size"), "bands").join(shared_parts(sets, rules), "node")
    nodes = staged(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    release(spark)
    links = stars.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(cross_links(nodes, sets, rules))
    dropped(sets)
    dropped(nodes)
    release(spark)
    labels = components(links).select(F.col("v").alias("node"), "m")
    named = groups.join(labels, "node", "left").select("node", *KEY, "n", "least", F.coalesce("m", "node").alias("m"))
    named = staged(named, "named")
    tops = named.groupBy("m").agg(F.min("least").alias("top"), F.count("*").alias("n_nodes")).filter("n_nodes > 1")
    tops = staged(tops, "tops")
    topped = counted_join(named, tops, ["m"], named.count(), "left", n="n_nodes").select(*KEY, "n", F.coalesce("top", "least").alias("top"), F.col("top").isNotNull().alias("linked"))
    topped = staged(topped.filter((F.col("n") > 1) | F.col("linked")).drop("linked"), "topped")
    out = counted_join(plain.filter(linkable), topped, KEY, plain.count(), "left").withColumn("top", F.coalesce("top", first))
    out = out.select("doc_id", "row", "n_shingles", F.col("top.doc_id").alias("component_id"), F.col("top.row").alias("kept_row"))
    alone = plain.filter(~linkable).select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("kept_row"))
    out = out.unionByName(alone)
    if row:
        return out.select("doc_id", F.col("row").alias(row), "n_shingles", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
