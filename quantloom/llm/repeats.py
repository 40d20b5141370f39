"""Operator 4: exact substring removal by sparse enhanced suffix arrays and their common-prefix interval trees.

Each window of span bytes is owned by its anchor, the least-hashed gram in it, so equal windows have equal
anchors at equal places. Suffixes are sampled at anchors: those that begin with one gram are a bucket, which is
sorted by what follows into a suffix array with common-prefix lengths. A scan with a stack gives its intervals;
in each, members are told apart by what stands before (left-extension diversity) by the same scan of the
reversed left contexts, so a pair of intervals is a repeat with all its occurrences.

Runs of windows with equal bytes (regions) are one suffix of the array, with their number. A bucket of too many
suffixes for one task is parted by the bytes that the windows of either half of the possible places must share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, dropped, read, record, release, shares_ids, staged, utf8

SCHEMA = (("doc", pa.int64()), ("anchor", pa.int64()), ("region", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("starts", pa.int32()))
DDL = "doc long, anchor long, region long, at long, before int, starts int"
LOW = np.uint64(0xFFFFFF)
ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & 0xFFFFFFFFFFFFFFFF | 1) for i in range(12)]
BYTES = np.random.default_rng(4).integers(0, 1 << 64, 256, np.uint64)


@dataclass(frozen=True)
class Repeats:
    """span: bytes of a repeat at least. gram: bytes of an anchor, a power of two. bucket: suffixes of one array at
    most; larger buckets are parted (see parted), each part an array of its own. piece: bytes of a text worked on
    at once.
    """

    span: int = 100
    gram: int = 32
    bucket: int = 1000
    piece: int = 4_000_000

    @property
    def slack(self) -> int:
        return self.span - self.gram


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[10]
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    h, size, level = BYTES[codes], 1, 0
    while size < gram:
        h = h[:-size] * ODD[level] + h[size:]
        size, level = 2 * size, level + 1
    return mixed(h)


def least_in(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def anchors(text: bytes, rules: Repeats) -> tuple[np.ndarray, ...]:
    """anchor, region, at, before, starts of each run of windows with one anchor.

    at: the anchor's place; its windows start from at - before on, in as many places as starts. region: a hash of
    all their bytes and of before, so runs with one region have the same windows.
    """
    found = []
    for base in range(0, max(len(text) - rules.span + 1, 0), rules.piece):
        part = text[base : base + rules.piece + rules.span - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8), rules.gram)
        place = np.arange(len(h), dtype=np.uint64)
        own = (least_in((h & ~LOW) | place, rules.slack + 1) & LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        last = np.r_[first[1:], len(own)] - 1
        at, end = own[first], last + rules.span - rules.gram
        region = ((at - first).astype(np.uint64) * ODD[7] + (last - first).astype(np.uint64)) * ODD[8]
        for i in range(0, 2 * rules.slack, rules.gram):
            region = mixed(region + h[np.minimum(first + i, end)] * ODD[9])
        region = mixed(region + h[end])
        found.append((h[at].view(np.int64), region.view(np.int64), at + base, at - first, last - first + 1))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else ()


def anchor_rows(docs: DataFrame, rules: Repeats) -> DataFrame:
    def scan(batches):
        for batch in batches:
            docs_, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch), strict=True):
                if len(text) >= rules.span:
                    rows.append(anchors(text, rules))
                    docs_.append(np.full(len(rows[-1][0]), doc, np.int64))
            if rows:
                yield record(SCHEMA, [np.concatenate(docs_), *(np.concatenate(x) for x in zip(*rows))])

    return docs.select("doc", "text").mapInArrow(scan, DDL)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    bits = (int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length()
    return n - (bits + 7) // 8


def intervals(lcps: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Length, parent's length (-1 at the root), first and last of each common-prefix interval of a sorted list.

    lcps: common-prefix lengths of neighbours.
    """
    stack: list[tuple[int, int]] = []
    for i, now in enumerate([*lcps, -1]):
        left = i
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, max(now, stack[-1][0] if stack else -1), left, i
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def bucket_repeats(rows: list[tuple], rules: Repeats, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, list[tuple]]]:
    """Repeats among the suffixes of one bucket: bytes from the anchor back to the first and the last window's
    start, within lo and hi, and the members (doc, at, row's number), the first one first.

    rows: right context, reversed left context, doc, at, number of copies and more, sorted by right context;
    contexts end where the anchor's own windows end. Of several copies two stand in the array.
    """
    slack = rules.slack
    hi = slack if hi is None else hi
    array = [i for i, r in enumerate(rows) for _ in range(2 if r[4] > 1 else 1)]
    rights = [common(rows[a][0], rows[b][0]) for a, b in zip(array, array[1:])]
    for right, outer, start, stop in intervals(rights):
        least, most = max(slack - right, lo), min(slack - outer - 1, hi)
        if least > most:
            continue
        members = sorted((rows[i][1], rows[i][2], rows[i][3], i) for i in array[start : stop + 1] if len(rows[i][1]) >= least)
        lefts = [common(a[0], b[0]) for a, b in zip(members, members[1:])]
        if not lefts or max(lefts) < least:
            continue
        for left, shorter, first, last in intervals(lefts):
            near, far = max(least, shorter + 1), min(most, left)
            if near <= far:
                yield near, far, sorted({m[1:] for m in members[first : last + 1]})


FOUND = "anchor long, region long, group long, doc long, at long, near int, far int, lead boolean"


def in_buckets(rows: DataFrame, rules: Repeats, leads: bool) -> DataFrame:
    """Members (see FOUND) of the repeats of buckets; rows: as with_contexts, with part, lo and hi.

    group: hash of the repeat's bytes about the anchor. lead: its first member; without leads only the others.
    """
    schema = (("anchor", pa.int64()), ("region", pa.int64()), ("group", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("lead", pa.bool_()))
    columns = ("anchor", "part", "lo", "hi", "rights", "lefts", "doc", "at", "n", "region")

    def scan(batches):
        held: list = []
        now: tuple | None = None
        out: list = []

        def finish() -> None:
            for near, far, found in bucket_repeats(held, rules, *now[2:]) if held else ():
                right, left = held[found[0][2]][:2]
                group = xxhash.xxh3_64_intdigest(left[:far] + b"|" + right[: rules.slack - near], now[0] & 0xFFFF) - (1 << 63)
                for doc, at, i in found if leads else found[1:]:
                    out.append((now[0], held[i][5], group, doc, at, near, far, i == found[0][2]))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
                if row[:4] != now:
                    finish()
                    held, now = [], row[:4]
                held.append(row[4:])
            if out:
                yield record(schema, list(zip(*out)))
                out = []
        finish()
        if out:
            yield record(schema, list(zip(*out)))

    by = rows.select(*columns)
    by = by.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor", "part").sortWithinPartitions("anchor", "part", "lo", "hi", "rights", "doc", "at")
    return by.mapInArrow(scan, FOUND)


def with_contexts(texts: DataFrame, places: DataFrame, rules: Repeats) -> DataFrame:
    """places with the bytes after (rights) and, reversed, before (lefts) their anchors, as far as the windows reach."""
    schema = (("anchor", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("n_bucket", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("rights", pa.binary()), ("lefts", pa.binary()))
    listed = places.groupBy("doc").agg(F.collect_list(F.struct("anchor", "region", "n", "n_bucket", "at", "before", "starts")).alias("places"))

    def scan(batches):
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column("doc").to_pylist(), utf8(batch), batch.column("places").to_pylist(), strict=True):
                for p in own:
                    at, after = p["at"], p["at"] + rules.gram
                    end = at - p["before"] + p["starts"] - 1 + rules.span
                    rows.append((p["anchor"], p["region"], p["n"], p["n_bucket"], doc, at, text[after:end], text[at - p["before"] : at][::-1]))
            yield record(schema, list(zip(*rows)) if rows else [[]] * 8)

    return texts.join(listed, "doc").mapInArrow(scan, "anchor long, region long, n long, n_bucket long, doc long, at long, rights binary, lefts binary")


def parted(rows: DataFrame, rules: Repeats) -> tuple[DataFrame, DataFrame]:
    """Rows in buckets, or parts of buckets, of bounded size, and those of single windows in more rows than that.

    A window starts lo to hi bytes before its anchor, and holds slack bytes about it. Suffixes that share one from
    lo to mid share the slack - mid bytes after the anchor, those that share one from mid + 1 to hi the mid + 1
    bytes before it: two parts, by these bytes, and at most two rows a suffix. Parts that are still too large are
    parted again, down to single windows, whose rows are equal and need no array.
    """
    large = staged(rows.filter(F.col("n_bucket") > rules.bucket), "large")
    small = rows.filter(F.col("n_bucket") <= rules.bucket).drop("n_bucket")
    done = [small.select("*", F.lit(0).cast("long").alias("part"), F.lit(0).alias("lo"), F.lit(rules.slack).alias("hi"))]
    large = large.drop("n_bucket").select("*", F.lit(0).alias("lo"), F.lit(rules.slack).alias("hi"))
    windows = large.select("*", F.lit(0).cast("long").alias("part")).filter("false")
    while n_large := large.count():
        halves = []
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        for lo, hi in ((F.col("lo"), mid), (mid + 1, F.col("hi"))):
            part = F.xxhash64(lo, hi, F.substring("lefts", 1, lo), F.substring("rights", 1, F.lit(rules.slack) - hi))
            reach = (F.length("lefts") >= lo) & (F.length("rights") >= F.lit(rules.slack) - hi)
            halves.append(large.filter(reach).select(*(c for c in large.columns if c not in ("lo", "hi", "part")), part.alias("part"), lo.alias("lo"), hi.alias("hi")))
        each = staged(halves[0].unionByName(halves[1]), "halves")
        sizes = staged(each.groupBy("anchor", "part").agg(F.count("*").alias("n_part"), F.max("n").alias("most")).filter("n_part > 1 OR most > 1").drop("most"), "sizes")
        each = staged(counted_join(each, sizes, ["anchor", "part"], 2 * n_large, n="n_part"), "parts")
        over = F.col("n_part") > rules.bucket
        done.append(each.filter(~over).drop("n_part"))
        windows = windows.unionByName(each.filter(over & (F.col("lo") == F.col("hi"))).drop("n_part"))
        large = each.filter(over & (F.col("lo") < F.col("hi"))).drop("n_part")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, windows


def single_windows(rows: DataFrame, rules: Repeats, leads: bool) -> DataFrame:
    """Members (see FOUND) of the repeats whose one window is in too many different rows for one array."""
    window = F.xxhash64(F.substring("lefts", 1, F.col("lo")), F.substring("rights", 1, F.lit(rules.slack) - F.col("lo")))
    rows = rows.withColumn("group", window)
    firsts = rows.groupBy("anchor", "part", "group").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n_window"))
    out = counted_join(rows, staged(firsts, "firsts"), ["anchor", "part", "group"], rows.count(), n="n_window")
    out = out.withColumn("lead", F.struct("doc", "at") == F.col("first"))
    return (out if leads else out.filter(~F.col("lead"))).select("anchor", "region", "group", "doc", "at", F.col("lo").alias("near"), F.col("hi").alias("far"), "lead")


def suffixes(texts: DataFrame, rules: Repeats) -> tuple[DataFrame, DataFrame]:
    """shared: the runs of windows (see SCHEMA) at anchors that occur twice or more; regions: one row for each
    different run (anchor, region) with its number n, its first place least and n_bucket, the anchor's regions.

    A run is told by two 64-bit hashes, of the anchor's gram and of all its bytes and its place about the anchor.
    """
    spark = texts.sparkSession
    rows = staged(anchor_rows(texts, rules), "anchors")
    often = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    often = staged(often, "often")
    release(spark)
    shared = staged(counted_join(rows, often, ["anchor"], rows.count()).drop("n"), "shared")
    dropped(rows)
    release(spark)
    regions = shared.groupBy("anchor", "region").agg(F.min(F.struct("doc", "at", "before", "starts")).alias("least"), F.count("*").alias("n"))
    regions = staged(regions, "regions")
    buckets = staged(regions.groupBy("anchor").agg(F.count("*").alias("n_bucket")).filter("n_bucket > 1"), "buckets")
    inner = staged(counted_join(regions, buckets, ["anchor"], regions.count(), n="n_bucket"), "inner")
    release(spark)
    return shared, regions, inner


def members(texts: DataFrame, inner: DataFrame, rules: Repeats, leads: bool) -> DataFrame:
    """The tree's output (see FOUND) for the buckets of several regions."""
    places = inner.select("anchor", "region", "n", "n_bucket", "least.*")
    contexts = staged(with_contexts(texts, places, rules), "contexts")
    release(texts.sparkSession)
    arrays, windows = parted(contexts, rules)
    return in_buckets(arrays, rules, leads).unionByName(single_windows(windows, rules, leads))


def repeats(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """Maximal repeats about each anchor with all their occurrences: anchor, group (these two name a repeat), doc,
    start, end and first, in bytes of the UTF-8 texts. docs: doc (a long, no nulls, no repeats) and text.

    A repeat longer than the windows of one anchor is a chain of such groups, one for each anchor in it.
    """
    shared, regions, inner = suffixes(docs, rules)
    found = members(docs, inner, rules, True).drop("doc", "at")
    lone = regions.join(inner.select("anchor").distinct(), "anchor", "left_anti").filter("n > 1")
    whole = lone.select("anchor", "region", F.col("region").alias("group"), (F.col("least.before") - F.col("least.starts") + 1).alias("near"), F.col("least.before").alias("far"), F.lit(True).alias("lead"))
    found = staged(found.unionByName(whole), "found")
    n_of = regions.select("anchor", "region", "n", F.struct("least.doc", "least.at").alias("least"))
    listed = found.groupBy("anchor", "region").agg(F.collect_list(F.struct("group", "near", "far", "lead")).alias("groups")).join(n_of, ["anchor", "region"])
    each = counted_join(shared.select("anchor", "region", "doc", "at"), staged(listed, "listed"), ["anchor", "region"], shared.count())
    each = each.select("anchor", "doc", "at", (F.struct("doc", "at") == F.col("least")).alias("least"), F.explode("groups").alias("g"))
    each = each.select("anchor", "doc", "at", "g.*", (F.col("least") & F.col("g.lead")).alias("first"))
    return each.select("anchor", "group", "doc", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + rules.span).alias("end"), "first")


def later(texts: DataFrame, rules: Repeats) -> DataFrame:
    """Runs (doc, start, end) of bytes in strings of span bytes that also start earlier; texts: doc and text.

    Copies of a region are later than its first place as a whole; of the first places, the tree tells what is
    later than other regions' windows.
    """
    shared, regions, inner = suffixes(texts, rules)
    copies = counted_join(shared, regions.filter("n > 1"), ["anchor", "region"], shared.count())
    copies = copies.filter(F.struct("doc", "at") != F.struct("least.doc", "least.at"))
    start = F.col("at") - F.col("before")
    whole = copies.select("doc", start.alias("start"), (start + F.col("starts") - 1 + rules.span).alias("end"))
    found = members(texts, inner, rules, False)
    parts = found.select("doc", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + rules.span).alias("end"))
    return staged(whole.unionByName(parts).distinct(), "gone")


def cut(texts: DataFrame, key: str) -> DataFrame:
    """key, n_bytes, spans and kept of texts with found, the runs that go."""
    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = ((key, pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(run)), ("kept", pa.binary()))

    def scan(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(utf8(batch), batch.column("found").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in found or ():
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["end"])
                    else:
                        runs.append([s["start"], s["end"]])
                edges = [0, *(x for r in runs for x in r), len(text)]
                sizes.append(len(text))
                spans.append([{"start": s, "end": e} for s, e in runs])
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield record(schema, [batch.column(key), sizes, spans, kept])

    return texts.select(key, "text", "found").mapInArrow(scan, f"{key} long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the bytes that stay) for each row of docs.

    A byte goes if a string of span bytes over it also starts earlier: in a smaller doc_id, or before in the same
    document. Null text is empty; texts shorter than span keep all. Rows with a null doc_id are no one's copies
    and keep all. Rows that share a doc_id and text count as one document; of different texts that share a
    doc_id, the least in byte order comes first. Empty table: no rows.
    """
    spark = docs.sparkSession
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named, none = bare.filter(F.col("doc_id").isNotNull()), F.lit(None).cast("array<struct<start: long, end: long>>")
    unnamed = cut(bare.filter(F.col("doc_id").isNull()).withColumn("found", none), "doc_id")
    if shares_ids(named):  # numbers in the order of doc_id and text instead of ids
        texts = staged(named.distinct().orderBy("doc_id", "text").withColumn("doc", F.monotonically_increasing_id()), "texts")
    else:
        texts = named.select(F.col("doc_id").alias("doc"), "text")
    listed = later(texts, rules).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    release(spark)
    if "doc_id" in texts.columns:
        runs = texts.join(listed, "doc").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "found")
        named = named.withColumn("digest", F.sha2("text", 256))
        held = named.join(runs.withColumnRenamed("digest", "own"), (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("own")), "left")
    else:
        held = named.join(listed, F.col("doc_id") == F.col("doc"), "left")
    return cut(held, "doc_id").unionByName(unnamed)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
