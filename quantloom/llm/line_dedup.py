"""Operator 3: a template tree of lines, in DataFrame operations; templates that recur across documents are dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, dropped, fresh, read, shares_ids, staged

DEPTH_PARTS = 4
FIELD = "<*>"
SKETCH = 16


@dataclass(frozen=True)
class LineTemplates:
    """depth: leading tokens that lead to a leaf, below the token count. variable: tokens that match are a field.

    least_generalised: lines of at least so many tokens may also vary in one quarter of the tokens after the
    leading ones. least_documents: a template recurs if it is in so many documents, and least_families: of so many
    families, whatever the number of documents. A family is of documents that share their least leaf among the
    lines of their own if these hold least_own of the words, else among all others, so that copies and near copies of
    a document, which belong to near-duplicate detection, don't make its lines a template.
    long_words: a line of more words is a passage, no chance repeat; it recurs from least_alien documents on, if all
    but one of so many have less than a third of their other lines in common with a given one of its documents: that
    with the least or that with the greatest sketch (see kin).
    least_share: a token is constant at its position in a node (token count and leading tokens, fewer of these for
    short lines) if it holds in least_documents lines there and in this share of them, or in more than half. Two sets
    of constants, two templates. They need more than least_constant of the line's tokens, two at least.
    """

    depth: int = 3
    variable: str = "[0-9]"
    least_generalised: int = 11
    least_documents: int = 10
    least_families: float = 10
    least_own: float = 0.25
    long_words: int = 50
    least_alien: int = 2
    least_share: float = 0.1
    least_constant: float = 0.5


def tokens(line: Column, rules: LineTemplates) -> Column:
    """The line's tokens with variable fields as <*>; only lines that have any are gone through for fields and for blanks other than single ones."""
    masked = F.when(line.rlike(rules.variable), F.regexp_replace(line, rf"[^\s]*{rules.variable}[^\s]*", FIELD)).otherwise(line)
    single = F.when(line.rlike(r"[\t\x0B\f\r]|  "), F.regexp_replace(masked, r"\s+", " ")).otherwise(masked)
    return F.split(F.trim(single), " ")


def parsed(docs: DataFrame, rules: LineTemplates) -> DataFrame:
    """doc_id, nth, words, raw, head, leaf, node, exact, skeletons and t (hashes) for each line that has a token. doc_id must not be null.

    A leaf is the path of the tree: token count, then leading tokens. A template is the line's tokens with
    fields masked, or, for longer lines, those with one quarter of the rest left open too, or the constant ones of
    its node (see open_templates), which is a leaf but for short lines, whose leading tokens may be fields. A line
    of fields alone, such as a row of numbers, has no template.
    """
    lines = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    lines = lines.filter(F.col("line").rlike(r"\S"))
    lines = lines.select("doc_id", "nth", F.xxhash64("line").alias("raw"), F.transform(tokens(F.col("line"), rules), lambda x: F.xxhash64(x)).alias("t"))
    n, depth = F.size("t"), rules.depth
    worded = F.exists("t", lambda x: x != F.xxhash64(F.lit(FIELD)))
    leaf = F.xxhash64(n, F.slice("t", 1, depth))
    node = F.xxhash64(n, F.slice("t", F.lit(1), F.when(n <= 4, 1).when(n < rules.least_generalised, 2).otherwise(depth)))
    cut = lambda q: depth + F.floor((n - depth) * q / DEPTH_PARTS).cast("int")
    open_part = lambda q: F.xxhash64(F.lit(q), n, F.slice("t", F.lit(1), cut(q)), F.slice("t", cut(q + 1) + 1, n))
    skeletons = F.when(worded & (n >= rules.least_generalised), F.array(*(open_part(q) for q in range(DEPTH_PARTS)))).otherwise(F.array().cast("array<long>"))
    return lines.select("doc_id", "nth", n.alias("words"), "raw", F.xxhash64(F.slice("t", 1, depth)).alias("head"), leaf.alias("leaf"), node.alias("node"), F.when(worded, F.xxhash64(F.lit("exact"), "t")).alias("exact"), skeletons.alias("skeletons"), F.transform("t", short).alias("t"))


def short(token: Column) -> Column:
    """32 bits of a token's hash, for counts by position."""
    return F.shiftright(token, 32).cast("int")


def open_templates(lines: DataFrame, n_lines: int, rules: LineTemplates) -> tuple[DataFrame, DataFrame]:
    """Rows of lines whose node has enough lines to recur, with open: the templates of the constant tokens; the staged table behind them.

    Tokens are counted by node and position, pre-aggregated; what is constant goes back to lines by counted_join.
    """
    nodes = staged(lines.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_documents), "nodes")
    held = staged(counted_join(lines, nodes, ["node"], n_lines), "held")
    counts = held.select("node", "n", F.posexplode("t").alias("at", "token")).groupBy("node", "n", "at", "token").agg(F.count("*").alias("c"))
    c, fixed = F.col("c"), F.col("token") != short(F.xxhash64(F.lit(FIELD)))
    common = fixed & (c >= rules.least_documents) & (c >= rules.least_share * F.col("n"))
    kept = lambda of, name: F.collect_list(F.when(of, F.col("token"))).alias(name)
    places = counts.groupBy("node", "n", "at").agg(kept(common, "common"), kept(fixed & (2 * c > F.col("n")), "most"))
    shapes = places.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("at", "common", "most"))).alias("shape"))
    shapes = staged(shapes.select("node", "n", F.col("shape.common").alias("common"), F.col("shape.most").alias("most")), "shapes")
    shaped = counted_join(held.drop("n"), shapes, ["node"], held.count())

    def template(constants: str) -> Column:
        left = F.transform("t", lambda x, i: F.when(F.array_contains(F.get(constants, i), x), x))
        n_left = F.size(F.filter(left, lambda x: x.isNotNull()))
        enough = (n_left >= 2) & (n_left > rules.least_constant * F.col("words"))
        return F.when(enough, F.xxhash64("node", F.lit("open"), F.transform(left, lambda x: F.coalesce(x, F.lit(0)))))

    return shaped.withColumn("open", F.array_compact(F.array_distinct(F.array(template("common"), template("most"))))).drop("t", "common", "most", "n"), held


def kin(lines: DataFrame, leaves: DataFrame, n_lines: int, rules: LineTemplates) -> DataFrame:
    """doc_id, own and shared (the two least leaves of each kind), mostly_own and sketch for each document.

    Own lines are in leaves of too few lines to recur. The sketch has the least heads (leading tokens) of the lines.
    """
    marked = counted_join(lines.select("doc_id", "head", "leaf", "words"), leaves, ["leaf"], n_lines, "left")
    least = lambda of: F.slice(F.array_sort(F.collect_set(F.when(of, F.col("leaf")))), 1, 2)
    own = F.col("n").isNull()
    out = marked.groupBy("doc_id").agg(least(own).alias("own"), least(~own).alias("shared"), F.sum(F.when(own, F.col("words")).otherwise(0)).alias("own_words"), F.sum("words").alias("words"), F.slice(F.array_sort(F.collect_set("head")), 1, SKETCH).alias("sketch"))
    return out.select("doc_id", "own", "shared", "sketch", (F.col("own_words") >= rules.least_own * F.col("words")).alias("mostly_own"))


def family() -> Column:
    """The family of a document for a template in leaf, from the columns of kin."""
    other = lambda c: F.filter(c, lambda x: x != F.col("leaf"))
    ranked = F.when(F.col("mostly_own"), F.concat(other("own"), other("shared"))).otherwise(F.concat(other("shared"), other("own")))
    return F.coalesce(F.get(ranked, F.lit(0)), "raw")


def passages(lines: DataFrame, docs: DataFrame, rules: LineTemplates) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, nth, template), staged, and templates (template, n rows) of the long lines that recur.

    All of a template's documents are held against its two ends, the least and the greatest sketch.
    """
    long = lines.filter((F.col("words") > rules.long_words) & F.col("exact").isNotNull()).select("doc_id", "nth", "raw", "head", "leaf", F.col("exact").alias("template"))
    often = staged(long.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_alien), "often")
    rows = staged(counted_join(long, often, ["template"], long.count()), "passages")
    own = rows.groupBy("doc_id", "template").agg(F.min("head").alias("head")).join(docs, "doc_id")
    own = staged(own.select("template", F.filter("sketch", lambda x: x != F.col("head")).alias("sketch")), "sketches")
    ends = own.groupBy("template").agg(F.min("sketch").alias("lo"), F.max("sketch").alias("hi"), F.count("*").alias("n"))
    ends = staged(ends.filter(F.col("n") >= rules.least_alien), "ends")
    held = counted_join(own, ends, ["template"], own.count())
    alien = lambda c: F.sum((3 * F.size(F.array_intersect("sketch", c)) < F.greatest(F.size("sketch"), F.size(c))).cast("int"))
    found = held.groupBy("template").agg(F.greatest(alien("lo"), alien("hi")).alias("aliens"))
    return rows.select("doc_id", "nth", "template"), found.filter(F.col("aliens") >= rules.least_alien - 1).join(often, "template").select("template", "n")


def recurring(lines: DataFrame, rules: LineTemplates) -> tuple[DataFrame, DataFrame]:
    """Candidate rows (doc_id, nth, template), staged, and templates (template, n rows) that recur; long lines may be in both twice."""
    n_lines = lines.count()
    leaves = staged(lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_documents), "leaves")
    own, held = open_templates(lines, n_lines, rules)
    own = own.select("doc_id", "nth", "raw", "leaf", F.explode(F.concat(F.array_compact(F.array("exact")), "skeletons", "open")).alias("template"))
    own = staged(own, "templates")
    dropped(held)
    often = staged(own.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_documents), "often")
    rows = staged(counted_join(own, often, ["template"], own.count()), "rows")
    dropped(own)
    docs = rows.groupBy("doc_id", "template").agg(F.min("leaf").alias("leaf"), F.min("raw").alias("raw"))
    known = staged(kin(lines, leaves, n_lines, rules), "kin")
    families = docs.join(known, "doc_id").groupBy("template", family().alias("family")).agg(F.count("*").alias("documents"))
    found = families.groupBy("template").agg(F.sum("documents").alias("documents"), F.count("*").alias("families"))
    found = found.filter((F.col("documents") >= rules.least_documents) & (F.col("families") >= rules.least_families))
    more, long = passages(lines, known, rules)
    found = found.join(often, "template").select("template", "n").unionByName(long).groupBy("template").agg(F.sum("n").alias("n"))
    return rows.select("doc_id", "nth", "template").unionByName(more), found


def without(lines: Column, drops: Column) -> Column:
    """The lines but for those at drops (ascending, from 0), joined: the runs between the drops, each a slice."""

    def kept(x: Column) -> Column:
        before = lambda i: F.when(i == 0, -1).otherwise(F.get(x["drops"], i - 1))
        after = lambda i: F.when(i == F.size(x["drops"]), F.size(x["lines"])).otherwise(F.get(x["drops"], i))
        runs = F.transform(F.sequence(F.lit(0), F.size(x["drops"])), lambda i: F.slice(x["lines"], before(i) + 2, after(i) - before(i) - 1))
        return F.array_join(F.flatten(runs), "\n")

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), drops.alias("drops"))), kept), F.lit(0))


def line_dedup(docs: DataFrame, rules: LineTemplates = LineTemplates()) -> DataFrame:
    """All columns of docs, with the lines of recurring templates dropped from text, and n_lines and n_dropped.

    Native operations only. Lines travel as hashes; templates go back to lines by counted_join, so a template in
    a third of all documents meets in no task. Lines without a token stay. Null text stays null, with no lines;
    rows with a null doc_id stay as they are. Rows that share a doc_id are documents of their own. Columns named
    n_lines or n_dropped are replaced. Empty table: no rows.
    """
    key = fresh(docs.columns, "_key")
    if shares_ids(docs):
        docs = staged(docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "keyed")
    else:
        docs = docs.withColumn(key, F.col("doc_id").cast("long"))
    lines = staged(parsed(docs.select(F.col(key).alias("doc_id"), "text"), rules), "lines")
    rows, found = recurring(lines, rules)
    found = staged(found, "found")
    drops = counted_join(rows, found, ["template"], rows.count())
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", key)]
    doc, nth = fresh(docs.columns, "_doc"), fresh(docs.columns, "_nth")
    drops = drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("nth").alias(nth))
    joined = docs.select(*names, key).join(drops, F.col(key) == F.col(doc), "left")
    split = F.split("text", "\n")
    text = F.when(F.col(nth).isNull(), F.col("text")).otherwise(without(split, F.array_sort(nth)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    n_dropped = F.when(F.col(nth).isNull(), 0).otherwise(F.size(nth)).cast("long")
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in names), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"))
