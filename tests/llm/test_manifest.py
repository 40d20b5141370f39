"""The Merkle manifest against a tree that is built in plain Python."""

import random
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from quantloom.llm.manifest import field, folded, hashed, lowered, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int, root string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, lower=False):
    doc, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return digest(*map(part, (doc, source, lang, n, text)))


def tree(leaves):
    """The top and each leaf's siblings, as (left, right) by level."""
    paths = [[] for _ in leaves]
    level, at = list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            paths[k].append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    held = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in langs}
    trees = {g: tree([leaf_of(r) for r in held[g]]) for g in langs}
    root, over = tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for row, path in zip(held[g], trees[g][1]):
            path = path + over[k]
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 3 == 0
            h = leaf_of(row, tampered)
            for a, b in path:
                h = digest(a, h, b)
            out.append((row[0], leaf_of(row), trees[g][0], root, digest(*(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def result(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    altered = hashed(*(field(lowered(F.col(c)) if c == "text" else F.col(c)) for c in COLUMNS))
    probe = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, altered)
    out = manifest(docs, COLUMNS, probe=probe, **more).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out), key=str), out


def rows_of(sizes, seed=5, ids=None):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for k in range(n):
            doc = ids(rng) if ids else len(rows)
            rows.append((doc, rng.choice([f"Text {k} É", f"text {k}", None, "", "SAME"]), lang, rng.choice(["s", None]), rng.choice([None, k])))
    rng.shuffle(rows)
    return rows


def test_sizes_of_groups(spark):
    rows = rows_of({"en": 64, "de": 65, None: 9, "": 8, "zz": 1, "éa": 7, "z": 2, "a": 600, "b": 3, "c": 1})
    assert result(spark, rows)[0] == brute(rows)


def test_more_leaves_than_a_block(spark):
    rows = rows_of({"en": 9000, "de": 4097, "fr": 4096})
    assert result(spark, rows)[0] == brute(rows)


def test_any_ids(spark):
    rows = rows_of({"en": 300, None: 200}, ids=lambda rng: rng.choice([None, 0, -1, 2**63 - 1, -(2**63), rng.randrange(-5000, 5000), rng.randrange(-(2**62), 2**62)]))
    assert result(spark, rows)[0] == brute(rows)


def test_repeated_ids_and_rows(spark):
    """Buckets of more than a few rows are parted by id, by leaf, and equal leaves by row."""
    rows = rows_of({"en": 200, "de": 40}, ids=lambda rng: rng.choice([7, 7, 7, 8, 4095, 4096, None]))
    rows += [(7, "same", "en", "s", 1)] * 60 + [(None, None, None, None, None)] * 30
    got, out = result(spark, rows, most=4)
    assert got == brute(rows)
    ranks = {}
    for r in out:
        ranks.setdefault(r["subroot"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_many_groups(spark):
    rows = [(k, "t", f"lang{k % 700}", None, k) for k in range(1400)]
    assert result(spark, rows)[0] == brute(rows)


def test_proofs_lead_to_the_root(spark):
    out = result(spark, rows_of({"en": 100, "de": 10}), proofs=True)[1]
    assert all(folded(r["leaf"], r["left"], r["right"]) == r["root"] for r in out)
    assert all(digest(*(a + b for a, b in zip(r["left"], r["right"]))) == r["proof_sha256"] for r in out)


def test_edge_cases(spark):
    assert result(spark, [])[0] == []
    for rows in ([(1, "One", "en", "s", 3)], [(1, None, None, None, None)], [(1, "x" * 2_000_000 + "É", "en", "s", 3), (3, "B", "en", "s", 3)]):
        assert result(spark, rows)[0] == brute(rows)
