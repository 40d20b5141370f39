"""Near-duplicates against all pairs, and components against union-find."""

import pytest
import random
import re

from quantloom.llm.graph import components
from quantloom.llm.minhash import NearDuplicates, near_duplicates, shared_parts, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int"
DATA = "/root/testdata/sf0.001"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sets_of(rows):
    out = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def brute(rows):
    held = sets_of(rows)
    ids = [d for d in held if held[d]]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(held[a] & held[b]) >= 75 * len(held[a] | held[b])]
    root = roots(held, links)
    return {d: (len(held[d]), root[d], root[d] == d) for d in held}


def result(spark, rows, **rules):
    docs = spark.createDataFrame([(d, t, None, "s", 1, "x", 7) for d, t in rows], SCHEMA)
    out = near_duplicates(docs, NearDuplicates(**rules)).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}, out


def corpus(seed=1, groups=6, size=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([7, 30, 120]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]) for _ in range(60)]
    rows += ["", " \t\n", None, "one", "one", "ONE two", "one two", "A b C d", "a B c D", "Été un deux", "été un deux", "x y z", "w " * 5000]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    got, out = result(spark, rows)
    assert got == brute(rows) and len(out) == len(rows)


def test_near_misses_of_one_base(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6, 8])):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got, _ = result(spark, rows, share=3)
    assert got == brute(rows) and len({c for _, c, _ in got.values()}) > 5


def test_pairs_at_the_threshold_are_no_rows(spark, monkeypatch):
    """A family whose pairs lie about the threshold: tables grow with its documents, not with their pairs."""
    from quantloom.llm import minhash

    def family(n, seed=4, words=400, edits=7):
        rng = random.Random(seed)
        base = [f"w{i}" for i in range(words)]
        rows = []
        for i in range(n):
            own = list(base)
            for at in rng.sample(range(words), edits):
                own[at] = f"x{rng.randrange(10**9)}"
            rows.append((i, " ".join(own)))
        return rows

    counts = []
    write = minhash.staged
    for n in (120, 240):
        seen = {}

        def counted(df, label):
            out = write(df, label)
            seen[label] = max(seen.get(label, 0), out.count())
            return out

        monkeypatch.setattr(minhash, "staged", counted)
        got, _ = result(spark, family(n))
        monkeypatch.setattr(minhash, "staged", write)
        assert got == brute(family(n)) and len({c for _, c, _ in got.values()}) < n
        counts.append(seen)
    assert counts[1]["across"] < 2 * 240 and counts[1]["confirmed"] < 3 * 240
    for label in ("left", "flagged"):
        assert counts[1][label] <= min(2.6 * counts[0][label], 240 * 64), counts


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == brute(rows)


def test_empty_and_null(spark):
    assert result(spark, [])[0] == {}
    got, out = result(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])
    assert got == {None: (2, None, True), 1: (2, 1, True)} and len(out) == 3


def test_shared_and_missing_ids(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, 10), (1, "quite another text of seven words", 11), (2, near + " x", 12), (None, near, 13), (None, "quite another text of seven words", 14), (3, "", 15), (2, near + " x", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    out = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True)], key=str)
    kept = {r["key"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs, row="key").collect()}
    assert kept == {10: (1, True), 11: (1, True), 12: (1, False), 13: (1, False), 14: (1, False), 15: (3, True), 16: (1, False)}


def test_bound_by_parts_is_a_bound(spark):
    rng = random.Random(12)
    sets = [(n, sorted(rng.sample(range(1 << 40), 30)) ) for n in range(4)]
    sets += [(9, sorted({*sets[0][1][:20], *sets[1][1][:9], 5}))]
    got = {r["node"]: r for r in shared_parts(spark.createDataFrame(sets, "node long, held array<long>"), NearDuplicates(parts=8)).collect()}
    held = dict(sets)
    for n, r in got.items():
        assert r["shared"] == sum(r["parts"]) == len([x for x in held[n] if any(x in held[m] for m in held if m != n)])
        for m, q in got.items():
            assert m == n or len(set(held[n]) & set(held[m])) <= sum(map(min, r["parts"], q["parts"]))


def test_short_sequences_are_one_shingle():
    assert len(shingles(b"a b", 5)) == 1 and len(shingles(b"a b c d e f", 5)) == 2 and not len(shingles(b" ", 5))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    nodes = {n for link in links for n in link}
    want = {n: r for n, r in roots(nodes, links).items() if n != r}
    got = {r["v"]: r["m"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


@pytest.mark.parametrize("links, rounds", [([(9, 1), (8, 1), (5, 2)], 0), ([], 0), ([(1, 2), (2, 3), (2, 3), (7, 7)], 1)])
def test_components_end_with_stars(spark, monkeypatch, links, rounds):
    """A round is taken only while some node has two lesser ones, or a lesser and a larger one."""
    from quantloom.llm import graph

    labels = []
    monkeypatch.setattr(graph, "staged", lambda df, label, of=graph.staged: labels.append(label) or of(df, label))
    got = {r["v"]: r["m"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == ({9: 1, 8: 1, 5: 2} if len(links) == 3 else {2: 1, 3: 1} if links else {})
    assert labels.count("large") == rounds
