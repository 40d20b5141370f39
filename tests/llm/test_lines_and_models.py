"""Line templates against plain Python; classifiers on held-out rows; the pipeline on its own stages."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm.cotraining import LEVELS, CoTraining, Corpus, Pool, View, co_train, cuts, drawn, level, packed, quality_classifier, rates_of, unpacked
from quantloom.llm.line_dedup import LineTemplates, line_dedup
from quantloom.llm.linear import Rows, fit_mix, fit_platt, once, sigmoid
from quantloom.llm.toxicity import ToxicityModel, labelled, toxicity

DATA = "/root/testdata/sf0.001"


def keys_of(line, rules):
    tokens = [re.sub(r"\S*[0-9]\S*", "<*>", t, flags=re.A) for t in re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r"))]
    if tokens == [""]:
        return None
    n, depth = len(tokens), rules.depth
    out = [("exact", *tokens)]
    if n >= rules.least_generalised:
        cut = lambda q: depth + (n - depth) * q // 4
        out += [(n, *tokens[:depth], q, *tokens[: cut(q)], "|", *tokens[cut(q + 1) :]) for q in range(4)]
    return (n, *tokens[:depth]), out


def kept_texts(docs, rules):
    leaves, seen = defaultdict(int), []
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n") if text is not None and doc is not None else ()):
            if (k := keys_of(line, rules)) is not None:
                leaves[k[0]] += 1
                seen.append((doc, i, *k))
    rows = [(d, i, k, e[0]) for d, i, leaf, e in seen if leaves[leaf] >= rules.least_documents for k in e]
    n_rows, where = defaultdict(int), defaultdict(set)
    for d, _, k, _ in rows:
        n_rows[k] += 1
        where[k].add(d)
    found = {k for k in where if n_rows[k] >= rules.least_documents and len(where[k]) >= rules.least_documents}
    gone = {(d, i) for d, i, k, _ in rows if k in found}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_templates(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.choice(["", "", "x", 7]))
    fixed = ["Page 12 of 99", "Terms apply here", "a b c d e f g h i j k l m n o p"]
    docs = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(5))]
        lines += [rng.choice(["Page 3 of 7", "Page 44 of x9 ", *fixed, "a b c d e f CHANGED here i j k l m n o p", "", "   "]) for _ in range(3)]
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "one " * 30000)]
    rules = LineTemplates(least_documents=5, least_families=0.0)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, _nth int, n_dropped string")
    out = line_dedup(frame, rules).collect()
    assert {r["doc_id"]: r["text"] for r in out} == kept_texts(docs, rules)
    assert out[0].__fields__ == ["doc_id", "text", "_nth", "n_lines", "n_dropped"] and sum(r["n_dropped"] for r in out) > 50
    assert line_dedup(frame.filter("false")).collect() == []


def test_prose_and_tables_keep_their_lines(spark):
    """Rows of numbers have no words in common, and half a line is no template; a line with one field still is."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(14):
        own = [" ".join(word() for _ in range(9)) for _ in range(6)]
        lines = [f"{rng.randrange(99)} {rng.randrange(999)} {rng.randrange(9)}", "12 480 7", f"he said {word()} {word()}", " ".join(str(rng.randrange(9)) for _ in range(60)), f"Filed under {word()}", f"Page {i} of 20"]
        rows.append((i, "\n".join(own + lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_dedup(docs).collect():
        left = r["text"].split("\n")
        assert r["n_dropped"] == 2 and len(left) == 10
        assert not any(x.startswith(("Filed", "Page")) for x in left)


def test_copies_of_a_document_keep_their_lines(spark):
    copy = "\n".join(f"line {w} of this one document" for w in "abcdefgh")
    docs = [(i, copy) for i in range(40)] + [(100 + i, f"own text {chr(97 + i)}{chr(98 + i)}\nAll rights reserved here") for i in range(20)] + [(None, "All rights reserved here")]
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == copy for i in range(40)) and all("rights" not in out[100 + i] for i in range(20)) and "rights" in out[None]


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_families_are_counted_whatever_the_copies(spark):
    rng = random.Random(4)
    page = "\n".join(words(rng, 12) for _ in range(6))
    docs = [(i, page + "\nAll rights reserved here") for i in range(300)]
    docs += [(1000 + i, words(rng, 12) + "\n" + words(rng, 9) + "\nAll rights reserved here") for i in range(40)]
    footer = "\n".join(f"footer {w} of every page" for w in "abcde")
    docs += [(2000 + i, words(rng, 12) + "\n" + footer) for i in range(40)]
    docs += [(3000 + i, f"Seen {i} times today") for i in range(20)]
    near = [words(rng, 12) for _ in range(10)]
    for i in range(300):
        docs.append((4000 + i, "\n".join(words(rng, 12) if k == i % 10 else x for k, x in enumerate(near))))
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == page for i in range(300)) and not any("rights" in out[1000 + i] for i in range(40))
    assert not any("footer" in out[2000 + i] for i in range(40)) and all(len(out[2000 + i]) > 20 for i in range(40))
    assert not any(out[3000 + i] for i in range(20))
    assert all(out[i] == t for i, t in docs if i >= 4000)


def test_rows_that_share_an_id(spark):
    rng = random.Random(2)
    own = [words(rng, 9) for _ in range(40)]
    docs = [(7, own[i] + "\nAll rights reserved" if i % 2 else "All rights reserved\n" + own[i], "x") for i in range(40)]
    out = [r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string, _key string")).collect()]
    assert sorted(out) == sorted(own)


def test_header_and_footer_whatever_their_wording(spark):
    rng = random.Random(11)
    docs, pages = [], []
    for turn in range(6):
        header, footer = words(rng, 5), words(rng, 7)
        pages += [(100 * turn + i, words(rng, 9), header, footer) for i in range(40)]
    docs = [(i, f"{header}\n{own}\n{footer}") for i, own, header, footer in pages] + [(9000, "\n\n".join(f"{pages[0][2]}\nown {c}" for c in "abcde"))]
    out = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i]["text"] == own and out[i]["n_dropped"] == 2 for i, own, *_ in pages)
    assert out[9000]["text"] == "\n\n".join(f"own {c}" for c in "abcde")


def test_long_passages_of_few_documents(spark):
    rng = random.Random(5)
    passage, short = words(rng, 60), words(rng, 12)
    docs = [(i, "\n".join([words(rng, 12), passage, short, words(rng, 12), words(rng, 9)])) for i in range(2)]
    near = [words(rng, 60) for _ in range(8)]
    docs += [(100 + i, "\n".join(words(rng, 60) if k == i else x for k, x in enumerate(near))) for i in range(6)]
    docs += [(200 + i, words(rng, 1) + "\n" + near[7] + "\n" + words(rng, 3)) for i in range(1)]
    docs += [(300 + i, near[0] * 2) for i in range(5)]
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(passage not in out[i] and short in out[i] and len(out[i].split("\n")) == 4 for i in range(2))
    assert all(out[i] == t.replace("\n" + near[7], "") for i, t in docs if i >= 100)


def test_one_stranger_among_many_near_copies(spark):
    """Whichever place its sketch has, the one document that isn't a near copy makes the passage recur."""
    rng = random.Random(17)
    docs = []
    for family in range(12):
        passage, near = words(rng, 60), [words(rng, 12) for _ in range(10)]
        copies = ["\n".join([passage] + [words(rng, 12) if k == i % 10 else x for k, x in enumerate(near)]) for i in range(70)]
        docs += [(1000 * family + i, text) for i, text in enumerate(copies)]
        if family % 2:
            docs.append((1000 * family + 500, "\n".join([words(rng, 12) for _ in range(5)] + [passage])))
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == i // 1000 % 2 for i, _ in docs)


def test_fields_of_words(spark):
    rng = random.Random(6)
    names, places = [words(rng, 1) for _ in range(5)], [words(rng, 1) for _ in range(5)]
    docs = []
    for i in range(50):
        name, place = names[i % 5], places[i // 5 % 5]
        field = [f"Posted by {name} in {place}", f"Filed under {words(rng, 1)}", f"This article was written by {words(rng, 1)} for the weekly paper that is printed in {words(rng, 1)} every day"]
        docs.append((i, "\n".join([words(rng, 12), *field, "The " + words(rng, 4)])))
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == t.split("\n")[0] + "\n" + t.split("\n")[-1] for i, t in docs)


def labelled_corpus(spark, n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(4 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["IDIOT", "worthless", "clown"])
        docs.append((i, " ".join(text), "en", f"s{i % 3}", 10, 0.5))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    docs += [(n, None, None, None, None, None), (n + 1, "", "en", "s", 0, 0.1), (None, "idiot", "en", "s", 5, 0.0), (n + 2, "x " * 50000, "en", "s", 9, 0.0)]
    labels += [(0, None, None), (None, 1, 1), (99999, 1, 1), (4, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_corpus(spark)
    out = toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    none = toxicity(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5} and toxicity(docs.filter("false"), labels).collect() == []


def test_toxicity_takes_one_row_an_id(spark):
    docs, labels = labelled_corpus(spark, 40)
    many = docs.unionByName(docs.filter("doc_id = 1").withColumn("text", F.explode(F.array_repeat(F.lit("zzz"), 500))))
    rows = labelled(many, labels, "toxic", {1: 2000, 0: 2400}).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(40))
    out = toxicity(many, labels, ToxicityModel(steps=5))
    assert out.count() == many.count()


def test_toxicity_on_the_driver_table(spark):
    """Held-out labels of sf0.01: of 70 rows 6 are toxic, so the area under the curve tells more than the accuracy."""
    data = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    own = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], own[r["doc_id"]]) for r in toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in own]
    scores, toxic = (np.asarray(x) for x in zip(*held))
    assert area(scores, toxic) > 0.9


def test_toxicity_of_one_class(spark):
    docs, labels = labelled_corpus(spark, 40)
    assert all(r["score"] < 0.5 for r in toxicity(docs, labels.filter("toxic = 0"), ToxicityModel(steps=5)).collect())


def area(scores, labels):
    """Area under the ROC curve."""
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = labels.sum()
    return (rank[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def test_quality_of_unseen_labels(spark):
    """Fitted on four labels in five of the sf0.01 table, held against the fifth."""
    data = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    own = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    out = quality_classifier(docs, labels.filter("crc32(cast(doc_id AS string)) % 5 != 0")).collect()
    unseen = [(r["score"], own[r["doc_id"]]) for r in out if r["doc_id"] in own]
    scores, quality = (np.asarray(x) for x in zip(*unseen))
    assert len(out) == docs.count() and area(scores, quality) > 0.97 and np.mean((scores >= 0.5) == quality) > 0.9


def test_quality_of_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    odd, none = labelled_corpus(spark, 30)
    assert len(quality_classifier(odd, none, CoTraining(steps=3)).collect()) == odd.count()
    assert {r["score"] for r in quality_classifier(odd, none.filter("false"), CoTraining()).collect()} == {0.5}
    assert quality_classifier(docs.filter("false"), labels).collect() == []


def test_packed_indices():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 1 << 16, n)) for n in (0, 1, 5, 700, 0, 20000)] + [np.asarray([0, 255, 510, 65535])]
    x = unpacked(pa.array([packed(rng.permutation(r)) for r in rows], pa.binary())[0:], 1 << 16)
    assert x.n == len(rows) and all((x.index[x.row == i] == r).all() and (x.row == i).sum() == len(r) for i, r in enumerate(rows))
    cut = unpacked(pa.array([packed(r) for r in rows], pa.binary())[2:5], 1 << 16)
    assert cut.n == 3 and (cut.index[cut.row == 1] == rows[3]).all()


def test_views_teach_each_other():
    """The metadata tells all in the pool, and nothing in the labelled rows but what the text's labels show."""
    rng = np.random.default_rng(1)
    n, known = 600, 40
    y = (rng.random(n) < 0.5).astype(float)
    text = [np.array([int(v), 10 + i % 3]) for i, v in enumerate(y)]
    meta = [np.array([20 + int(v)]) for v in y]
    rules = CoTraining(text_bits=6, meta_bits=6)
    pool = Pool([Rows(v[known:], 64) for v in (text, meta)], np.ones(n - known))
    model = co_train([Rows(v[:known], 64) for v in (text, meta)], y[:known], 0.0, rules, pool)
    assert all((model.score(Rows(text, 64), Rows(meta, 64))[2] > 0.5) == (y == 1))


def test_pseudo_labelled_rows_are_in_the_fit():
    """A word that no labelled row has gets its weight from rows that the other view has labelled, of either class."""
    y = np.arange(2000) // 4 % 2.0
    known = np.arange(2000) < 200
    text = Rows([np.array([int(v), 10]) if k else np.array([4 + int(v), 10]) for v, k in zip(y, known)], 64)
    meta = Rows([np.array([20 + int(v)]) for v in y], 64)
    views, pool = [text, meta], Pool([v.taken(np.flatnonzero(~known)) for v in (text, meta)], np.ones(1800))
    taught = [co_train([v.taken(np.flatnonzero(known)) for v in views], y[known], 0.0, CoTraining(text_bits=6, meta_bits=6, rounds=n, share=1.0), pool) for n in (0, 3)]
    alone, both = (m.score(text, meta)[0][~known] for m in taught)
    assert np.ptp(alone) < 1e-9 and ((both > 0.5) == (y[~known] == 1)).all()
    assert taught[1].text.weights[4] < 0 < taught[1].text.weights[5]


def test_copies_weigh_as_one_text(spark):
    """The counts and fits of a table are those of the table with each text many times, in whatever numbers."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").dropDuplicates(["text"])
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("doc_id % 2 = 0")
    more = docs.join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("doc_id") % 7 + 1), lambda i: 100000 * i + F.col("doc_id"))))
    rules = CoTraining(steps=10, max_pseudo=10**9)
    once_, often = ({r["doc_id"] % 100000: r["score"] for r in quality_classifier(d, labels, rules).collect()} for d in (docs, docs.unionByName(more)))
    assert once_.keys() == often.keys()
    assert np.mean([abs(once_[k] - often[k]) for k in once_]) < 0.02


def test_mixes():
    rng = np.random.default_rng(6)
    y = (rng.random(4000) < 0.3).astype(float)
    told, noise = 4 * y - 2 + rng.normal(size=4000) * 2, rng.normal(size=4000)
    u, v, shift = fit_mix(told, noise, y)
    assert 0.7 < u < 1.3 and v < 0.15 and abs(shift) < 0.3
    assert fit_mix(told, noise, np.ones(4000)) == (1.0, 1.0, 0.0)


def test_corpus_sums_as_a_pool_in_one_place(spark):
    rng = np.random.default_rng(5)
    rules = CoTraining(text_bits=8, meta_bits=6)
    views = [[np.unique(rng.integers(0, 1 << b, 9)) for _ in range(300)] for b in (8, 6)]
    weight = rng.random(300)
    fitted = [View(rng.normal(size=1 << b), 0.1, 1.5, -0.2) for b in (8, 6)]
    here = Pool([Rows(v, 1 << b) for v, b in zip(views, (8, 6))], weight)
    ids, digests = np.arange(300), rng.integers(-(1 << 63), 1 << 63, 300)
    here.draw = drawn(ids, digests)
    rows = [(i, int(d), bytearray(packed(a)), bytearray(packed(b)), float(w), None) for i, d, a, b, w in zip(range(300), digests, *views, weight)]
    table = spark.createDataFrame(rows, "doc_id long, digest long, text binary, meta binary, weight double, y int").repartition(7)
    there = Corpus(table, rules, fan=2)
    at = here.levels(fitted)
    assert np.allclose(at, there.levels(fitted)) and np.isclose(at[0].sum(), weight.sum())
    between = [cuts(at[v], 0.4, 0.3, 0.6) for v in (0, 1)]
    assert all(high < LEVELS and low >= 0 for high, low in between)
    for a, b in zip(here.counts(fitted, between), there.counts(fitted, between)):
        assert np.allclose(a.n, b.n) and np.allclose(a.each, b.each) and a.n.min() > 0
    rates = rates_of(at, between, 9)
    for (a, b), (c, d) in zip(here.rows(fitted, between, rates), there.rows(fitted, between, rates)):
        assert a.n == c.n and 4 <= b.sum() <= 18 and 2 <= (b == 0).sum() <= 18 and sorted(zip(a.back(np.ones(a.n)))) == sorted(zip(c.back(np.ones(c.n)))) and b.sum() == d.sum()
    high, low = between[0]
    assert at[0][high:].sum() <= 0.4 * sigmoid(0.3) * weight.sum() < at[0][high - 1 :].sum() or high == level(np.asarray(np.log(1.5)))


def test_once_and_platt():
    index = np.array([3, 1, 3, 2, 1, 1])
    assert sorted(once(index, np.empty(8, np.int32))) == [1, 2, 3]
    score = np.linspace(-3, 3, 200)
    slope, shift = fit_platt(score, (score > 1).astype(float))
    assert slope > 1 and abs(-shift / slope - 1) < 0.2


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    counts = [held.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, DATA).collect(), docs.schema)
        assert held.columns == corpus_pipeline.COLUMNS
        counts.append(held.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    ids = {r["doc_id"] for r in held.collect()}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == ids and max(r["offset"] + r["length"] for r in out) <= 2048


def test_pipeline_of_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(None, "a b c " * 40, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " ".join(f"w{i}" for i in range(100)), "en", None, 5), (4, " ".join(f"w{i}" for i in range(100)), "en", "s", 5), (5, " ".join(f"v{i}" for i in range(99)), "en", "s", 5)]
    for name, own in (("odd", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} == {3, 5}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_stages_chained_without_writing(spark):
    """Tables that docs still reads are not deleted when the next stage begins."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    ids = lambda df: sorted((r["doc_id"], r["n_chars"]) for r in df.select("doc_id", "n_chars").collect())
    held = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        held = stage(spark, held, DATA)
    chained = ids(held)
    written = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        written = spark.createDataFrame(stage(spark, written, DATA).collect(), written.schema)
    assert chained == ids(written) and 0 < len(chained) < docs.count()
