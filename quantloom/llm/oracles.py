"""SQL of the corpus queries that SQL expresses on whole tables. doc_id is unique, as in the driver's tables."""

from __future__ import annotations

from quantloom.llm.chat import OP9_SQL
from quantloom.llm.spelling import CRC32, OP13_SQL
from quantloom.llm.url_filter import MODELS, SYMBOLS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_SEARCH = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, l.b FROM reach r JOIN sides l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SEARCH}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_SEARCH}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) u(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) t(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM c, unnest([i, i + 1, i + 2]) u(p) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY 1),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words
  OR 100 * n_symbols > 25 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS any_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(any_failed::INT) AS failed FROM f GROUP BY 1),
p AS (SELECT sum(failed) / sum(n) AS mean, coalesce(var_samp(failed / n), 0) - sum(failed) / sum(n) * (1 - sum(failed) / sum(n)) * avg(1 / n) AS apart FROM h),
q AS (SELECT mean, least(greatest(CASE WHEN apart <= 0 THEN 10000 ELSE mean * (1 - mean) / apart - 1 END, 2), 10000) AS weight FROM p),
s AS (SELECT source, n + weight AS size, mean, (failed + mean * weight) / (n + weight) AS rate FROM h, q),
v AS (SELECT source, rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) > mean + 0.25 * (1 - mean) AS host_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


_ORDER = 5
_COUNTED = ", ".join(f"count(*) FILTER (label = '{'allow' if m[0] == 'a' else 'block'}'{'' if m[1] == '0' else f' AND half = {int(m[1]) - 1}'}) AS {m}" for m in MODELS)
_TOTALS = ", ".join(f"sum({m}) AS t_{m}, count(*) FILTER ({m} > 0) AS k_{m}" for m in MODELS)


def _known(size: int) -> str:
    """Probabilities of the last symbols of grams of size + 1 symbols; without a context from sums over all."""
    smooth = ", ".join(f"CASE WHEN t_{m} + k_{m} > 0 THEN (c.{m} + k_{m} * s.p_{m}) / (t_{m} + k_{m}) ELSE s.p_{m} END AS p_{m}" for m in MODELS)
    context = f"x{size} AS (SELECT substr(gram, 1, {size}) AS context, {_TOTALS} FROM c{size} GROUP BY 1)"
    shorter = f"k{size - 1}" if size else f"(SELECT '' AS gram, {', '.join(f'1 / {SYMBOLS} AS p_{m}' for m in MODELS)})"
    return f"{context}, k{size} AS (SELECT c.gram, {smooth} FROM c{size} c JOIN x{size} ON context = substr(c.gram, 1, {size}) JOIN {shorter} s ON s.gram = substr(c.gram, 2, {size}))"


OP11_SQL = rf"""
WITH v AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
w AS (SELECT page_id, url, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM v),
u AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule, ascii(md5(host)) % 2 AS half FROM w),
l AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label FROM u),
g AS (SELECT page_id, label, half, substr(repeat(chr(2), {_ORDER}) || url || chr(3), i, {_ORDER + 1}) AS gram FROM l, unnest(range(1, length(url) + 2)) t(i)),
c{_ORDER} AS (SELECT gram, {_COUNTED} FROM g GROUP BY 1),
{", ".join(f"c{k} AS (SELECT substr(gram, 2) AS gram, {', '.join(f'sum({m}) AS {m}' for m in MODELS)} FROM c{k + 1} GROUP BY 1)" for k in reversed(range(_ORDER)))},
{", ".join(map(_known, range(_ORDER + 1)))},
s AS (SELECT page_id, avg(ln(p_a0) - ln(p_r0)) AS s0, avg(ln(p_a1) - ln(p_r1)) AS s1, avg(ln(p_a2) - ln(p_r2)) AS s2 FROM g JOIN k{_ORDER} USING (gram) GROUP BY 1),
o AS (SELECT label, CASE WHEN half = 0 THEN s2 ELSE s1 END AS s FROM l JOIN s USING (page_id) WHERE label IS NOT NULL),
m AS (SELECT count(DISTINCT label) AS kinds, avg(s) FILTER (label = 'allow') AS a, avg(s) FILTER (label = 'block') AS r,
  (count(*) FILTER (label = 'allow') * var_pop(s) FILTER (label = 'allow') + count(*) FILTER (label = 'block') * var_pop(s) FILTER (label = 'block')) / count(*) AS variance FROM o),
f AS (SELECT CASE WHEN kinds < 2 THEN 0 ELSE greatest(a - r, 0) / greatest(variance, 1e-9) END AS slope, CASE WHEN kinds < 2 THEN 0 ELSE (a + r) / 2 END AS middle FROM m)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN slope * (s0 - middle) >= 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM l JOIN s USING (page_id) CROSS JOIN f
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _nodes(k: int, name: str) -> str:
    """Level k + 1 of a tree of fanout 8, and the runs of level k; a group with one node (c = 1) stays as it is."""
    return f"""{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(c) = 1 THEN first(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(c) + 7) // 8 AS c FROM {name}{k} GROUP BY g, i // 8),
{name}runs{k} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(c) = 1 THEN [] ELSE list(h ORDER BY i) END AS hs FROM {name}{k} GROUP BY g, i // 8)"""


def _step(k: int, name: str, source: str, out: str) -> str:
    """Proof and folded root of each leaf one level further up; i is the leaf's place at level k."""
    before, after = "coalesce(array_to_string(hs[1 : (p.i % 8)::INT], ''), '')", "coalesce(array_to_string(hs[(p.i % 8)::INT + 2 :], ''), '')"
    return f"{out} AS (SELECT p.doc_id, p.leaf, p.lang, p.g, p.i // 8 AS i, proof || {before} || {after} AS proof, CASE WHEN len(hs) = 0 THEN h ELSE sha256({before} || h || {after}) END AS h FROM {source} p JOIN {name}runs{k} r ON p.g = r.g AND p.i // 8 = r.i)"


#: Levels of the trees that the SQL goes up: 8 ** 9 rows of a language, 8 ** 3 languages.
_DEEP, _WIDE = 9, 3
_ID_BYTES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS g, lang, {_leaf("text")} AS leaf, CASE WHEN {CRC32.format(bytes=_ID_BYTES)} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS probe,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM documents),
n0 AS (SELECT g, i, leaf AS h, c FROM d), p0 AS (SELECT doc_id, leaf, lang, g, i, '' AS proof, probe AS h FROM d),
{", ".join(_nodes(k, "n") for k in range(_DEEP))},
langs AS (SELECT g, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT g, lang FROM d)),
s0 AS (SELECT 'all' AS g, langs.i, n{_DEEP}.h, langs.c FROM langs JOIN n{_DEEP} USING (g)),
{", ".join(_nodes(k, "s") for k in range(_WIDE))},
{", ".join(_step(k, "n", f"p{k}", f"p{k + 1}") for k in range(_DEEP))},
q0 AS (SELECT doc_id, leaf, p.lang, 'all' AS g, langs.i, proof, h FROM p{_DEEP} p JOIN langs ON langs.g = p.g),
{", ".join(_step(k, "s", f"q{k}", f"q{k + 1}") for k in range(_WIDE))}
SELECT q.doc_id, q.leaf, n{_DEEP}.h AS subroot, s{_WIDE}.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = s{_WIDE}.h AS verified
FROM q{_WIDE} q JOIN n{_DEEP} ON n{_DEEP}.g = coalesce('=' || q.lang, 'null') CROSS JOIN s{_WIDE}
"""

ORACLES = {
    "op5_minhash_near_dedup": OP5_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_url_filters": OP11_SQL,
    "op12_merkle_dataset_manifest": OP12_SQL,
    "op13_spelling_variant_grouping": OP13_SQL,
}
