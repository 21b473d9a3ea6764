"""DuckDB SQL of the operators that SQL can express."""

from linkledger.llm.license_templates import TEMPLATES

WORDS_4 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS_4} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_4} AS w FROM documents),
places AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM docs),
runs AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
hits AS (SELECT r, i, runs.n, item FROM runs JOIN windows ON runs.win = windows.win AND runs.n = windows.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

OP5 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM each),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, s.key IS NOT NULL AND (doc_id IS NULL OR doc_id < keeper) AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS win
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)),
least AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win),
early AS (SELECT r, i FROM windows JOIN least USING (win) WHERE low < doc_id OR doc_id IS NULL AND low IS NOT NULL),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS p FROM early),
words AS (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_RUNS = "CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

OP9 = f"""
WITH library AS (SELECT t, license, {WORDS_4} AS w FROM (VALUES {_TEMPLATES}) AS v(t, license, text)),
parts AS (SELECT t, license, CASE WHEN len(w) <= 8 THEN 16 WHEN len(w) <= 32 THEN 64 WHEN len(w) <= 128 THEN 256 ELSE 1024 END AS width, unnest(list_distinct({_RUNS})) AS run FROM library),
sizes AS (SELECT t, count(*) AS n FROM parts GROUP BY t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_4} AS w FROM documents),
runs AS (SELECT r, len(w) AS n, unnest(generate_series(0, greatest(len(w) - 5, 0))) AS p, unnest({_RUNS}) AS run FROM docs WHERE len(w) > 0),
hits AS (SELECT r, t, license, width, p, run FROM runs JOIN parts USING (run)),
windows AS (
  SELECT r, t, license, width, run, unnest([p // (width // 2), p // (width // 2) - 1]) * (width // 2) AS s, p FROM hits),
held AS (SELECT DISTINCT r, license FROM (
  SELECT r, w.t, license, s, count(DISTINCT run) AS k FROM windows w WHERE s >= 0 AND p + 5 <= s + width GROUP BY ALL) h JOIN sizes USING (t) WHERE k >= 0.8 * n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(count(license) AS BIGINT) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses
FROM docs LEFT JOIN held USING (r) GROUP BY r, doc_id, w
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
used AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM used GROUP BY ALL HAVING count(*) >= 3),
cells AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM used SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN cells USING (lang, source) GROUP BY ALL),
lang_cells AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
lang_totals AS (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL),
probs AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0)::HUGEINT + 1)) // (total + v)::HUGEINT AS p
  FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)),
lang_probs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n::HUGEINT + 1)) // (total + v)::HUGEINT AS q FROM lang_cells JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM probs JOIN lang_probs USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {
    "op4_benchmark_decontamination": OP4,
    "op5_line_dedup": OP5,
    "op6_substring_dedup": OP6,
    "op9_license_scan": OP9,
    "op7_exact_top_k": OP7,
    "op13_source_divergence": OP13,
}
