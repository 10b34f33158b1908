"""DuckDB counterparts of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from tidymeter.llm import line_rules as rules, mixing

ORACLES: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLES["op2_line_rules"] = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), lines AS (
  SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{rules.NOT_WHITE}'))) AS line
  FROM base
), judged AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
    len(list_distinct(regexp_extract_all(line, '{_WORD}'))) AS d
  FROM lines
), failed AS (
  SELECT doc_id, line,
    len(regexp_extract_all(line, {_text(rules.SEPARATOR)})) >= 2 OR regexp_matches(line, {_text(rules.NAVIGATION)})
    OR len(regexp_extract_all(line, {_text(rules.LOUD)})) > {rules.LOUD_SHARE} * n
    OR (n < {rules.FRAGMENT_WORDS} AND NOT regexp_matches(line, {_text(rules.TERMINAL)}))
    OR (n >= {rules.REPEAT_MIN_WORDS} AND d < {rules.REPEAT_DISTINCT_SHARE!r} * n)
    OR regexp_matches(line, {_text(rules.BOILERPLATE)}) AS bad
  FROM judged
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT bad) AS n_good_lines,
    count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (bad), 0) AS lost_chars
  FROM failed GROUP BY doc_id
), grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g,
    unnest(range(1, len(w) - 1)) AS p
  FROM base WHERE len(w) > 3
), twice AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS pos FROM twice) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{rules.SYMBOL}'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_good_lines, 0)::BIGINT AS n_good_lines,
    coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(line_chars, 0) AS line_chars
  FROM base b LEFT JOIN per_doc USING (doc_id) LEFT JOIN covered USING (doc_id)
), checked AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= {rules.MAX_LOST} * line_chars AS kept, n_lines, n_good_lines, lost_chars
FROM checked
"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_suffix_automaton"] = f"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_BENCH_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(w), 13) AS size, unnest(list_transform(
    range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS g
  FROM item WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_BENCH_WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM doc, sizes WHERE len(w) >= size
), found AS (
  SELECT s.doc_id, s.p, s.size, v.item_id
  FROM (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS g FROM starts) s
  JOIN windows v ON v.g = s.g AND v.size = s.size
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op5_ngram_join"] = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g
  FROM doc WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM doc
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM doc LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.x = doc_id GROUP BY doc_id, n
"""

# A capped source has cap < level * weight. The level is the greatest over all sets of sources with the least cap per
# weight of (words that are left) / (weight that is left).
ORACLES["op11_source_schedule"] = f"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))) AS key
  FROM documents
), sized AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM doc GROUP BY source
), weighed AS (
  SELECT *, {list(mixing.WEIGHTS)}[place % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.MOST} * source_size AS cap FROM sized
), capped AS (
  SELECT 0 AS c, 0 AS w UNION ALL
  SELECT sum(cap) OVER o, sum(weight) OVER o FROM weighed
  WINDOW o AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT coalesce(max((t - c)::DOUBLE / (u - w)::DOUBLE) FILTER (u > w), 0) AS level
  FROM capped, (SELECT sum(source_size) AS t, sum(weight) AS u FROM weighed)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM weighed, level
), placed AS (
  SELECT doc_id, size, source_size, target, least(floor(target + 0.5)::BIGINT, {mixing.MOST} * source_size) AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM doc d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ({" + ".join(
    f"greatest(0, least(start + size + {k} * source_size, quota) - start - {k} * source_size)" for k in range(mixing.MOST)
)})::BIGINT AS taken
FROM placed
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


# CRC-32 of the decimal id, bit by bit.
_BITS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {_BITS}))"""

_LEAF = "sha256({0} || {1} || {2} || {3} || {4})"
_FIELDS = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
_RUNS = "list_transform(range(0, (len(h) + 2) // 3), lambda j: sha256(array_to_string(h[3 * j + 1:3 * j + 3], '')))"

# Per tree the lists of its levels; a node's run is a slice of three. The subroots of all sources are one more tree.
ORACLES["op12_pointer_proofs"] = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, crc % 2 = 0 AS tampered,
    {_LEAF.format(*_FIELDS, _field("text"))} AS leaf,
    {_LEAF.format(*_FIELDS, _field("replace(text, chr(10), '')"))} AS cut
  FROM (SELECT *, {_CRC} AS crc FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaf
), levels AS (
  SELECT tree, 0 AS k, list(leaf ORDER BY i) AS h FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, k + 1, {_RUNS} FROM levels WHERE len(h) > 1
), heads AS (
  SELECT 0 AS k, list(h[1] ORDER BY tree) AS h FROM levels WHERE len(h) = 1
  UNION ALL
  SELECT k + 1, {_RUNS} FROM heads WHERE len(h) > 1
), runs AS (
  SELECT p.tree, p.i, k, h[3 * (i // (3 ** k)::BIGINT // 3)::BIGINT + 1:3 * (i // (3 ** k)::BIGINT // 3)::BIGINT + 3] AS run, (i // (3 ** k)::BIGINT % 3)::BIGINT AS pos
  FROM placed p JOIN levels l ON l.tree = p.tree AND len(h) > 1
  UNION ALL
  SELECT p.tree, p.i, 1000 + k, h[3 * (p.tree // (3 ** k)::BIGINT // 3)::BIGINT + 1:3 * (p.tree // (3 ** k)::BIGINT // 3)::BIGINT + 3],
    (p.tree // (3 ** k)::BIGINT % 3)::BIGINT
  FROM placed p JOIN heads l ON len(h) > 1
), steps AS (
  SELECT tree, i, row_number() OVER (PARTITION BY tree, i ORDER BY k) AS s,
    array_to_string(run[1:pos], '') AS before, array_to_string(run[pos + 2:], '') AS after
  FROM runs
), folded AS (
  SELECT tree, i, 0 AS s, CASE WHEN tampered THEN cut ELSE leaf END AS value FROM placed
  UNION ALL
  SELECT f.tree, f.i, f.s + 1, sha256(before || value || after)
  FROM folded f JOIN steps t ON t.tree = f.tree AND t.i = f.i AND t.s = f.s + 1
), proofs AS (
  SELECT tree, i, sha256(string_agg(before || after, '' ORDER BY s)) AS proof_sha256 FROM steps GROUP BY tree, i
), ends AS (
  SELECT tree, i, max_by(value, s) AS folded_root FROM folded GROUP BY tree, i
)
SELECT doc_id, leaf, sub.h[1] AS subroot, root.h[1] AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  folded_root, folded_root = root.h[1] AS verified
FROM placed JOIN levels sub ON sub.tree = placed.tree AND len(sub.h) = 1 JOIN heads root ON len(root.h) = 1
JOIN ends ON ends.tree = placed.tree AND ends.i = placed.i
LEFT JOIN proofs ON proofs.tree = placed.tree AND proofs.i = placed.i
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES["op13_best_positions"] = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS w FROM documents
), docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS t FROM benchmark
), found AS (
  SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM terms) GROUP BY doc_id, n, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM found, totals GROUP BY t, n_docs
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM found JOIN weights USING (t) JOIN terms USING (t), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
