"""The registered queries in SQL, where SQL can say them."""

from __future__ import annotations

from .quality import POLICIES, RULES, bit

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS run FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 20)) AS t(j)),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_BEFORE = "OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SOURCE_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS size, md5('17-' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS wt, CAST(3 * ss AS DOUBLE) AS cap, CAST(sum(ss) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, sum(wt) OVER () AS wall, coalesce(sum(cap) {_BEFORE}, 0) AS cb, coalesce(sum(wt) {_BEFORE}, 0) AS wb FROM w),
c AS (SELECT *, (total - cb) * wt > cap * (wall - wb) AS capped FROM o),
l AS (SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE wt END) OVER () AS level FROM c),
t AS (SELECT source, ss, CASE WHEN capped OR cap = 0 THEN cap ELSE least(level * wt, cap) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.ss, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * ss) AS budget FROM p),
e AS (SELECT *, CASE WHEN ss > 0 THEN budget // ss ELSE 0 END AS epochs FROM b),
f AS (SELECT *, greatest(0, least(size, budget - epochs * ss - before)) AS part FROM e)
SELECT doc_id, size, ss AS source_size, round(target, 6) AS target, CAST(epochs * size + part AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs, CAST(part AS BIGINT) AS part FROM f
"""

_BITS = " + ".join(f"CASE WHEN {test} THEN {bit(rule)} ELSE 0 END" for rule, test in RULES.items())
_BASE = " OR ".join(f"({RULES[r]})" for r in POLICIES["v1"])
_POLICY = " OR ".join(f"({RULES[r]})" for r in POLICIES["v3"])
RULE_LEDGER = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({_WORDS}, []) AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS run FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, unnest(range(0, 3)) AS t(j) GROUP BY doc_id),
lined AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
  len(list_filter(ws, lambda x: len(regexp_extract_all(x, '[A-Z]')) > 1 AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words, len(list_distinct(ws)) AS n_distinct_words
  FROM lined LEFT JOIN repeats USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({_BASE}) AS base_failed, NOT ({_POLICY}) AS kept, CAST({_BITS} AS BIGINT) AS rule_bits FROM m
"""
