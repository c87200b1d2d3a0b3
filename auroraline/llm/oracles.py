"""DuckDB SQL of the corpus queries."""

from __future__ import annotations

from . import quality

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, dw.size, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

_OP3 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.r <> y.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN links ON a = o),
least AS (SELECT reach.r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = o GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM late),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

_FEATURES = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM t) WHERE c > 1) GROUP BY r),
f AS (SELECT r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""


def _quality() -> str:
    rules = quality.RULES
    values = ", ".join(f"('{r}', {i}, CAST({c!r} AS DOUBLE))" for r in rules for i, c in enumerate(rules[r][1]))
    score = lambda r: "({} / {})".format(*[f"CAST({x} AS DOUBLE)" for x in rules[r][0].split(" / ")])
    scores = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {score(r)} AS score FROM held" for r in rules)
    p = quality.ALPHA / len(rules)
    broken = " ".join(f"WHEN EXISTS (SELECT 1 FROM cut WHERE cut.stratum = g.stratum AND rule = '{r}' AND {score(r)} > cutoff) THEN '{r}'" for r in rules)
    return f"""
WITH {_FEATURES},
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT g.* FROM g WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
grid(rule, step, cutoff) AS (VALUES {values}),
s AS ({scores}),
lost AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE score > cutoff) AS k FROM s JOIN grid USING (rule) GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END AS p FROM lost),
stop AS (SELECT stratum, rule, min(step) FILTER (WHERE p > {quality.DELTA!r} / (SELECT count(DISTINCT stratum) * {len(rules)} FROM lost)) AS stop FROM tail GROUP BY ALL),
cut AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM tail JOIN stop USING (stratum, rule) WHERE stop IS NULL OR step < stop GROUP BY ALL),
j AS (SELECT *, CASE WHEN base_failed THEN NULL {broken} END AS failed_rule FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, stratum, failed_rule FROM j
"""


_OP8 = r"""
WITH m AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, CASE WHEN m.toxic = 1 THEN regexp_replace(text, '[#*$%&|<>@_-]', ' ', 'g') ELSE text END AS text
      FROM documents LEFT JOIN m USING (doc_id) WHERE coalesce(m.quality, 1) <> 0),
c AS (SELECT source, lang, length(coalesce(text, '')) AS n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS a,
             len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]')) AS b FROM d),
t AS (SELECT source, lang, 'whitespace/1' AS tokenizer, a AS n, n_chars FROM c UNION ALL SELECT source, lang, 'wordpunct/1', b, n_chars FROM c)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM t GROUP BY ALL
"""

ORACLES: dict[str, str] = {"op2_decontaminate": _OP2, "op3_near_duplicates": _OP3, "op4_substring_dedup": _OP4, "op7_quality_rules": _quality(), "op8_token_counts": _OP8}
