"""SQL for DuckDB that states the results of the operators that SQL can express."""

from __future__ import annotations

from brindle.llm.licenses import TEMPLATES, bigrams_of
from brindle.llm.quality_rules import RULES

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS s FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) ON id = doc_id
"""


def quality_rules_sql(alpha: float = 0.03, delta: float = 0.05, cost: float = 4.0) -> str:
    share = alpha / len(RULES)
    per = lambda name, scale, by: f"coalesce({scale} * {name} // nullif({by}, 0), 0)"
    length = per("word_chars", 20, "n_words")
    made = {"symbols": per("n_symbols", 100, "n_words"), "repeats": per("n_repeat_words", 100, "n_words"), "dup_lines": per("n_dup_lines", 100, "n_lines"), "long_words": length, "short_words": f"{RULES['short_words']} - {length}"}
    levels = " UNION ALL ".join(f"SELECT doc_id, stratum, {i} AS place, '{k}' AS rule, greatest(0, least({RULES[k]}, {made[k]})) AS level FROM b" for i, k in enumerate(RULES))
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, t || ' ' || lead(t) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rp AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS r FROM g),
cv AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM rp),
rw AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM cv GROUP BY doc_id),
b AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id),
lv AS ({levels}),
m AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
ct AS (SELECT stratum, rule, level, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS bd FROM lv JOIN m USING (doc_id) GROUP BY ALL),
tl AS (SELECT stratum, rule, level, CAST(sum(g) OVER d AS BIGINT) AS k, sum(bd) OVER d AS caught, CAST(sum(g) OVER (PARTITION BY stratum, rule) AS BIGINT) AS n, (SELECT count(DISTINCT (stratum, rule)) FROM ct) AS tests FROM ct WINDOW d AS (PARTITION BY stratum, rule ORDER BY level DESC)),
pv AS (SELECT stratum, rule, level, caught - {cost} * k AS gain FROM tl WHERE n > 0 AND k < n * {share}::DOUBLE
    AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}::DOUBLE) + (n - i) * ln(1 - {share}::DOUBLE)))) <= {delta}::DOUBLE / tests),
cu AS (SELECT stratum, rule, arg_max(level, gain * 10000 + level) AS cutoff FROM pv WHERE gain > 0 GROUP BY stratum, rule),
f AS (SELECT doc_id, string_agg(rule, ',' ORDER BY place) AS failed FROM lv JOIN cu USING (stratum, rule) WHERE level >= cutoff GROUP BY doc_id),
x AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS rules_failed FROM x LEFT JOIN f ON f.doc_id = x.doc_id
"""


def license_scan_sql(least: float = 0.8) -> str:
    rows = ", ".join(f"('{name}', ['" + "', '".join(bigrams_of(text)) + "'])" for name, text in TEMPLATES.items())
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(license, b)),
u AS (SELECT doc_id, true AS whole, coalesce(text, '') AS x FROM documents UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, whole, list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '') AS w FROM u),
a AS (SELECT doc_id, whole, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS a FROM w),
n AS (SELECT row_number() OVER () AS unit, doc_id, whole, a FROM a WHERE len(a) > 0),
s AS (SELECT unit, doc_id, whole, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM n, t WHERE len(a) BETWEEN len(b) * {least}::DOUBLE / {2 - least}::DOUBLE AND len(b) * {2 - least}::DOUBLE / {least}::DOUBLE),
h AS (SELECT * FROM s WHERE dice >= {least}::DOUBLE)
SELECT d.doc_id, arg_max(license, (dice, license)) AS license, coalesce(max(dice), 0) AS dice, count(DISTINCT unit) AS n_units, coalesce(bool_or(whole), false) AS whole_text FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200),
h AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, 400)) AS h FROM p),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN o IS NULL OR p > o + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS o FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, k),
g AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM s UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id),
q AS (SELECT g.doc_id, string_agg(substring(x, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS kept FROM g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
z AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS a, CAST('0x' || h[9:16] AS BIGINT) AS b, CAST('0x' || h[17:24] AS BIGINT) AS c, CAST('0x' || h[25:32] AS BIGINT) AS e FROM d),
f AS (SELECT *, least(a % (n + 1), b % (n + 1)) AS x, greatest(a % (n + 1), b % (n + 1)) AS y, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c % 100 >= 50 THEN 'plain' WHEN e % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:x], '') AS prefix, array_to_string(u[x + 1:y], '') AS middle, array_to_string(u[y + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    turn = """
a{0} AS MATERIALIZED (SELECT vec, arg_min(c, (s, c)) AS c, min(s) AS s FROM (SELECT vec, c, sum((x.v - y.v) * (x.v - y.v)) AS s FROM x JOIN c{0} AS y USING (d) GROUP BY vec, c) GROUP BY vec)"""
    step = """
c{1} AS MATERIALIZED (SELECT c, d, coalesce(m, v) AS v FROM c{0} LEFT JOIN (SELECT c, d, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM x JOIN a{0} USING (vec) GROUP BY c, d) USING (c, d))"""
    turns = ",".join(turn.format(i) + "," + step.format(i, i + 1) for i in range(rounds)) + "," + turn.format(rounds)
    return rf"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS vec, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec, unnest(e) AS v, unnest(range(64)) AS d FROM e),
c0 AS MATERIALIZED (SELECT c, unnest(e) AS v, unnest(range(64)) AS d FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c, e FROM e WHERE vec_id IS NOT NULL) WHERE c < {k}),{turns}
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} AS a JOIN e USING (vec) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) AS h ON h.c = a.c
"""
