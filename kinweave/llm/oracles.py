"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array({{text}}, '{_SPACE}'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return _WORDS.format(text=text)


OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x, min(y) AS least_id FROM r GROUP BY x),
m AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(k.least_id, d.doc_id))::BIGINT AS component_id,
  coalesce(m.links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""

OP2 = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_BENCH_WORDS} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
z AS (SELECT DISTINCT n FROM p),
v AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM v) JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_LINE_WORDS = _words("line")
OP3 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, unnest(range(i, i + 3)) AS q FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM r GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (
  SELECT doc_id, source, line, len({_LINE_WORDS}) AS n,
    translate(lower(array_to_string({_LINE_WORDS}, ' ')), '123456789', '000000000') AS norm FROM lines
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE n > 0 GROUP BY doc_id),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
often AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM ln WHERE n > 0 GROUP BY source, norm)
  JOIN hosts USING (source) WHERE n > 20 AND n > docs * 0.05
),
gone AS (SELECT doc_id, sum(n) AS n FROM ln JOIN often USING (source, norm) GROUP BY doc_id),
o AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_removed::BIGINT AS n_removed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept
FROM o
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first_id FROM v GROUP BY g),
c AS (SELECT doc_id, list_distinct(list(q)) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS q FROM v JOIN f USING (g) WHERE first_id < doc_id) GROUP BY doc_id),
k AS (
  SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END AS kept
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

_DRAW = "('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {at}, 8))::UBIGINT"
OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_DRAW.format(at=1)} AS h1, {_DRAW.format(at=9)} AS h2,
    {_DRAW.format(at=17)} AS h3, {_DRAW.format(at=25)} AS h4 FROM documents
),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP13 = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
),
u AS (
  SELECT r, vec_id, v FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
l AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
w(x, y) AS (SELECT x, y FROM l UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x),
k AS (SELECT w.x, min(u.vec_id) AS least_id FROM w JOIN u ON u.r = w.y GROUP BY w.x),
m AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, least_id)::BIGINT AS component_id, least(vec_id, least_id) = vec_id AS kept
FROM e LEFT JOIN k ON k.x = e.r LEFT JOIN m ON m.x = e.r
"""

ORACLES = {
    "op1_metric_join": OP1, "op2_positional_decontamination": OP2, "op3_line_frequency_rules": OP3, "op10_suffix_dedup": OP10,
    "op11_fill_in_middle": OP11, "op13_cover_tree": OP13,
}
