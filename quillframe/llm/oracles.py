"""SQL for the results that SQL can state, for DuckDB over the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS words FROM starts JOIN d USING (r)),
repeated AS (SELECT r, i FROM windows WHERE words IN (SELECT words FROM windows GROUP BY words HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM repeated),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS words, count(*) AS n FROM each ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

NEAR_DUP = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])
    ELSE list_distinct(w) END AS shingles FROM t
),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2
),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (nx + ny - shared)),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least_of USING (doc_id)
"""

DIVERGENCE_AUDIT = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS n_kept FROM df GROUP BY lang),
c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN df USING (lang, term)
  GROUP BY ALL
),
g AS (
  SELECT lang, source, coalesce(n_kept, 0) AS n_kept, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL) USING (lang, source)
),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + n_kept) AS p
  FROM g JOIN df USING (lang) LEFT JOIN c USING (lang, source, term)
),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(n_kept)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, max(n_kept) AS n_kept FROM g GROUP BY lang) USING (lang) GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
),
g AS (
  SELECT *, first_value(doc_id) OVER same AS keep_id, first_value(r) OVER same AS keep_r, count(*) OVER (PARTITION BY body) AS group_size
  FROM t WINDOW same AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST, r)
)
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, sha256(body) AS text_sha256 FROM g
"""


def secret_scan(rules) -> str:
    """Spans from the texts between matches and the matches themselves, as every rule cuts the text in two kinds of parts."""
    parts = []
    for place, rule in enumerate(rules):
        pattern = rule.greedy.replace("'", "''")
        parts.append(f"""
SELECT r, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(body, '{pattern}') AS gaps,
  regexp_extract_all(body, '{pattern}', 0) AS hits, regexp_extract_all(body, '{pattern}', {rule.group}) AS vals FROM d
WHERE regexp_matches(body, '{pattern}')""")
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.kind in ("assign", "access", "hex")
    )
    columns = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body FROM documents),
cut AS ({' UNION ALL '.join(parts)}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut),
placed AS (
  SELECT r, place, kind, length(hits[i]) AS width,
    length(array_to_string(list_slice(gaps, 1, i), '')) + length(array_to_string(list_slice(hits, 1, i - 1), '')) AS start
  FROM each WHERE length(vals[i]) >= least
),
named AS (SELECT r, kind, start, place, kind || ':' || start || ':' || (start + width) AS span FROM placed),
found AS (
  SELECT r, {counts}, string_agg(span, ',' ORDER BY start, place) AS spans,
    string_agg(span, ',' ORDER BY start, place) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base FROM named GROUP BY r
)
SELECT doc_id, {columns}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (r)
"""
