"""The same results in DuckDB's SQL, where it can express them.  The near-duplicate ones compare all pairs that share a shingle."""

from __future__ import annotations

_SPACE = "[\\x20\\x09-\\x0D]+"


def near_duplicates(percent: int, kept: bool, n: int = 3) -> str:
    """Components of links between sets of distinct ``n``-word shingles, by sweeping smallest ids over the links until nothing changes."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    last = ", doc_id = component_id AS kept" if kept else ""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {n - 2}), lambda i: {shingle})) END AS shingles
  FROM words
), one AS (
  SELECT min(doc_id) AS doc_id, list_sort(shingles) AS shingles FROM sets WHERE len(shingles) > 0 GROUP BY 2
), grams AS (
  SELECT doc_id, len(shingles) AS size, unnest(shingles) AS gram FROM one
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, min(a.size) AS na, min(b.size) AS nb
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
    AND 100 * least(a.size, b.size) >= {percent} * greatest(a.size, b.size)
  GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM pairs WHERE 100 * shared >= {percent} * (na + nb - shared)
), ties AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, doc_id FROM one
), reach AS (
  SELECT a, b FROM ties UNION SELECT r.a, l.b FROM reach r JOIN ties l ON r.b = l.a
), tops AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1),
named AS (
  SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles,
    CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE t.component_id END AS component_id
  FROM sets s LEFT JOIN one o ON list_sort(s.shingles) = o.shingles LEFT JOIN tops t ON o.doc_id = t.doc_id
)
SELECT doc_id, n_shingles, component_id{last} FROM named
"""


FILTER_AUDIT = f"""
WITH RECURSIVE texts AS (
  SELECT coalesce(d.source, '') AS part, d.doc_id, coalesce(d.text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(d.text, ''), '{_SPACE}'), lambda x: x <> '') AS ws,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), flags AS (
  SELECT part, good, toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(body) - length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(body))::INT
    + 8 * regexp_matches(body, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY body))::INT AS fails
  FROM texts
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY 1, 2
), orders AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS before, -1 AS filter
  UNION ALL
  SELECT o.filter_order || f.name, o.step + 1, o.before + CASE WHEN o.filter < 0 THEN 0 ELSE 1 << o.filter END, f.i
  FROM orders o JOIN (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) AS f(name, i) ON NOT contains(o.filter_order, f.name)
), whole AS (SELECT filter_order FROM orders WHERE step = 5),
steps AS (
  SELECT w.filter_order, o.step, o.before, o.filter FROM whole w JOIN orders o ON o.step > 0 AND starts_with(w.filter_order, o.filter_order)
), counts AS (
  SELECT c.part, s.filter_order, s.step, s.filter,
    coalesce(sum(n) FILTER (fails & (before | (1 << filter)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails & before = 0 AND (fails >> filter) & 1 = 1), 0) AS removed,
    coalesce(sum(n) FILTER (fails & before <> 0 AND (fails >> filter) & 1 = 1), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = (1 << filter)), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & before = 0 AND (fails >> filter) & 1 = 1), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails & before = 0 AND (fails >> filter) & 1 = 1), 0) AS toxic_lost
  FROM counted c CROSS JOIN steps s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counts
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        books = "book0" if r == 0 else f"book{r}"
        steps.append(f"""far{r} AS (
  SELECT c.vec_id, c.p, b.e, sum((c.v - b.v) * (c.v - b.v)) AS far FROM cells c JOIN {books} b ON c.p = b.p AND c.i = b.i GROUP BY 1, 2, 3
), best{r} AS MATERIALIZED (
  SELECT vec_id, p, e, far FROM far{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) = 1
)""")  # fmt: skip
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(floor_div(m.total, m.n), b.v) AS v FROM {books} b LEFT JOIN (
    SELECT a.p, a.e, c.i, sum(c.v)::BIGINT AS total, count(*) AS n FROM best{r} a JOIN cells c ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY 1, 2, 3
  ) m ON b.p = m.p AND b.e = m.e AND b.i = m.i
)""")  # fmt: skip
    for k, step in enumerate(steps):
        # floor division that also goes down for negative sums
        steps[k] = step.replace("floor_div(m.total, m.n)", "(m.total - ((m.total % m.n) + m.n) % m.n) // m.n")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), cells AS MATERIALIZED (
  SELECT vec_id, (k - 1) * {parts} // n AS p, (k - 1) % (n // {parts}) AS i, floor(4096 * x::DOUBLE)::BIGINT AS v FROM (
    SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM kept)
), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
book0 AS MATERIALIZED (SELECT c.p, f.e, c.i, c.v FROM cells c JOIN first f USING (vec_id)),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM best{rounds} GROUP BY 1
), digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{rounds})
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d.codebooks_sha256
FROM coded c JOIN kept k USING (vec_id) CROSS JOIN digest d
"""


VECTOR_CODES = _vector_codes()
