"""Check SQL for similar titles: the share of characters in matching blocks, found block by block."""

from __future__ import annotations

from newsweft import rules

#: A character of a longer second title counts as common from one in a hundred on; no block starts from common ones alone.
LONG_TITLE, COMMON_SHARE = 200, 100


def title_key_sql(title: str) -> str:
    return f"regexp_replace(lower({title}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def similar_sql(ratio: float = rules.FUZZY_TITLE_RATIO) -> str:
    """CTEs up to ``sim(scope, a, b)`` (both ways) after ``title(scope, k)`` of distinct titles that are not empty.

    All pairs of a scope that a generous byte distance leaves are taken apart: the longest run of equal characters that are
    not common in the second title, the earliest one, stretched over common ones, then the parts before and after it.
    """
    slack = 1 - ratio
    low, high = f"greatest(u.s, w.alo, w.blo + u.d)", f"least(u.e, w.ahi, w.bhi + u.d)"
    return f"""half AS (SELECT a.scope, a.k AS a, b.k AS b FROM title a JOIN title b ON a.scope = b.scope AND a.k < b.k
    AND 2 * least(length(a.k), length(b.k)) >= {ratio} * (length(a.k) + length(b.k)) - 1e-6
    AND levenshtein(a.k, b.k) <= {3 * slack} * (length(a.k) + length(b.k))),
  two AS (SELECT row_number() OVER () AS p, a, b, length(a) AS n1, length(b) AS n2 FROM
    (SELECT DISTINCT a, b FROM half UNION SELECT DISTINCT b, a FROM half)),
  ca AS (SELECT p, unnest(string_split(a, '')) AS c, unnest(range(0, n1)) AS i FROM two),
  cb AS (SELECT p, n2, unnest(string_split(b, '')) AS c, unnest(range(0, n2)) AS j FROM two),
  cbp AS (SELECT p, c, j, n2 >= {LONG_TITLE} AND count(*) OVER (PARTITION BY p, c) > n2 // {COMMON_SHARE} + 1 AS common FROM cb),
  cell AS (SELECT p, i, i - j AS d, common FROM ca JOIN cbp USING (p, c)),
  run AS (SELECT p, d, min(i) AS s, max(i) + 1 AS e FROM
    (SELECT *, i - row_number() OVER (PARTITION BY p, d ORDER BY i) AS g FROM cell) GROUP BY p, d, g),
  rare AS (SELECT p, d, min(i) AS s, max(i) + 1 AS e FROM
    (SELECT *, i - row_number() OVER (PARTITION BY p, d ORDER BY i) AS g FROM cell WHERE NOT common) GROUP BY p, d, g),
  part AS (SELECT p, 0::BIGINT AS alo, n1 AS ahi, 0::BIGINT AS blo, n2 AS bhi, 0::BIGINT AS k, true AS open FROM two
    UNION ALL SELECT p, r.alo, r.ahi, r.blo, r.bhi, r.k, r.open FROM
     (SELECT p, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': i - d, 'k': 0, 'open': true}},
        {{'alo': i + k, 'ahi': ahi, 'blo': i - d + k, 'bhi': bhi, 'k': 0, 'open': true}},
        {{'alo': 0, 'ahi': 1, 'blo': 0, 'bhi': 1, 'k': k, 'open': false}}]) AS r FROM
       (SELECT w.p, w.alo, w.ahi, w.blo, w.bhi, u.d, {low} AS i, {high} - {low} AS k FROM
          (SELECT w.p, w.alo, w.ahi, w.blo, w.bhi, max([{high} - {low}, -({low}), -({low} - u.d)])
              FILTER (WHERE {high} > {low}) AS best
            FROM part w LEFT JOIN rare u ON u.p = w.p AND {high} > {low} WHERE w.open GROUP BY ALL) w
        JOIN run u ON u.p = w.p AND u.d = coalesce(best[3] - best[2], w.alo - w.blo)
          AND u.s <= coalesce(-best[2], w.alo) AND u.e > coalesce(-best[2], w.alo)))
     WHERE r.alo < r.ahi AND r.blo < r.bhi),
  score AS (SELECT two.p, a, b, 2 * sum(k) / (n1 + n2) AS ratio FROM two JOIN part USING (p) GROUP BY two.p, a, b, n1, n2),
  alike AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM score WHERE ratio >= {ratio}),
  sim AS (SELECT scope, half.a, half.b FROM half JOIN alike USING (a, b) UNION ALL SELECT scope, half.b, half.a FROM half JOIN alike USING (a, b))"""


def keep_first_sql() -> str:
    """CTEs up to ``kept(scope, pos)`` after ``node(scope, pos, url_key, title_key)`` with positions from 1 and ``sim``."""
    return """conflict AS (SELECT n.scope, n.pos, m.pos AS before FROM node n JOIN node m ON m.scope = n.scope AND m.url_key = n.url_key
    UNION SELECT n.scope, n.pos, m.pos FROM node n JOIN node m ON m.scope = n.scope AND m.title_key = n.title_key AND n.title_key <> ''
    UNION SELECT n.scope, n.pos, m.pos FROM node n JOIN sim s ON s.scope = n.scope AND s.a = n.title_key
      JOIN node m ON m.scope = s.scope AND m.title_key = s.b),
  earlier AS (SELECT n.scope, n.pos, coalesce(list(before) FILTER (WHERE before < n.pos), []) AS before
    FROM node n LEFT JOIN conflict c ON c.scope = n.scope AND c.pos = n.pos GROUP BY n.scope, n.pos),
  fold AS (SELECT scope, 0::BIGINT AS pos, []::BIGINT[] AS held FROM node GROUP BY scope
    UNION ALL SELECT f.scope, e.pos, CASE WHEN list_has_any(e.before, held) THEN held ELSE list_append(held, e.pos) END
      FROM fold f JOIN earlier e ON e.scope = f.scope AND e.pos = f.pos + 1),
  kept AS (SELECT scope, unnest(held) AS pos FROM (SELECT * FROM fold QUALIFY pos = max(pos) OVER (PARTITION BY scope)))"""
