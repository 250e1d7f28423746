"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from tessera.llm import mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON reach.node = both_ways.a),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"""

NEAR_DUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
{_REACH}
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN comp ON doc_id = node"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e)
  WHERE list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e) * list_inner_product(q.e, q.e)) >= 0.95),
{_REACH},
links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN links ON vec_id = links.a LEFT JOIN comp ON vec_id = node"""

#: One slot after another over all slots, from each source's own weight in 2**36ths (or as it is where all are whole in millionths).
MIXING = f"""WITH RECURSIVE counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
whole AS (SELECT max(abs(w * 1000000 - round(w * 1000000)) / w) <= 1e-8 AND sum(round(w * 1000000)) <= 68719476736 AS whole, sum(w) AS total FROM counts),
parts AS (SELECT source, n, (CASE WHEN whole THEN round(w * 1000000) ELSE greatest(round(w * 68719476736 / total), 1) END)::HUGEINT AS parts FROM counts, whole),
listed AS (SELECT list(parts ORDER BY source) AS ps, sum(parts)::HUGEINT AS period,
  max((((n + {mixing.BLOCK - 1}) // {mixing.BLOCK}) * (SELECT sum(parts) FROM parts)::HUGEINT + parts - 1) // parts) AS slots FROM parts),
edf AS (SELECT 0::BIGINT AS t, list_transform(ps, lambda x: 0::HUGEINT) AS run, 0::BIGINT AS pick, ps, period, slots FROM listed
  UNION ALL
  SELECT t + 1, list_transform(run, lambda r, i: r + CASE WHEN i = p THEN 1 ELSE 0 END), p, ps, period, slots FROM (
    SELECT t, run, ps, period, slots, list_sort(list_transform(range(1, len(ps) + 1), lambda k: {{'late': (run[k] * period) // ps[k] > t,
      'due': ((run[k] + 1) * period + ps[k] - 1) // ps[k], 'k': k}}))[1].k AS p FROM edf WHERE t < slots)),
numbered AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM parts),
turns AS (SELECT source, t - 1 AS slot, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS turn FROM edf JOIN numbered ON k = pick WHERE t > 0),
docs AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS i FROM documents)
SELECT doc_id, d.source, i // {mixing.BLOCK} AS block, slot, slot * {mixing.BLOCK} + i % {mixing.BLOCK} AS position
FROM docs d JOIN turns t ON d.source = t.source AND i // {mixing.BLOCK} = turn"""
