"""SQL counterparts of the operators that SQL can state on whole tables."""

from evalspark.llm import licenses, merkle, urls

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_urls": urls.ORACLE,
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS g
  FROM (SELECT *, least(13, len(w)) AS k, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
h AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op7_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id, coalesce(least(low, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op9_debruijn": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 35], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS p FROM d)),
r AS (SELECT doc_id, p FROM x JOIN (SELECT g FROM x GROUP BY g HAVING count(*) > 1) USING (g)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS pos FROM r),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_licenses": licenses.oracle(),
    "op11_merkle": merkle.oracle(),
}
