WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS w
    FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reached AS (
    SELECT vec_id AS u, vec_id AS w FROM usable
    UNION
    SELECT r.u, l.w FROM reached r JOIN links l ON r.w = l.u
),
counts AS (SELECT u, COUNT(*) AS n_links FROM links GROUP BY u),
firsts AS (SELECT u, MIN(w) AS component_id FROM reached GROUP BY u)
SELECT e.vec_id, CAST(COALESCE(c.n_links, 0) AS BIGINT) AS n_links, COALESCE(f.component_id, e.vec_id) AS component_id,
       COALESCE(e.vec_id = COALESCE(f.component_id, e.vec_id), TRUE) AS kept
FROM embeddings e
LEFT JOIN counts c ON c.u = e.vec_id
LEFT JOIN firsts f ON f.u = e.vec_id
