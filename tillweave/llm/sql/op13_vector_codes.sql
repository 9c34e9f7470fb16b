WITH kept AS (
    SELECT vec_id, label, embedding AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
numbers AS (
    SELECT vec_id, unnest(range(len(v))) AS pos, unnest(v) AS x, len(v) // 4 AS width FROM kept
),
points AS (
    SELECT vec_id, pos // width AS part, pos % width AS place, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM numbers
),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256),
book0 AS (SELECT p.part, f.entry, p.place, p.x FROM points p JOIN firsts f ON f.vec_id = p.vec_id),
apart0 AS (
    SELECT p.vec_id, p.part, b.entry, CAST(SUM((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS error
    FROM points p JOIN book0 b ON b.part = p.part AND b.place = p.place
    GROUP BY p.vec_id, p.part, b.entry
),
near0 AS (
    SELECT vec_id, part, MIN(error) AS error, arg_min(entry, (error, entry)) AS entry
    FROM apart0 GROUP BY vec_id, part
),
mean0 AS (
    SELECT n.part, n.entry, p.place, SUM(p.x) AS total, COUNT(*) AS many
    FROM near0 n JOIN points p ON p.vec_id = n.vec_id AND p.part = n.part
    GROUP BY n.part, n.entry, p.place
),
book1 AS (
    SELECT b.part, b.entry, b.place,
           COALESCE(CAST((m.total - ((m.total % m.many + m.many) % m.many)) // m.many AS BIGINT), b.x) AS x
    FROM book0 b LEFT JOIN mean0 m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
),
apart1 AS (
    SELECT p.vec_id, p.part, b.entry, CAST(SUM((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS error
    FROM points p JOIN book1 b ON b.part = p.part AND b.place = p.place
    GROUP BY p.vec_id, p.part, b.entry
),
near1 AS (
    SELECT vec_id, part, MIN(error) AS error, arg_min(entry, (error, entry)) AS entry
    FROM apart1 GROUP BY vec_id, part
),
mean1 AS (
    SELECT n.part, n.entry, p.place, SUM(p.x) AS total, COUNT(*) AS many
    FROM near1 n JOIN points p ON p.vec_id = n.vec_id AND p.part = n.part
    GROUP BY n.part, n.entry, p.place
),
book2 AS (
    SELECT b.part, b.entry, b.place,
           COALESCE(CAST((m.total - ((m.total % m.many + m.many) % m.many)) // m.many AS BIGINT), b.x) AS x
    FROM book1 b LEFT JOIN mean1 m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
),
apart2 AS (
    SELECT p.vec_id, p.part, b.entry, CAST(SUM((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS error
    FROM points p JOIN book2 b ON b.part = p.part AND b.place = p.place
    GROUP BY p.vec_id, p.part, b.entry
),
near2 AS (
    SELECT vec_id, part, MIN(error) AS error, arg_min(entry, (error, entry)) AS entry
    FROM apart2 GROUP BY vec_id, part
),
mean2 AS (
    SELECT n.part, n.entry, p.place, SUM(p.x) AS total, COUNT(*) AS many
    FROM near2 n JOIN points p ON p.vec_id = n.vec_id AND p.part = n.part
    GROUP BY n.part, n.entry, p.place
),
book3 AS (
    SELECT b.part, b.entry, b.place,
           COALESCE(CAST((m.total - ((m.total % m.many + m.many) % m.many)) // m.many AS BIGINT), b.x) AS x
    FROM book2 b LEFT JOIN mean2 m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
),
apart3 AS (
    SELECT p.vec_id, p.part, b.entry, CAST(SUM((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS error
    FROM points p JOIN book3 b ON b.part = p.part AND b.place = p.place
    GROUP BY p.vec_id, p.part, b.entry
),
near3 AS (
    SELECT vec_id, part, MIN(error) AS error, arg_min(entry, (error, entry)) AS entry
    FROM apart3 GROUP BY vec_id, part
),
mean3 AS (
    SELECT n.part, n.entry, p.place, SUM(p.x) AS total, COUNT(*) AS many
    FROM near3 n JOIN points p ON p.vec_id = n.vec_id AND p.part = n.part
    GROUP BY n.part, n.entry, p.place
),
book4 AS (
    SELECT b.part, b.entry, b.place,
           COALESCE(CAST((m.total - ((m.total % m.many + m.many) % m.many)) // m.many AS BIGINT), b.x) AS x
    FROM book3 b LEFT JOIN mean3 m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
),
apart4 AS (
    SELECT p.vec_id, p.part, b.entry, CAST(SUM((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS error
    FROM points p JOIN book4 b ON b.part = p.part AND b.place = p.place
    GROUP BY p.vec_id, p.part, b.entry
),
near4 AS (
    SELECT vec_id, part, MIN(error) AS error, arg_min(entry, (error, entry)) AS entry
    FROM apart4 GROUP BY vec_id, part
),
coded AS (
    SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(SUM(error) AS BIGINT) AS error
    FROM near4 GROUP BY vec_id
),
labels AS (
    SELECT k.label, CAST(SUM(c.error) AS BIGINT) AS label_error FROM kept k JOIN coded c ON c.vec_id = k.vec_id GROUP BY k.label
)
SELECT k.vec_id, c.code, c.error, l.label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book4) AS codebooks_sha256
FROM kept k
JOIN coded c ON c.vec_id = k.vec_id
JOIN labels l ON l.label IS NOT DISTINCT FROM k.label
