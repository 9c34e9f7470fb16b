WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html
  FROM pages
), rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, h, q)
), best AS (
  SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS ruled
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id, host, path
), seeds AS (
  SELECT host, count(*) FILTER (ruled = 'allow')::DOUBLE AS ts, count(*) FILTER (ruled = 'block')::DOUBLE AS ds FROM best GROUP BY host
), raw AS (
  SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM p WHERE host <> ''
), pairs AS (SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst GROUP BY src, dst
), w AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS ahead, n / sum(n) OVER (PARTITION BY dst) AS back FROM pairs
), nodes AS (
  SELECT h.host, coalesce(ts, 0) AS ts, coalesce(ds, 0) AS ds
  FROM (SELECT host FROM seeds UNION SELECT src FROM pairs UNION SELECT dst FROM pairs) h LEFT JOIN seeds USING (host)
), r0 AS (SELECT host, ts, ds, ts AS t, ds AS d FROM nodes
), r1 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r0 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r0 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r0 r
), r2 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r1 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r1 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r1 r
), r3 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r2 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r2 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r2 r
), r4 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r3 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r3 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r3 r
), r5 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r4 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r4 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r4 r
), r6 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r5 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r5 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r5 r
), r7 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r6 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r6 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r6 r
), r8 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r7 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r7 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r7 r
), r9 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r8 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r8 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r8 r
), r10 AS (
  SELECT r.host, r.ts, r.ds,
         0.15 * r.ts + 0.85 * coalesce((SELECT sum(q.t * w.ahead) FROM w JOIN r9 q ON q.host = w.src WHERE w.dst = r.host), 0) AS t,
         0.15 * r.ds + 0.85 * coalesce((SELECT sum(q.d * w.back) FROM w JOIN r9 q ON q.host = w.dst WHERE w.src = r.host), 0) AS d
  FROM r9 r
)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.ruled, CASE WHEN r.d > 2 * r.t THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) LEFT JOIN r10 r ON r.host = p.host
