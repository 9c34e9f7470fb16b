WITH a AS (SELECT DISTINCT product_description AS t FROM fx_market WHERE product_ref IS NULL), b AS (SELECT DISTINCT product_description AS t FROM fx_market WHERE product_ref IS NOT NULL)
SELECT a.t AS left_text, b.t AS right_text, CAST(levenshtein(a.t, b.t) AS INT) AS distance FROM a JOIN b ON levenshtein(a.t, b.t) <= 2
