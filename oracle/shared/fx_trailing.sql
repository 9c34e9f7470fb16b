SELECT p.article_id, p.store_id, p.unit_of_measure, SUM(gst_excluded_amount) AS trailing_sales FROM fx_pos p JOIN fx_uom u ON u.article_id = p.article_id AND u.unit_of_measure = p.unit_of_measure
WHERE financial_week_end_date BETWEEN DATE '2001-07-29' - 84 AND DATE '2001-07-29' GROUP BY p.article_id, p.store_id, p.unit_of_measure
