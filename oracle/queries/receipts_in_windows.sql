SELECT c.offer_id, count(*) AS receipts, count(h.scv_id) AS receipts_with_id, round(SUM(h.gst_included_amount), 4) AS sales
FROM fx_header h JOIN fx_config c ON h.receipt_date BETWEEN c.long_start_date AND c.post_end_date GROUP BY c.offer_id
