SELECT o.offer_id, o.offer_name, 'BOOST_' || CAST(o.label_no AS VARCHAR) AS campaign_name, a.s AS campaign_start_date, a.e AS campaign_end_date,
  CAST(floor((a.e - DATE '1970-01-04') / 7.0) - floor((a.s - DATE '1970-01-04') / 7.0) AS INT) AS campaign_duration_weeks
FROM (SELECT offer_id, offer_name, dense_rank() OVER (ORDER BY offer_start_date) AS label_no FROM fx_offer
      WHERE is_current AND campaign_code = 'CAMP-1' AND lower(offer_status_description) IN ('active', 'expired') AND lower(offer_name) NOT LIKE '%test%') o
JOIN (SELECT offer_id, min(allocation_start) AS s, max(allocation_end) AS e FROM fx_allocation WHERE upper(allocation_status) = 'ACTIVE' GROUP BY offer_id) a ON a.offer_id = o.offer_id
