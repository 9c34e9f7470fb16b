SELECT offer_id, count(DISTINCT scv_id) AS total_activations FROM fx_activation WHERE offer_id IN (SELECT offer_id FROM fx_config) GROUP BY offer_id
