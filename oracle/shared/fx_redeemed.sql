SELECT r.* FROM fx_reward r WHERE r.offer_id IN (SELECT offer_id FROM fx_config)
