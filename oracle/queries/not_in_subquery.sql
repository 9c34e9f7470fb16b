SELECT scv_id, strategy_segment FROM fx_customer WHERE scv_id NOT IN (SELECT scv_id FROM fx_line WHERE is_online_order AND scv_id IS NOT NULL)
