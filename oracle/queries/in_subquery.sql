SELECT scv_id, strategy_segment FROM fx_customer WHERE scv_id IN (SELECT scv_id FROM fx_reward)
