SELECT start_time + INTERVAL 13 HOURS AS start_date, user_email, statement_type, total_slot_ms, table_id FROM fx_job WHERE table_id = 'table_3'
