SELECT DISTINCT scv_id FROM fx_click WHERE lower(alias) LIKE '%unsubscribe%' AND send_id IN (SELECT job_id FROM fx_send WHERE job_id IN (SELECT send_id FROM fx_communication))
