SELECT a.event_id AS signup_id, b.event_id, b.user_id, b.value FROM events a JOIN events b
  ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 36 HOURS
WHERE a.event_type = 'signup' AND b.event_type <> 'signup'
