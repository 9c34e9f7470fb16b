SELECT * REPLACE (round(lat, 4) AS lat, round(lon, 4) AS lon, round(distance_km, 4) AS distance_km) FROM fx_nearest
