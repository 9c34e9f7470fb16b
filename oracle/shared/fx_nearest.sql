SELECT store_id, lat, lon, site_id, site_name, km AS distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY km, site_id) AS rn FROM (
    SELECT a.site_id AS store_id, a.lat, a.lon, b.site_id, b.site_name,
      round(2 * 6371.01 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) AS km
    FROM fx_site a JOIN fx_site b ON a.site_type = 'STORE' AND b.site_type = 'FUEL') q) r WHERE rn = 1
