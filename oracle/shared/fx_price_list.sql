SELECT sales_org, site, article_id, unit_of_measure, sell_price AS rrp, valid_from, valid_to, price_list, life_cycle_status, life_cycle_date FROM (
  SELECT *, row_number() OVER (PARTITION BY sales_org, site, article_id ORDER BY valid_to DESC, valid_from DESC, sell_price DESC, unit_of_measure DESC, price_list DESC, life_cycle_status DESC NULLS LAST, life_cycle_date DESC) AS rn FROM fx_price
  WHERE purchase_cost IS NOT NULL AND sales_org IN ('ORG1', 'ORG3')
    AND site IN (SELECT store_id FROM fx_store WHERE (store_name LIKE '%GreenCart%' OR store_name LIKE 'ValueBarn%') AND store_name NOT LIKE '%Test%')) q WHERE rn = 1
