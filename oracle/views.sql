-- view fx_dim_date
SELECT DATE '1995-01-01' + n AS date, strftime(DATE '1995-01-01' + n, '%Y%m%d') AS date_key,
  CAST(year(DATE '1995-01-01' + n) AS INT) AS calendar_year,
  CAST(1995 + floor((n + 183) / 365.25) AS INT) AS financial_year,
  CAST(1 + floor((n + 183 - 365.25 * floor((n + 183) / 365.25)) / 7) AS INT) AS week_of_financial_year,
  CAST(100 * CAST(1995 + floor((n + 183) / 365.25) AS INT) + CAST(1 + floor((n + 183 - 365.25 * floor((n + 183) / 365.25)) / 7) AS INT) AS INT) AS financial_period_week,
  DATE '1995-01-02' + CAST(7 * floor((n - 1) / 7.0) AS INT) AS financial_week_start_date,
  DATE '1995-01-08' + CAST(7 * floor((n - 1) / 7.0) AS INT) AS financial_week_end_date,
  CAST(1000 + floor((n - 1) / 7.0) AS INT) AS pel_week,
  CASE WHEN month(DATE '1995-01-01' + n) = 12 AND day(DATE '1995-01-01' + n) = 25 THEN 'Christmas Day' END AS holiday_name
FROM (SELECT CAST(range AS INT) AS n FROM range(2557)) q
-- view fx_line
SELECT CAST(l_orderkey AS VARCHAR) AS receipt_id, CAST(l_partkey AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS store_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS scv_id,
  o_orderstatus = 'O' AS is_online_order, o_orderkey % 5 <> 0 AS is_online_order_completed,
  CASE WHEN o_orderstatus = 'O' THEN 'C' || CAST(l_orderkey AS VARCHAR) ELSE '' END AS commercial_id,
  CAST(o_orderdate AS DATE) AS receipt_date, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) AS online_order_date,
  l_extendedprice AS gst_included_amount, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price_paid,
  l_returnflag, l_linestatus, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
-- view fx_header
SELECT receipt_id, commercial_id, scv_id, receipt_date, is_online_order, SUM(gst_included_amount) AS gst_included_amount, SUM(quantity) AS quantity
FROM fx_line GROUP BY ALL
-- view fx_offer
SELECT CAST(r_regionkey AS VARCHAR) AS offer_id, 'SKU|' || r_name || '|x' AS offer_name, 'CAMP-1' AS campaign_code,
  DATE '1997-01-06' + CAST(168 * r_regionkey AS INT) AS offer_start_date,
  CASE WHEN r_regionkey < 3 THEN 'Expired' ELSE 'Active' END AS offer_status_description, TRUE AS is_current FROM region
-- view fx_allocation
SELECT CAST(n_regionkey AS VARCHAR) AS offer_id, CAST(c_custkey AS VARCHAR) AS scv_id,
  DATE '1997-01-06' + CAST(168 * n_regionkey + c_custkey % 3 AS INT) AS allocation_start,
  DATE '1997-01-06' + CAST(168 * n_regionkey + 83 AS INT) AS allocation_end,
  CASE WHEN c_custkey % 10 = 9 THEN 'Inactive' ELSE 'Active' END AS allocation_status
FROM customer JOIN nation ON c_nationkey = n_nationkey
-- view fx_brand_article
SELECT CAST(p_partkey % 5 AS VARCHAR) AS offer_id, p_type AS brand, CAST(p_partkey AS VARCHAR) AS article_id, p_name AS article_description FROM part
-- view fx_reward
SELECT a.offer_id, l.scv_id, l.receipt_id, l.article_id, l.store_id, l.receipt_date AS redemption_date, l.quantity,
  l.quantity AS base_points_earn, l.quantity * 100 AS bonus_points_earn, l.quantity * 2 AS reward_value, l.gst_included_amount AS total_item_sales_amount
FROM fx_line l JOIN fx_brand_article a ON l.article_id = a.article_id JOIN fx_offer o ON o.offer_id = a.offer_id
WHERE l.l_returnflag = 'R' AND l.scv_id <> '' AND l.receipt_date BETWEEN o.offer_start_date AND o.offer_start_date + 83
-- view fx_activation
SELECT CAST(c_custkey AS VARCHAR) AS scv_id, CAST(n_regionkey AS VARCHAR) AS offer_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
-- view fx_customer
SELECT CAST(c_custkey AS VARCHAR) AS scv_id, NULLIF(c_mktsegment, 'MACHINERY') AS segment_group,
  CASE c_custkey % 3 WHEN 0 THEN 'PROTECT' WHEN 1 THEN 'GROW' ELSE 'OTHER' END AS strategy_segment,
  CAST(c_custkey % 100 AS VARCHAR) AS preferred_store_id, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 100 AS VARCHAR) END AS main_store_id,
  CASE WHEN c_custkey % 8 = 0 THEN 'Closed' ELSE 'Active' END AS customer_status, TRUE AS is_current, FALSE AS is_deleted,
  c_custkey % 6 <> 0 AS is_valid_email, TIMESTAMP '2001-08-02 13:00:00' - to_days(CAST(c_custkey % 365 AS INT)) AS created_at
FROM customer
-- view fx_preference
SELECT CAST(c_custkey AS VARCHAR) AS scv_id, c_custkey % 4 <> 0 AS allow_all, c_custkey % 5 <> 0 AS allow_partner FROM customer
-- view fx_feature_history
SELECT a.scv_id, a.allocation_start AS at_date, c.segment_group FROM fx_allocation a JOIN fx_customer c ON a.scv_id = c.scv_id
-- view fx_risk
SELECT CAST(c_custkey AS VARCHAR) AS scv_id, CASE WHEN c_acctbal < 0 THEN 'Risk' ELSE 'Stable' END AS cohort FROM customer
-- view fx_partner
SELECT CAST(n_nationkey AS VARCHAR) AS partner_id, n_name || '_NZ' AS partner_name FROM nation
-- view fx_partner_txn
SELECT CASE WHEN l_linestatus = 'F' THEN 'fuel' ELSE 'shop' END AS source, scv_id, CAST(l_linenumber AS VARCHAR) AS partner_id, receipt_id,
  CASE l_returnflag WHEN 'A' THEN 'Base' WHEN 'R' THEN 'Bonus' ELSE 'cpl discount' END AS redemption_type, l_linenumber = 5 AS behaviour_offer,
  receipt_date AS txn_date, quantity AS base_points, quantity * 10 AS bonus_points, gst_included_amount AS sales, quantity, gst_included_amount * 0.05 AS discount
FROM fx_line WHERE scv_id <> ''
-- view fx_seed
SELECT 'seed-' || CAST(s_suppkey AS VARCHAR) AS scv_id, CASE WHEN s_acctbal > 0 THEN 'Partner Seed List' ELSE 'Other' END AS list_source,
  CAST(s_nationkey % 3 AS VARCHAR) AS partner_id FROM supplier
-- view fx_site
SELECT CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS site_name, CASE WHEN s_suppkey % 2 = 0 THEN 'STORE' ELSE 'FUEL' END AS site_type,
  -36.5 - CAST(s_suppkey % 97 AS DOUBLE) / 25 AS lat, 174.0 + CAST(s_suppkey % 89 AS DOUBLE) / 25 AS lon FROM supplier
-- view fx_store
SELECT CAST(s_suppkey AS VARCHAR) AS store_id,
  CASE WHEN s_nationkey < 8 THEN 'GreenCart ' WHEN s_nationkey < 14 THEN 'ValueBarn ' WHEN s_nationkey < 16 THEN 'Test GreenCart ' ELSE 'Mainway ' END || CAST(s_suppkey AS VARCHAR) AS store_name,
  CASE WHEN s_nationkey < 12 THEN 'UPPER' ELSE 'LOWER' END AS district_id, s_acctbal < 0 AS is_metro_store, s_acctbal > 9000 AS is_neighbourhood_store,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey % 17 = 0 END AS is_online_store,
  CASE WHEN s_nationkey < 8 THEN 'GreenCart' WHEN s_nationkey < 14 THEN 'ValueBarn' WHEN s_nationkey < 16 THEN 'Test' ELSE 'Mainway' END AS store_brand, s_suppkey % 19 <> 0 AS is_current FROM supplier
-- view fx_article
SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name AS article_name, p_brand AS online_brand, p_type AS department, p_brand AS category,
  p_name AS sub_category, upper(p_name) AS segment, CAST(p_partkey % 40 AS VARCHAR) AS price_family_id, 'Family ' || CAST(p_partkey % 40 AS VARCHAR) AS price_family_name,
  CASE WHEN p_partkey % 9 <> 0 THEN 'Manager ' || CAST(p_partkey % 6 AS VARCHAR) END AS category_manager, CASE WHEN p_partkey % 7 <> 0 THEN 'V' || CAST(p_partkey % 7 AS VARCHAR) END AS vendor_description,
  CASE WHEN p_partkey % 4 = 0 THEN 'Y' ELSE 'N' END AS own_brand, p_partkey % 23 <> 0 AS is_current, p_size AS article_size FROM part
-- view fx_uom
SELECT CAST(p_partkey AS VARCHAR) AS article_id, 'EA' AS unit_of_measure, 1 AS pack_size, TRUE AS is_current FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'CT', p_size, p_partkey % 29 <> 0 FROM part WHERE p_size >= 20
-- view fx_article_vendor
SELECT CAST(p_partkey AS VARCHAR) AS article_id, CAST(p_partkey % 7 AS VARCHAR) AS vendor_id,
  CASE WHEN p_partkey % 7 <> 0 THEN 'V' || CAST(p_partkey % 7 AS VARCHAR) END AS vendor_description, CASE WHEN p_partkey % 4 = 0 THEN 'Y' ELSE 'N' END AS own_brand FROM part WHERE p_size > 2
-- view fx_article_site
SELECT CAST(l_partkey AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS vendor_code, s_name AS vendor_description, CAST(l_shipdate AS DATE) AS valid_to,
  CASE WHEN l_suppkey % 2 = 0 THEN 'ORG1' ELSE 'ORG2' END AS sales_org FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
-- view fx_price
SELECT CAST(l_partkey AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS site, CASE WHEN l_linenumber = 7 THEN 'CT' ELSE 'EA' END AS unit_of_measure,
  p_retailprice + CAST(l_suppkey % 3 AS DOUBLE) / 2 AS sell_price, CAST(l_shipdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) + 90 AS valid_to,
  CASE WHEN l_suppkey % 2 = 0 THEN 'ORG1' ELSE 'ORG2' END AS sales_org,
  CASE WHEN l_tax < 0.02 THEN NULL ELSE l_extendedprice / l_quantity END AS purchase_cost, p_brand AS category, 'List ' || CAST(l_suppkey % 5 AS VARCHAR) AS price_list,
  CASE WHEN l_linenumber < 6 THEN 'Ranged' WHEN l_linenumber = 6 THEN 'Deleted' END AS life_cycle_status, CAST(l_shipdate AS DATE) - 10 AS life_cycle_date
FROM lineitem JOIN part ON l_partkey = p_partkey
-- view fx_store_article
SELECT l.article_id, l.store_id, p_brand AS category, d.financial_week_end_date, CASE WHEN l_linenumber = 7 THEN 'CT' ELSE 'EA' END AS unit_of_measure,
  p_retailprice + CAST(CAST(l.store_id AS INT) % 3 AS DOUBLE) / 2 AS shelf_price,
  CASE WHEN CAST(l.store_id AS INT) % 4 <> 0 THEN p_retailprice + CAST(CAST(l.store_id AS INT) % 3 AS DOUBLE) / 2 + 1 END AS standard_price, p_retailprice AS retail_price,
  l_returnflag = 'A' AS is_clearance, l_linenumber = 2 AS is_multibuy, l_linestatus = 'O' AS is_great_price, is_online_order_completed AS is_ranged,
  l_linenumber = 1 AS is_new, CASE WHEN CAST(l.store_id AS INT) % 11 <> 0 THEN CAST(l.store_id AS INT) % 12 <> 0 END AS is_store_active, gst_included_amount AS weekly_sales
FROM fx_line l JOIN part ON l.article_id = CAST(p_partkey AS VARCHAR) JOIN fx_dim_date d ON d.date = l.receipt_date
-- view fx_purchase
SELECT CAST(l_partkey AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_suppkey % 4 AS VARCHAR) AS sourcing_dc, 'Centre ' || CAST(l_suppkey % 4 AS VARCHAR) AS sourcing_dc_name, CAST(l_shipdate AS DATE) AS invoice_date,
  l_extendedprice AS cost_charge, l_extendedprice * (1 - l_discount) AS base_cost, l_quantity AS multiple_despatched, l_linenumber AS order_multiple FROM lineitem
-- view fx_profit
SELECT l.article_id, p_type AS department, p_brand AS segment, receipt_date AS calendar_day, CASE WHEN CAST(l.store_id AS INT) % 2 = 0 THEN 'ORG1' ELSE 'ORG2' END AS sales_org,
  'Range ' || CAST(p_size // 10 AS VARCHAR) AS category, split_part(p_name, ' ', -1) AS sub_category,
  gst_included_amount * 0.25 AS trading_gp, quantity * 0.125 AS dumps, quantity * 0.5 AS stock_loss, gst_included_amount * 0.06 AS markdowns, gst_included_amount * 0.69 AS cogs,
  gst_included_amount AS sales, gst_included_amount * 0.3 AS interim_gp, gst_included_amount * 0.01 AS manual_claims, quantity
FROM fx_line l JOIN part ON l.article_id = CAST(p_partkey AS VARCHAR) WHERE l_returnflag <> 'R'
-- view fx_market
SELECT d.financial_week_start_date AS week_start, CASE WHEN p_partkey % 11 <> 0 THEN l.article_id END AS product_ref,
  p_name || ' ' || CAST(p_partkey % 2 AS VARCHAR) || CASE WHEN l_linenumber = 3 THEN ' alt' ELSE '' END AS product_description, p_type AS department, p_brand AS segment,
  'Range ' || CAST(p_size // 10 AS VARCHAR) AS category, split_part(p_name, ' ', -1) AS sub_category,
  CASE CAST(l.store_id AS INT) % 4 WHEN 0 THEN 'Total' WHEN 1 THEN 'Competitor' WHEN 2 THEN 'Own' ELSE 'Franchise' END AS market,
  gst_included_amount AS value_excl_tax, quantity AS units
FROM fx_line l JOIN part ON l.article_id = CAST(p_partkey AS VARCHAR) JOIN fx_dim_date d ON d.date = l.receipt_date
-- view fx_plan
SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_size AS start_week, CAST(p_size + p_partkey % 4 - 1 AS INT) AS finish_week, p_retailprice AS ty_purchase,
  p_retailprice * 0.9 AS ly_purchase FROM part
-- view fx_kpi
SELECT r.offer_id, o.offer_name, CASE WHEN r.offer_id IN ('1', '4') THEN 'basket offer' ELSE 'product offer' END AS offer_type,
  CASE WHEN r.quantity > 25 THEN 'mass' ELSE 'targeted' END AS offer_target_type, CASE WHEN CAST(r.store_id AS INT) % 2 = 0 THEN 'single' ELSE 'multi' END AS product_offer_type,
  d.pel_week, r.quantity AS offer_redeemed_count, r.bonus_points_earn, o.offer_start_date, CASE WHEN r.quantity = 50 THEN 'Invalid' ELSE r.scv_id END AS allocated_scv_id,
  CASE WHEN r.quantity > 1 THEN CAST(floor((r.redemption_date - o.offer_start_date) / 7.0) AS INT) END AS week_number
FROM fx_reward r JOIN fx_offer o ON r.offer_id = o.offer_id JOIN fx_dim_date d ON d.date = r.redemption_date
-- view fx_send
SELECT 'mail ' || CAST(event_id % 7 AS VARCHAR) AS email_name, CAST(event_id % 7 AS VARCHAR) AS job_id FROM events WHERE event_type = 'signup'
-- view fx_communication
SELECT CAST(event_id % 5 AS VARCHAR) AS send_id FROM events WHERE event_type = 'view'
-- view fx_click
SELECT CAST(user_id AS VARCHAR) AS scv_id, CAST(event_id % 7 AS VARCHAR) AS send_id, CASE WHEN value < 2 THEN 'UnSubscribe link' ELSE 'Shop now' END AS alias
FROM events WHERE event_type IN ('click', 'purchase')
-- view fx_job
SELECT ts AS start_time, CAST(user_id AS VARCHAR) AS user_email, event_type AS statement_type, value AS total_slot_ms, 'table_' || CAST(event_id % 9 AS VARCHAR) AS table_id FROM events
-- view fx_pos
SELECT l.article_id, l.store_id, l.receipt_id, p_brand AS category, l.receipt_date, strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(l.receipt_id AS BIGINT) * 7919 % 86400), '%H:%M:%S') AS receipt_time, d.financial_week_end_date, l.is_online_order,
  CASE WHEN l_linenumber = 7 THEN 'CT' ELSE 'EA' END AS unit_of_measure, CASE WHEN l_linenumber = 6 THEN 'R1' ELSE '' END AS return_reason_id, l.unit_price_paid,
  p_retailprice AS retail_price, l.gst_included_amount * 0.1 AS total_discount, l.gst_included_amount / 1.15 AS gst_excluded_amount, l.quantity
FROM fx_line l JOIN part ON l.article_id = CAST(p_partkey AS VARCHAR) JOIN fx_dim_date d ON d.date = l.receipt_date
-- view fx_family
SELECT CAST(n_nationkey AS VARCHAR) AS price_family_id, CASE WHEN n_regionkey < 3 THEN 'Y' END AS primary_line FROM nation
-- view fx_promise
SELECT CAST(l_partkey AS VARCHAR) AS article_id, 'Y' AS price_promise FROM lineitem WHERE l_discount > 0.09
