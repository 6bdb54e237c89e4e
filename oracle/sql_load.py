from __future__ import annotations

from oracle.base import cte, statement

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


_EVENTS = """
  CASE strftime(dt, '%m-%d') WHEN '12-25' THEN 'Christmas' WHEN '01-01' THEN 'NewYear'
       WHEN '07-04' THEN 'IndependenceDay' END AS event_name_1,
  CASE WHEN strftime(dt, '%m-%d') IN ('12-25', '01-01', '07-04') THEN 'National' END AS event_type_1,
  CASE WHEN strftime(dt, '%m-%d') = '12-25' THEN 'WinterFeast' END AS event_name_2,
  CASE WHEN strftime(dt, '%m-%d') = '12-25' THEN 'Cultural' END AS event_type_2"""
cte("x_events", f"SELECT date_id, dt, {_EVENTS} FROM x_dates")

add("A01_read_calendar", f"""
SELECT CAST(dt AS VARCHAR) AS date, wm_yr_wk, weekday_name AS weekday, weekday_num AS wday, month, year,
       'd_' || date_id AS d, {_EVENTS},
       CAST(day(dt) <= 10 AS INTEGER) AS "snap_CA", CAST(day(dt) % 2 AS INTEGER) AS "snap_TX",
       CAST(day(dt) % 3 = 0 AS INTEGER) AS "snap_WI"
FROM x_dates""")
add("A02_read_sell_prices", """
SELECT store_id, product_id AS item_id, CAST(wm_yr_wk AS INTEGER) AS wm_yr_wk,
       CAST(price_cents AS DOUBLE) / 100 AS sell_price
FROM x_price JOIN x_product USING (product_surr_id) JOIN x_store USING (store_surr_id)""")
_IDS = """product_id || '_' || store_id AS id, product_id AS item_id, dept_id, category_id AS cat_id,
       store_id, state_id"""
add("A03_read_sales_meta", f"""
SELECT {_IDS} FROM x_series JOIN x_product USING (product_surr_id) JOIN x_store USING (store_surr_id)""")
add("A04_read_sales_wide", f"""
SELECT {_IDS}, CAST(count(*) AS INTEGER) AS n_days, CAST(sum(units_sold) AS BIGINT) AS units,
       CAST(max(CASE WHEN date_id = 1 THEN units_sold END) AS INTEGER) AS first_day_units,
       CAST(max(CASE WHEN date_id = (SELECT final_day FROM x_clock) THEN units_sold END) AS INTEGER) AS last_day_units
FROM x_daily JOIN x_product USING (product_surr_id) JOIN x_store USING (store_surr_id) GROUP BY ALL""")
add("A05_melt_sales_long", """
SELECT product_id || '_' || store_id AS id, product_id AS item_id, store_id, date_id AS day_index,
       CAST(units_sold AS INTEGER) AS units
FROM x_daily JOIN x_product USING (product_surr_id) JOIN x_store USING (store_surr_id)""")
add("A06_dim_category", "SELECT DISTINCT category_id, category_id AS category_name FROM x_product")
add("A07_dim_department", """
SELECT DISTINCT dept_id, dept_id AS dept_name, category_id, category_surr_id FROM x_product""")
add("A08_dim_store", "SELECT store_id, state_id, region_id, store_id AS store_name FROM x_store")
add("A09_dim_product", """
SELECT product_id, product_id AS item_id, dept_id, dept_surr_id, category_id, category_surr_id,
       product_id AS product_label FROM x_product""")
add("A10_assign_surrogate_keys", """
SELECT natural_key, CAST(row_number() OVER (ORDER BY natural_key) AS INTEGER) AS surrogate_key
FROM (SELECT p_name || '|' || p_type || '|' || p_partkey AS natural_key FROM part)""")
add("A11_dim_date", f"""
SELECT date_id, CAST(dt AS VARCHAR) AS calendar_date, date_id AS day_index, wm_yr_wk, week_id,
       weekday_num, weekday_name, weekday_name IN ('Saturday', 'Sunday') AS is_weekend, month,
       month_name, quarter, year, strftime(dt, '%m-%d') IN ('12-25', '01-01', '07-04') AS is_event_day,
       {_EVENTS}, day(dt) <= 10 AS snap_ca, day(dt) % 2 = 1 AS snap_tx, day(dt) % 3 = 0 AS snap_wi,
       date_id <= (SELECT max(date_id) FROM x_line) AS is_observed
FROM x_dates""")
add("A12_dim_event", """
SELECT CAST(dt AS VARCHAR) AS event_date, date_id, event_name_1 AS event_name,
       event_type_1 AS event_type, 1 AS event_ordinal FROM x_events WHERE event_name_1 IS NOT NULL
UNION ALL SELECT CAST(dt AS VARCHAR), date_id, event_name_2, event_type_2, 2
FROM x_events WHERE event_name_2 IS NOT NULL""")
add("A13_load_daily_sales", """
SELECT product_surr_id, store_surr_id, date_id, CAST(units_sold AS INTEGER) AS units_sold,
       'observed' AS demand_source FROM x_sparse""")
add("A14_load_weekly_price", """
SELECT product_surr_id, store_surr_id, CAST(wm_yr_wk AS INTEGER) AS wm_yr_wk,
       CAST(week_id AS INTEGER) AS week_id, CAST(price_cents AS DOUBLE) / 100 AS sell_price,
       'observed' AS data_provenance FROM x_price""")
cte("x_half_old", """
  SELECT product_surr_id, store_surr_id, CAST(sum(units_sold) AS BIGINT) AS units FROM x_sparse
  WHERE store_surr_id % 2 = 1 AND date_id <= (SELECT final_day FROM x_clock) // 2 GROUP BY ALL""")
cte("x_half_new", """
  SELECT product_surr_id, store_surr_id, CAST(sum(units_sold) AS BIGINT) AS units FROM x_sparse
  WHERE NOT (store_surr_id % 2 = 1 AND date_id <= (SELECT final_day FROM x_clock) // 2) GROUP BY ALL""")
add("A15_insert_if_absent", """
SELECT * FROM x_half_old UNION ALL SELECT * FROM x_half_new n WHERE NOT EXISTS (
  SELECT 1 FROM x_half_old o WHERE o.product_surr_id = n.product_surr_id
    AND o.store_surr_id = n.store_surr_id)""")
add("A16_upsert_by_key", """
SELECT * FROM x_half_new UNION ALL SELECT * FROM x_half_old n WHERE NOT EXISTS (
  SELECT 1 FROM x_half_new o WHERE o.product_surr_id = n.product_surr_id
    AND o.store_surr_id = n.store_surr_id)""")
add("A16_upsert_written_table", """
SELECT product_surr_id, store_surr_id,
       CAST(CASE WHEN store_surr_id % 3 = 0 AND count(*) FILTER (WHERE date_id <= last_day - 365) > 0
         THEN sum(units_sold) FILTER (WHERE date_id <= last_day - 365) ELSE sum(units_sold) END AS BIGINT) AS units
FROM x_sparse, (SELECT final_day AS last_day FROM x_clock) GROUP BY 1, 2""")
add("A17_replace_slice", """
SELECT product_surr_id, store_surr_id, date_id, year,
       CAST(units_sold * CASE WHEN year = (SELECT year FROM x_dates WHERE date_id = (SELECT final_day FROM x_clock) // 2)
         THEN 2 ELSE 1 END AS INTEGER) AS units_sold
FROM x_sparse JOIN x_dates USING (date_id)""")
add("A18_write_fact_parquet", """
SELECT product_surr_id, store_surr_id, CAST(sum(units_sold) AS DOUBLE) AS total_units,
       round(sum(units_sold) / CAST((SELECT final_day FROM x_clock) AS DOUBLE), 4) AS mean_daily_units,
       'derived' AS data_provenance, 1 AS etl_run_id FROM x_sparse GROUP BY 1, 2""")
add("A21_densify_series", """
SELECT product_surr_id, store_surr_id, date_id, CAST(units_sold AS INTEGER) AS units_sold FROM x_daily""")
add("A22_dim_week", "SELECT * FROM x_weeks")
add("A23_dimension_values", """
SELECT DISTINCT 'departments' AS dimension, dept_id AS value FROM x_product
UNION ALL SELECT DISTINCT 'categories', category_id FROM x_product
UNION ALL SELECT DISTINCT 'stores', store_id FROM x_store
UNION ALL SELECT DISTINCT 'states', state_id FROM x_store
UNION ALL SELECT DISTINCT 'regions', region_id FROM x_store""")
