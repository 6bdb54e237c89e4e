from __future__ import annotations

from oracle.base import cte, statement

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


_REV = "CAST(CAST(rev_cents AS DOUBLE) / 100 AS DOUBLE)"
_SUMS = "CAST(sum(units) AS BIGINT) AS units, CAST(sum(rev_cents) AS DOUBLE) / 100 AS revenue"

add("C01_weekly_sales", f"""
SELECT product_surr_id, store_surr_id, wm_yr_wk, week_id, units,
       CAST(price_cents AS DOUBLE) / 100 AS sell_price, {_REV} AS revenue FROM x_weekly""")
add("C02_v_weekly", f"""
SELECT product_surr_id, store_surr_id, wm_yr_wk, week_id, units,
       CAST(price_cents AS DOUBLE) / 100 AS sell_price, {_REV} AS revenue, product_id,
       category_surr_id, dept_surr_id, store_id, state_id, region_id, year, quarter, month, month_name
FROM x_wide""")
add("C03_v_units", """
SELECT date_id, product_surr_id, store_surr_id, CAST(units_sold AS INTEGER) AS units_sold
FROM x_sparse""")
add("C04_v_revenue", f"""
SELECT wm_yr_wk, {_SUMS}, count(*) FILTER (rev_cents IS NOT NULL) AS priced_weeks,
       count(*) FILTER (rev_cents IS NULL) AS unpriced_weeks,
       count(*) FILTER (rev_cents IS NULL AND units > 0) AS unpriced_units_weeks
FROM x_weekly GROUP BY wm_yr_wk""")
add("C05_v_price_weekly", """
SELECT wm_yr_wk, round(CAST(sum(price_cents) AS DOUBLE) / count(price_cents) / 100, 4) AS avg_sell_price,
       round(CAST(sum(rev_cents) AS DOUBLE) / 100 / nullif(sum(units), 0), 4) AS weighted_price
FROM x_weekly GROUP BY wm_yr_wk""")
cte("x_week_totals", """
  SELECT wm_yr_wk, CAST(sum(units) AS BIGINT) AS units, CAST(sum(rev_cents) AS DOUBLE) / 100 AS revenue
  FROM x_weekly GROUP BY wm_yr_wk""")


def _lag(order: str, prefix: str) -> str:
    return ", ".join(
        f"round((CAST({c} AS DOUBLE) / nullif(lag({c}) OVER (ORDER BY {order}), 0) - 1) * 100, 2)"
        f" AS {prefix}_{c}_pct"
        for c in ("units", "revenue")
    )


add("C06_v_growth_wow", f"""
SELECT w.wm_yr_wk, w.week_id, t.units, t.revenue, {_lag('w.week_id', 'wow')}
FROM x_weeks w LEFT JOIN x_week_totals t USING (wm_yr_wk)""")
cte("x_quarters", """
  SELECT year, quarter, CAST(sum(units) AS BIGINT) AS units, CAST(sum(rev_cents) AS DOUBLE) / 100 AS revenue
  FROM x_weekly JOIN x_weeks USING (wm_yr_wk) GROUP BY year, quarter""")
cte("x_years", """
  SELECT year, CAST(sum(units) AS BIGINT) AS units, CAST(sum(rev_cents) AS DOUBLE) / 100 AS revenue
  FROM x_weekly JOIN x_weeks USING (wm_yr_wk) GROUP BY year""")
add("C07_v_growth_qoq", f"SELECT *, {_lag('year, quarter', 'qoq')} FROM x_quarters")
add("C08_v_growth_yoy", f"SELECT *, {_lag('year', 'yoy')} FROM x_years")
add("C09_product_contribution", """
SELECT product_surr_id, product_id, units, CAST(rev AS DOUBLE) / 100 AS revenue,
       round(CAST(rev AS DOUBLE) / sum(rev) OVER () * 100, 4) AS revenue_share_pct,
       round(CAST(sum(rev) OVER (ORDER BY rev DESC, product_surr_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / sum(rev) OVER () * 100, 4) AS cumulative_share_pct,
       CAST(row_number() OVER (ORDER BY rev DESC, product_surr_id) AS INTEGER) AS rank
FROM (SELECT product_surr_id, product_id, CAST(sum(units) AS BIGINT) AS units, sum(rev_cents) AS rev
      FROM x_wide GROUP BY ALL)""")


def _share(keys: str) -> str:
    return f"""
SELECT {keys}, {_SUMS}, round(CAST(sum(rev_cents) AS DOUBLE) / (SELECT sum(rev_cents) FROM x_wide) * 100, 4)
       AS revenue_share_pct FROM x_wide GROUP BY {keys}"""


add("C10_department_contribution", _share("dept_surr_id, category_surr_id"))
add("C11_category_contribution", _share("category_surr_id"))
add("C12_store_contribution", _share("store_surr_id, store_id, state_id, region_id"))
add("C13_state_contribution", _share("state_id"))
_COLS = "dept_surr_id, category_surr_id, store_surr_id, store_id, state_id, region_id"
add("C13_all_level_contributions", f"""
SELECT CASE WHEN grouping(dept_surr_id) = 0 THEN 'department'
            WHEN grouping(category_surr_id) = 0 THEN 'category'
            WHEN grouping(store_surr_id) = 0 THEN 'store' ELSE 'state' END AS level,
       {_COLS}, {_SUMS},
       round(CAST(sum(rev_cents) AS DOUBLE) / (SELECT sum(rev_cents) FROM x_wide) * 100, 4)
       AS revenue_share_pct FROM x_wide
GROUP BY GROUPING SETS ((dept_surr_id, category_surr_id), (category_surr_id),
  (store_surr_id, store_id, state_id, region_id), (state_id))""")
add("C14_rollup_daily", """
SELECT date_id, CAST(dt AS VARCHAR) AS calendar_date, wm_yr_wk, product_surr_id, store_surr_id,
       CAST(units_sold AS INTEGER) AS units_sold FROM x_sparse JOIN x_dates USING (date_id)""")
add("C15_rollup_weekly", f"SELECT wm_yr_wk, {_SUMS} FROM x_weekly GROUP BY wm_yr_wk")
add("C16_rollup_monthly", f"SELECT year, month, {_SUMS} FROM x_wide GROUP BY year, month")
add("C17_rollup_product_hierarchy", f"""
SELECT p.product_surr_id, product_id, dept_surr_id, category_surr_id, {_SUMS}
FROM x_product p LEFT JOIN x_weekly m USING (product_surr_id) GROUP BY ALL""")
add("C18_rollup_store_hierarchy", f"""
SELECT s.store_surr_id, store_id, state_id, region_id, {_SUMS}
FROM x_store s LEFT JOIN x_weekly m USING (store_surr_id) GROUP BY ALL""")


def _latest(table: str, order: str, col: str) -> str:
    return f"""(SELECT round((max(CASE WHEN r = 1 THEN CAST({col} AS DOUBLE) END)
      / nullif(max(CASE WHEN r = 2 THEN {col} END), 0) - 1) * 100, 2)
      FROM (SELECT {col}, row_number() OVER (ORDER BY {order}) AS r FROM {table}))"""


add("C19_headline_kpis", f"""
SELECT round(sum(revenue)) AS total_revenue, CAST(sum(units) AS BIGINT) AS total_units,
       round(round(sum(revenue)) / sum(units), 2) AS weighted_price,
       {_latest('x_week_totals', 'wm_yr_wk DESC', 'revenue')} AS revenue_wow_pct,
       {_latest('x_week_totals', 'wm_yr_wk DESC', 'units')} AS units_wow_pct,
       {_latest('x_quarters', 'year DESC, quarter DESC', 'revenue')} AS revenue_qoq_pct,
       {_latest('x_years', 'year DESC', 'revenue')} AS revenue_yoy_pct,
       {_latest('x_years', 'year DESC', 'units')} AS units_yoy_pct
FROM x_week_totals""")
add("C20_revenue_trend_12w", "SELECT * FROM x_week_totals ORDER BY wm_yr_wk DESC LIMIT 12")
cte("x_cut", "SELECT * FROM x_wide WHERE category_id = 'C1' AND region_id = 'West'")


def _best(level: str, col: str) -> str:
    return f"""
SELECT '{level}' AS level, {col} AS entity, CAST(sum(rev_cents) AS DOUBLE) / 100 AS revenue,
       round(CAST(sum(rev_cents) AS DOUBLE) / (SELECT sum(rev_cents) FROM x_cut) * 100, 4) AS share_pct,
       CAST(row_number() OVER (ORDER BY sum(rev_cents) DESC, {col}) AS INTEGER) AS rank
FROM x_cut GROUP BY {col}"""


add("C21_contributions_topn", f"""
SELECT * FROM ({_best('product', 'product_id')} UNION ALL {_best('department', 'dept_id')}
UNION ALL {_best('state', 'state_id')}) WHERE rank <= 10""")
add("C23_m_totals_and_price", """
SELECT category_surr_id, region_id, CAST(sum(rev_cents) AS DOUBLE) / 100 AS total_revenue,
       CAST(sum(units) AS BIGINT) AS total_units,
       round(CAST(sum(rev_cents) AS DOUBLE) / 100 / nullif(sum(units), 0), 4) AS weighted_price
FROM x_wide GROUP BY category_surr_id, region_id""")


def _base(col: str, order: str) -> str:
    lag = f"max({col}) OVER (ORDER BY {order} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN {lag} > 0 THEN round((CAST({col} AS DOUBLE) / {lag} - 1) * 100, 2) END"


add("C24_m_growth", f"""
SELECT 'week' AS period, wm_yr_wk AS period_key, {_base('revenue', 'wm_yr_wk')} AS revenue_pct,
       {_base('units', 'wm_yr_wk')} AS units_pct FROM x_week_totals
UNION ALL SELECT 'quarter', year * 10 + quarter, {_base('revenue', 'year * 4 + quarter')}, NULL FROM x_quarters
UNION ALL SELECT 'year', year, {_base('revenue', 'year')}, {_base('units', 'year')} FROM x_years""")
add("C25_m_shares", """
SELECT product_surr_id, product_id, CAST(rev AS DOUBLE) / 100 AS revenue,
       round(CAST(rev AS DOUBLE) / sum(rev) OVER () * 100, 4) AS product_share_pct,
       round(CAST(sum(rev) OVER (ORDER BY rev DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS DOUBLE) / sum(rev) OVER () * 100, 4) AS cumulative_share_pct
FROM (SELECT product_surr_id, product_id, sum(rev_cents) AS rev FROM x_wide GROUP BY ALL)
WHERE rev IS NOT NULL""")
add("C25_m_entity_share", """
SELECT product_surr_id, state_id, CAST(sum(rev_cents) AS DOUBLE) / 100 AS revenue,
       round(CAST(sum(rev_cents) AS DOUBLE) / sum(sum(rev_cents)) OVER (PARTITION BY state_id) * 100, 4)
       AS entity_share_pct FROM x_wide GROUP BY product_surr_id, state_id""")
