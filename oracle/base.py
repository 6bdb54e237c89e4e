"""Named sub-selects and the function that puts the needed ones in front."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needed(sql: str, seen: list[str]) -> None:
    for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", sql)):
        if word in CTES and word not in seen:
            body = CTES[word]
            inner = re.sub(rf"\b{word}\b", " ", body)  # a recursive one names itself
            _needed(inner, seen)
            if word not in seen:
                seen.append(word)


def statement(sql: str) -> str:
    seen: list[str] = []
    _needed(sql, seen)
    if not seen:
        return sql
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in seen)
    return f"WITH RECURSIVE {parts}\n{sql}"


def mean(column: str, stored: int = 4, places: int = 6) -> str:
    """Mean of values stored with a number of places, from exact whole-number sums."""
    whole = f"sum(CAST(round({column} * {10 ** stored}) AS BIGINT))"
    return f"round(CAST({whole} * {10 ** (places - stored)} AS DOUBLE) / count({column})) / {10 ** places}.0"


# -- source binding ----------------------------------------------------------------
# Day 1 is the Monday of the first ship date, the last ship date ends the history.
cte("x_clock", """
  SELECT CAST(date_trunc('week', min(l_shipdate)) AS DATE) AS origin,
         date_diff('day', CAST(date_trunc('week', min(l_shipdate)) AS DATE), CAST(max(l_shipdate) AS DATE)) + 1 AS final_day
  FROM lineitem""")
cte("x_line", """
  SELECT CAST(substr(p_brand, 7) AS INTEGER) AS product_surr_id,
         s_nationkey + 1 AS store_surr_id,
         date_diff('day', (SELECT origin FROM x_clock), CAST(l_shipdate AS DATE)) + 1 AS date_id,
         CAST(l_quantity AS BIGINT) AS qty,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
cte("x_sparse", """
  SELECT product_surr_id, store_surr_id, CAST(date_id AS INTEGER) AS date_id,
         CAST(SUM(qty) AS BIGINT) AS units_sold, CAST(SUM(cents) AS BIGINT) AS cents
  FROM x_line GROUP BY ALL""")
cte("x_series", "SELECT DISTINCT product_surr_id, store_surr_id FROM x_sparse")
cte("x_daily", """
  SELECT s.product_surr_id, s.store_surr_id, CAST(d.n AS INTEGER) AS date_id,
         COALESCE(f.units_sold, 0) AS units_sold
  FROM x_series s CROSS JOIN (SELECT unnest(range(1, (SELECT final_day FROM x_clock) + 1)) AS n) d
  LEFT JOIN x_sparse f ON f.product_surr_id = s.product_surr_id
    AND f.store_surr_id = s.store_surr_id AND f.date_id = d.n""")
cte("x_product", """
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS product_surr_id, p_brand AS product_id,
         'D' || (CAST(substr(p_brand, 7) AS INTEGER) % 7) AS dept_id,
         CAST(substr(p_brand, 7) AS INTEGER) % 7 + 1 AS dept_surr_id,
         'C' || ((CAST(substr(p_brand, 7) AS INTEGER) % 7) % 3) AS category_id,
         (CAST(substr(p_brand, 7) AS INTEGER) % 7) % 3 + 1 AS category_surr_id
  FROM part""")
cte("x_store", """
  SELECT n_nationkey + 1 AS store_surr_id, n_name AS store_id, r_name AS state_id,
         CASE r_name WHEN 'AFRICA' THEN 'West' WHEN 'EUROPE' THEN 'West'
           WHEN 'AMERICA' THEN 'Central' WHEN 'ASIA' THEN 'East' ELSE 'Unknown' END AS region_id
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
cte("x_dates", """
  SELECT CAST(n AS INTEGER) AS date_id, CAST((SELECT origin FROM x_clock) + CAST(n - 1 AS INTEGER) AS DATE) AS dt,
         CAST((n - 1) // 7 + 1 AS INTEGER) AS week_id,
         CAST((n - 1) // 7 + 10001 AS INTEGER) AS wm_yr_wk,
         CAST((n - 1) % 7 + 1 AS INTEGER) AS weekday_num,
         dayname(CAST((SELECT origin FROM x_clock) + CAST(n - 1 AS INTEGER) AS DATE)) AS weekday_name,
         CAST(month(CAST((SELECT origin FROM x_clock) + CAST(n - 1 AS INTEGER) AS DATE)) AS INTEGER) AS month,
         monthname(CAST((SELECT origin FROM x_clock) + CAST(n - 1 AS INTEGER) AS DATE)) AS month_name,
         CAST(quarter(CAST((SELECT origin FROM x_clock) + CAST(n - 1 AS INTEGER) AS DATE)) AS INTEGER) AS quarter,
         CAST(year(CAST((SELECT origin FROM x_clock) + CAST(n - 1 AS INTEGER) AS DATE)) AS INTEGER) AS year
  FROM (SELECT unnest(range(1, (SELECT final_day FROM x_clock) + 29)) AS n)""")
cte("x_weeks", """
  SELECT wm_yr_wk, min(week_id) AS week_id, arg_min(year, date_id) AS year,
         arg_min(quarter, date_id) AS quarter, arg_min(month, date_id) AS month,
         arg_min(month_name, date_id) AS month_name
  FROM x_dates GROUP BY wm_yr_wk""")
cte("x_price", """
  SELECT product_surr_id, store_surr_id, wm_yr_wk, week_id,
         CAST((2 * cents + units) // (2 * units) AS DECIMAL(12,0)) AS price_cents
  FROM (SELECT product_surr_id, store_surr_id, (date_id - 1) // 7 + 1 AS week_id,
               (date_id - 1) // 7 + 10001 AS wm_yr_wk,
               CAST(SUM(units_sold) AS BIGINT) AS units, CAST(SUM(cents) AS BIGINT) AS cents
        FROM x_sparse GROUP BY ALL)""")
cte("x_weekly", """
  SELECT d.product_surr_id, d.store_surr_id, c.wm_yr_wk, min(c.week_id) AS week_id,
         CAST(SUM(d.units_sold) AS BIGINT) AS units,
         max(p.price_cents) AS price_cents,
         CAST(SUM(d.units_sold) AS BIGINT) * max(p.price_cents) AS rev_cents
  FROM x_daily d JOIN x_dates c ON c.date_id = d.date_id
  LEFT JOIN x_price p ON p.product_surr_id = d.product_surr_id
    AND p.store_surr_id = d.store_surr_id AND p.wm_yr_wk = c.wm_yr_wk
  GROUP BY d.product_surr_id, d.store_surr_id, c.wm_yr_wk""")
cte("x_wide", """
  SELECT m.*, p.product_id, p.dept_id, p.category_id, p.category_surr_id, p.dept_surr_id,
         s.store_id, s.state_id, s.region_id, w.year, w.quarter, w.month, w.month_name
  FROM x_weekly m JOIN x_product p USING (product_surr_id) JOIN x_store s USING (store_surr_id)
  JOIN x_weeks w ON w.wm_yr_wk = m.wm_yr_wk""")
