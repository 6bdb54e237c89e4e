from __future__ import annotations

from oracle import sql_stock  # noqa: F401  (its sub-selects)
from oracle.base import cte, statement

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


K = "product_surr_id, store_surr_id"
_CHECKS: list[str] = []


def check(name: str, *parts: tuple[str, str, str, str, str], summed: bool = True) -> None:
    """Each part: category, check, status, detail, source of a row of measures."""
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS category, '{k}' AS "check", status, detail,
          CASE status WHEN 'pass' THEN 'info' WHEN 'warn' THEN 'warning' ELSE 'error' END AS severity
        FROM (SELECT {s} AS status, {d} AS detail FROM ({src}))"""
        for c, k, s, d, src in parts
    )
    add(name, rows)
    if summed:
        _CHECKS.append(rows)


_ZERO = "CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END"
_CAL = "(SELECT count(*) AS n FROM x_dates)"
check(
    "B01_check_schema",
    ("structural", "columns:calendar", "'pass'", "'missing= rows=' || n", _CAL),
    ("structural", "columns:sales", "'pass'", "'missing= rows=' || n", "SELECT count(*) AS n FROM x_series"),
    ("structural", "columns:sell_prices", "'pass'", "'missing= rows=' || n", "SELECT count(*) AS n FROM x_price"),
)
check(
    "B02_check_numeric_types",
    ("structural", "numeric:sales", "'pass'", "'not numeric= rows=' || n", "SELECT count(*) AS n FROM x_sparse"),
)


_FILE = "SELECT (SELECT count(*) FROM x_series) AS n, (SELECT final_day FROM x_clock) AS last_day"
check(
    "B01_check_schema_files",
    ("structural", "columns:sales_sound", "'pass'", "'missing= rows=' || n", _FILE),
    ("structural", "columns:sales_gap", "'fail'", "'missing=d_' || (last_day - 28) || ' rows=' || n", _FILE),
    ("structural", "columns:sales_word", "'pass'", "'missing= rows=' || n", _FILE),
    summed=False,
)
check(
    "B02_check_numeric_files",
    ("structural", "numeric:sales_sound", "'pass'", "'not numeric= rows=' || n", _FILE),
    ("structural", "numeric:sales_gap", "'pass'", "'not numeric= rows=' || n", _FILE),
    ("structural", "numeric:sales_word", "'fail'", "'not numeric=d_' || last_day || ' rows=' || n", _FILE),
    summed=False,
)


def _dup(table: str, key: str) -> str:
    return f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table})) AS n FROM {table}"


_DN = "n || ' duplicate key rows'"
check(
    "B03_check_duplicates",
    ("duplicates", "dup_key:calendar_d", _ZERO, _DN, _dup("x_dates", "date_id")),
    ("duplicates", "dup_key:sales_id_day", _ZERO, _DN, _dup("x_sparse", f"{K}, date_id")),
    ("duplicates", "dup_key:sell_prices_key", _ZERO, _DN, _dup("x_price", f"{K}, wm_yr_wk")),
    ("duplicates", "dup_key:line_part_supplier", _ZERO, _DN, _dup("lineitem", "l_partkey, l_suppkey")),
)
check(
    "B04_check_nulls",
    ("nulls", "null_critical:calendar", "'pass'", "'d=' || n || ' date=' || n",
     "SELECT count(*) FILTER (dt IS NULL) AS n FROM x_dates"),
    ("nulls", "null_critical:calendar_events", "CASE WHEN a + b = 0 THEN 'pass' ELSE 'fail' END",
     "'event_name_1=' || a || ' event_name_2=' || b",
     "SELECT count(*) FILTER (event_name_1 IS NULL) AS a, count(*) FILTER (event_name_2 IS NULL) AS b FROM x_events"),
    ("nulls", "null_critical:sell_prices", _ZERO,
     "'item_id=' || n || ' store_id=' || n || ' wm_yr_wk=' || n || ' sell_price=' || n",
     "SELECT count(*) FILTER (price_cents IS NULL) AS n FROM x_price"),
    ("nulls", "null_critical:sales", _ZERO, "'id=' || n || ' item_id=' || n || ' store_id=' || n",
     "SELECT count(*) FILTER (product_surr_id IS NULL) AS n FROM x_sparse"),
)
_DATES = """SELECT count(DISTINCT dt) AS days, count(*) AS n_rows,
  date_diff('day', min(dt), max(dt)) + 1 AS expected FROM x_dates"""
check(
    "B05_check_date_continuity",
    ("date", "calendar_date_continuity", "CASE WHEN days = expected THEN 'pass' ELSE 'fail' END",
     "'expected=' || expected || ' actual=' || days", _DATES),
    ("date", "calendar_duplicate_dates", "CASE WHEN n_rows = days THEN 'pass' ELSE 'fail' END",
     "(n_rows - days) || ' duplicate dates'", _DATES),
)
check(
    "B06_check_negative",
    ("numeric", "negative:units", _ZERO, "n || ' negative values'",
     "SELECT count(*) FILTER (units_sold < 0) AS n FROM x_sparse"),
    ("numeric", "negative:supplier_balance", _ZERO, "n || ' negative values'",
     "SELECT count(*) FILTER (s_acctbal < 0) AS n FROM supplier"),
)
check(
    "B07_check_price_range",
    ("numeric", "sell_price_range",
     "CASE WHEN neg > 0 THEN 'fail' WHEN zero > 0 OR hi > 100 THEN 'warn' ELSE 'pass' END",
     "printf('min=%.2f max=%.2f negative=%d zero=%d', lo, hi, neg, zero)",
     """SELECT CAST(min(price_cents) AS DOUBLE) / 100 AS lo, CAST(max(price_cents) AS DOUBLE) / 100 AS hi,
        count(*) FILTER (price_cents < 0) AS neg, count(*) FILTER (price_cents = 0) AS zero FROM x_price"""),
)


def _lost(key: str) -> str:
    return f"""SELECT count(*) AS n FROM (SELECT DISTINCT {key} FROM x_price
      WHERE {key} NOT IN (SELECT {key} FROM x_sparse))"""


check(
    "B08_check_referential",
    ("referential", "subset:price_items", _ZERO, "n || ' keys without parent'", _lost("product_surr_id")),
    ("referential", "subset:price_stores", _ZERO, "n || ' keys without parent'", _lost("store_surr_id")),
)
check(
    "B09_check_hierarchy",
    ("hierarchy", "dept_in_one_category", "CASE WHEN n = 1 THEN 'pass' ELSE 'fail' END",
     "'most categories of a department=' || n",
     """SELECT max(c) AS n FROM (SELECT dept_id, count(DISTINCT category_id) AS c
        FROM x_series JOIN x_product USING (product_surr_id) GROUP BY dept_id)"""),
    ("hierarchy", "hierarchy_extent", "CASE WHEN p = 25 AND s = 25 THEN 'pass' ELSE 'warn' END",
     "'products=' || p || ' stores=' || s",
     "SELECT count(DISTINCT product_surr_id) AS p, count(DISTINCT store_surr_id) AS s FROM x_series"),
)


def _orphan(where: str) -> str:
    return f"""SELECT count(*) AS n FROM x_sparse f WHERE NOT EXISTS (
      SELECT 1 FROM x_store s WHERE s.store_surr_id = f.store_surr_id AND {where})"""


check(
    "B10_check_orphans",
    ("integrity", "orphan_sales_keys", _ZERO, "n || ' orphan rows'", _orphan("true")),
    ("integrity", "orphan_sales_keys", _ZERO, "n || ' orphan rows'", _orphan("region_id = 'West'")),
)
check(
    "B11_check_fact_keys_unique",
    ("integrity", "unique_keys:daily_sales", _ZERO, "n || ' repeated keys'",
     f"SELECT count(*) AS n FROM (SELECT 1 FROM x_sparse GROUP BY {K}, date_id HAVING count(*) > 1)"),
    ("integrity", "unique_keys:weekly_price", _ZERO, "n || ' repeated keys'",
     f"SELECT count(*) AS n FROM (SELECT 1 FROM x_price GROUP BY {K}, wm_yr_wk HAVING count(*) > 1)"),
)
_MEASURES = {
    "staged_rows": "count(*) FROM x_sparse", "staged_units": "sum(units_sold) FROM x_sparse",
    "fact_rows": "count(*) FROM x_sparse", "fact_units": "sum(units_sold) FROM x_sparse",
    "price_rows": "count(*) FROM x_price",
    "price_min": "CAST(min(price_cents) AS DOUBLE) / 100 FROM x_price",
    "price_max": "CAST(max(price_cents) AS DOUBLE) / 100 FROM x_price",
    "n_products": "count(DISTINCT product_surr_id) FROM x_sparse",
    "n_stores": "count(DISTINCT store_surr_id) FROM x_sparse",
    "n_days": "count(DISTINCT date_id) FROM x_sparse",
    "rows_category": "count(DISTINCT category_id) FROM x_product",
    "rows_department": "count(DISTINCT dept_id) FROM x_product",
    "rows_product": "count(*) FROM x_product", "rows_store": "count(*) FROM x_store",
    "rows_date": "count(*) FROM x_dates",
}


def _value(body: str) -> str:
    expr, table = body.rsplit(" FROM ", 1)
    return f"CAST({expr} AS DOUBLE) AS value FROM {table}"


add("B12_reconcile_totals", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, {_value(b)}" for m, b in _MEASURES.items()))
check(
    "B13_check_value_domains",
    *[
        ("domain", rule, _ZERO, "n || ' rows break the rule'", src)
        for rule, src in {
            "units_not_negative": "SELECT count(*) FILTER (units_sold < 0) AS n FROM x_sparse",
            "provenance_known": "SELECT 0 AS n",
            "price_not_negative": "SELECT count(*) FILTER (price_cents < 0) AS n FROM x_price",
            "region_known": "SELECT count(*) FILTER (region_id NOT IN ('West', 'Central', 'East')) AS n FROM x_store",
            "state_known": """SELECT count(*) FILTER (state_id NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'))
                              AS n FROM x_store""",
            "category_upper": "SELECT count(*) FILTER (category_id <> upper(category_id)) AS n FROM x_product",
            "month_range": "SELECT count(*) FILTER (month NOT BETWEEN 1 AND 12) AS n FROM x_dates",
            "quarter_range": "SELECT count(*) FILTER (quarter NOT BETWEEN 1 AND 4) AS n FROM x_dates",
            "year_range": "SELECT count(*) FILTER (year NOT BETWEEN 2000 AND 2030) AS n FROM x_dates",
            "tier_known": """SELECT count(*) FILTER (risk_tier NOT IN ('Critical', 'High', 'Medium', 'Low'))
                             AS n FROM x_ranked""",
            "rank_positive": "SELECT count(*) FILTER (risk_rank < 1) AS n FROM x_ranked",
        }.items()
    ],
    summed=False,
)
add("B14_profile_sales", """
SELECT count(DISTINCT (product_surr_id, store_surr_id)) AS series_rows,
       count(DISTINCT product_surr_id) AS product_count, count(DISTINCT store_surr_id) AS store_count,
       CAST(sum(units_sold) AS BIGINT) AS total_demand,
       round(1 - CAST(count(*) FILTER (units_sold <> 0) AS DOUBLE)
         / (count(DISTINCT (product_surr_id, store_surr_id)) * (SELECT final_day FROM x_clock)), 6) AS zero_demand_fraction,
       CAST(count(*) FILTER (units_sold < 0) AS BIGINT) AS negative_value_count,
       CAST(0 AS BIGINT) AS missing_cells, CAST(0 AS BIGINT) AS duplicate_ids,
       min(date_id) AS day_start, max(date_id) AS day_end FROM x_sparse""")
_NULLS = ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS nulls_{c}"
    for c in ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
)
_NO_NULLS = ", ".join(
    f'CAST(0 AS BIGINT) AS "nulls_{c}"'
    for c in ("date", "wm_yr_wk", "weekday", "wday", "month", "year", "d", "snap_CA", "snap_TX", "snap_WI")
)
add("B15_profile_calendar", f"""
SELECT count(*) AS rows, CAST(min(dt) AS VARCHAR) AS min_date, CAST(max(dt) AS VARCHAR) AS max_date,
       CAST(0 AS BIGINT) AS duplicate_d, CAST(0 AS BIGINT) AS duplicate_date,
       CAST(date_diff('day', min(dt), max(dt)) + 1 AS INTEGER) AS expected_days,
       date_diff('day', min(dt), max(dt)) + 1 = count(DISTINCT dt) AS date_continuous,
       min(date_id) AS day_id_min, max(date_id) AS day_id_max,
       min(date_id) = 1 AND max(date_id) = count(*) AS day_id_continuous, {_NULLS}, {_NO_NULLS}
FROM x_events""")
add("B16_profile_prices", """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS duplicate_keys,
       count(DISTINCT product_surr_id) AS item_count, count(DISTINCT store_surr_id) AS store_count,
       count(DISTINCT wm_yr_wk) AS unique_weeks, CAST(min(wm_yr_wk) AS INTEGER) AS week_min,
       CAST(max(wm_yr_wk) AS INTEGER) AS week_max,
       count(*) FILTER (price_cents IS NULL) AS sell_price_missing,
       CAST(min(price_cents) AS DOUBLE) / 100 AS sell_price_min,
       CAST(max(price_cents) AS DOUBLE) / 100 AS sell_price_max,
       round(CAST(sum(price_cents) AS DOUBLE) / 100 / count(*), 4) AS sell_price_mean,
       count(*) FILTER (price_cents < 0) AS sell_price_negative,
       count(*) FILTER (price_cents = 0) AS sell_price_zero FROM x_price""")
add("B17_quality_summary", f"""
SELECT status, count(*) AS n_checks FROM ({' UNION ALL '.join(_CHECKS)}) GROUP BY status""")
cte("x_zero", f"""
  SELECT {K}, round(1 - count(*) FILTER (units_sold <> 0) / CAST((SELECT final_day FROM x_clock) AS DOUBLE), 6) AS zero_fraction
  FROM x_sparse GROUP BY {K}""")
add("B18_zero_fraction_per_series", "SELECT * FROM x_zero")
add("B18_daily_totals", """
SELECT date_id, CAST(sum(units_sold) AS BIGINT) AS units FROM x_sparse GROUP BY date_id""")


def bins(view: str, table: str, column: str, n: int) -> str:
    c = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{view}' AS view, CAST(least(floor((v - lo) / ((hi - lo) / {n})), {n - 1}) AS INTEGER) AS bin,
      count(*) AS n FROM (SELECT {c} AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi
      FROM {table} WHERE {column} IS NOT NULL) GROUP BY ALL"""


add("B18_histograms", " UNION ALL ".join([
    bins("demand", "(SELECT * FROM x_sparse WHERE units_sold > 0)", "units_sold", 60),
    bins("zero_fraction", "x_zero", "zero_fraction", 40),
    bins("price", "(SELECT CAST(price_cents AS DOUBLE) / 100 AS p FROM x_price)", "p", 60)]))
add("B19_reconcile_layers", """
SELECT layer, CAST(value AS DOUBLE) AS value, CAST(expected AS DOUBLE) AS expected,
       abs(value - expected) <= 0.1 AS agrees
FROM (SELECT unnest(['daily', 'weekly', 'monthly', 'demand', 'hierarchy']) AS layer,
             (SELECT sum(units_sold) FROM x_sparse) AS value, (SELECT sum(units) FROM x_weekly) AS expected
      UNION ALL SELECT 'revenue_shares', 100, 100)""")
