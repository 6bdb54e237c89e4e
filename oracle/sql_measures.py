from __future__ import annotations

from oracle.base import cte, mean, statement
from oracle.sql_quality import bins
from oracle.sql_stock import _sum

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


K = "product_surr_id, store_surr_id"
_TOTALS = f"""CAST(sum(stockout_days) AS BIGINT) AS total_stockout_days,
  {_sum('stockout_units')} AS total_stockout_units, CAST(sum(excess_days) AS BIGINT) AS total_excess_days,
  {_sum('total_excess_units')} AS total_excess_units, {_sum('total_demand')} AS total_demand,
  {_sum('replenishment_units')} AS replenishment_units"""
_LEVEL = "round(sum(service_level_achieved * total_demand) / nullif(sum(total_demand), 0), 6)"
_FILL = "CASE WHEN sum(total_demand) > 0 THEN round(1 - ({}) / ({}), 6) END"
_FILL_UNITS = _FILL.format(_sum("stockout_units"), _sum("total_demand"))
_FILL_END = _FILL.format(_sum("final_backorder"), _sum("total_demand"))
add("C26_m_inventory_totals", f"""
SELECT scenario_name, region_id, {_TOTALS} FROM x_result JOIN x_store USING (store_surr_id)
GROUP BY scenario_name, region_id""")
add("C27_m_avg_service_level", f"""
SELECT scenario_name, region_id, {_LEVEL} AS avg_service_level
FROM x_result JOIN x_store USING (store_surr_id) GROUP BY scenario_name, region_id""")
add("C28_m_fill_rate", f"""
SELECT scenario_name, {_FILL_UNITS} AS fill_rate_units, {_FILL_END} AS fill_rate
FROM x_result GROUP BY scenario_name""")
_DOI = mean("avg_days_of_inventory")
_POS = mean("avg_inventory_position")
add("C29_m_inventory_means", f"""
SELECT scenario_name, {_DOI} AS avg_days_of_inventory, {_POS} AS avg_inventory_position,
       count(*) AS series_count FROM x_result GROUP BY scenario_name""")
add("C29_m_risk_measures", f"""
SELECT risk_type, risk_tier, count(*) FILTER (risk_tier IN ('High', 'Critical')) AS series_at_risk,
       {mean('risk_score', 6)} AS avg_risk_score, count(*) AS series_count FROM x_ranked GROUP BY risk_type, risk_tier""")
_GAP = """round(sum(greatest(service_level_target - service_level_achieved, 0) * total_demand)
  / nullif(sum(total_demand), 0), 6)"""
add("C30_m_service_gap", f"SELECT scenario_name, {_GAP} AS service_gap FROM x_result GROUP BY scenario_name")
cte("x_measure", f"""
  SELECT scenario_name, scenario_type, {_sum('stockout_units')} AS a, {_LEVEL} AS b,
         CAST(sum(excess_days) AS BIGINT) AS c, {_FILL_UNITS} AS d, {_POS} AS e
  FROM x_result GROUP BY scenario_name, scenario_type""")
add("C31_m_scenario_deltas", """
SELECT s.scenario_name, s.scenario_type, round(s.a - o.a, 6) AS delta_stockout_units,
       round(s.b - o.b, 6) AS delta_service_level, s.c - o.c AS delta_excess_days,
       round(s.d - o.d, 6) AS delta_fill_rate, round(s.e - o.e, 6) AS delta_avg_inventory_position
FROM x_measure s, x_measure o WHERE o.scenario_type = 'baseline'""")
cte("x_eval", f"""
  SELECT {K}, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias,
         round(wmae, 6) AS wmae, round(wrmse, 6) AS wrmse, total_units
  FROM x_metric JOIN x_stats USING ({K})""")
_ACC = ", ".join(
    [f"{mean(m, 6)} AS forecast_{m}" for m in ("mae", "rmse", "bias")]
    + [f"round(sum({m} * total_units) / sum(total_units), 6) AS forecast_{m}" for m in ("wmae", "wrmse")]
)
add("C32_m_forecast_accuracy", f"SELECT model, {_ACC} FROM x_eval GROUP BY model")
add("C33_m_provenance_label", """
SELECT scenario_name AS scope, 'simulated' AS provenance_label FROM x_result GROUP BY scenario_name
UNION ALL SELECT 'all facts', 'unknown'""")
_COUNTS = " UNION ALL ".join(
    f"SELECT '{v}' AS view, CAST({c} AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value"
    f" FROM x_analysis GROUP BY label"
    for v, c in {
        "trend": "trend_direction", "pattern": "segment_demand", "volatility": "segment_volatility",
        "risk_matrix": "risk_cell", "peak_month": "peak_month", "trough_month": "trough_month",
        "growth_defined": "CASE WHEN growth_is_defined THEN 'defined' WHEN growth_denominator_zero"
                          " THEN 'zero_base' ELSE 'missing' END",
    }.items()
)
cte("x_analysis_raw", f"""
  SELECT {K}, CASE WHEN prior_4wk_mean > 1e-9 THEN recent_4wk_mean / prior_4wk_mean - 1 END AS g,
         effect, CASE WHEN has_meaningful_seasonality THEN strength END AS st
  FROM x_stats LEFT JOIN x_growth USING ({K}) LEFT JOIN x_trend USING ({K}) LEFT JOIN x_season USING ({K})""")
_MEANS = " UNION ALL ".join(
    f"SELECT '{v}', category_id, round(avg({c}), {p}) FROM x_analysis_raw JOIN x_product"
    f" USING (product_surr_id) GROUP BY category_id"
    for v, c, p in (("mean_growth", "g", 6), ("mean_trend_effect", "effect", 4),
                    ("mean_seasonality_strength", "st", 6))
)
add("C34_segment_histograms", f"""
{_COUNTS} UNION ALL {_MEANS}
UNION ALL SELECT view, CAST(bin AS VARCHAR), CAST(n AS DOUBLE) FROM ({bins('cv_histogram', 'x_stats', 'cv', 12)})""")
add("C34_seasonality_by_month", f"""
SELECT i.month, round(avg(i.idx), 6) AS mean_index FROM x_index i JOIN x_season s USING ({K})
WHERE s.has_meaningful_seasonality GROUP BY i.month""")
add("C35_accuracy_by_hierarchy", f"""
SELECT dept_id, store_id, family, round(sum(wmae * total_units) / sum(total_units), 6) AS wmae,
       {mean('bias', 6)} AS bias, count(*) AS n_rows
FROM (SELECT *, 'baseline' AS family FROM x_eval) JOIN x_product USING (product_surr_id)
JOIN x_store USING (store_surr_id)
GROUP BY GROUPING SETS ((dept_id), (store_id), (family), (dept_id, store_id))""")
add("C36_inventory_by_day", f"""
SELECT day_id, {mean('service_level_achieved', 6)} AS mean_service_level,
       {mean('inventory_position')} AS mean_position
FROM x_day WHERE scenario_id = 1 GROUP BY day_id""")
add("C36_inventory_breakdowns", f"""
SELECT 'cover_by_department' AS view, dept_id AS label, {_DOI} AS value
FROM x_base JOIN x_product USING (product_surr_id) GROUP BY dept_id
UNION ALL SELECT 'gap_by_store', store_id, {_GAP} FROM x_base JOIN x_store USING (store_surr_id) GROUP BY store_id
UNION ALL SELECT view, CAST(bin AS VARCHAR), CAST(n AS DOUBLE)
FROM ({bins('service_histogram', 'x_base', 'service_level_achieved', 10)})""")
add("C40_forecast_volume_by_week", """
SELECT wm_yr_wk, CAST(sum(CAST(round(forecast_value * 10000) AS BIGINT)) AS DOUBLE) / 10000.0 AS forecast_units,
       round(CAST((sum(CAST(round(upper_bound * 10000) AS BIGINT)) - sum(CAST(round(lower_bound * 10000) AS BIGINT)))
         * 100 AS DOUBLE) / count(*)) / 1000000.0 AS mean_interval_width
FROM x_final JOIN x_dates ON date_id = forecast_date GROUP BY wm_yr_wk""")
