from __future__ import annotations

from oracle.base import cte, mean, statement

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


K = "product_surr_id, store_surr_id"

cte("x_stats_raw", f"""
  SELECT {K}, 1 AS series_start, CAST((SELECT final_day FROM x_clock) AS INTEGER) AS series_end, CAST(sum(units_sold) AS BIGINT) AS total_units,
         stddev_samp(units_sold) AS sd, avg(units_sold) AS mu,
         CAST(count(*) FILTER (units_sold = 0) AS BIGINT) AS zero_demand_days,
         sum(units_sold) FILTER (date_id > (SELECT final_day FROM x_clock) - 28) AS recent,
         sum(units_sold) FILTER (date_id BETWEEN (SELECT final_day FROM x_clock) - 55 AND (SELECT final_day FROM x_clock) - 28) AS prior,
         regr_slope(CAST(units_sold AS DOUBLE), CAST(date_id AS DOUBLE)) AS slope
  FROM x_daily GROUP BY {K}""")
cte("x_stats", f"""
  SELECT {K}, series_start, series_end, total_units, round(total_units / CAST((SELECT final_day FROM x_clock) AS DOUBLE), 4) AS mean_daily_units,
         round(sd, 4) AS std_daily_units, round(sd / nullif(mu, 0), 4) AS cv, zero_demand_days,
         round(CAST(recent AS DOUBLE) / nullif(prior, 0) - 1, 6) AS demand_growth_rate,
         round(slope, 8) AS trend_slope FROM x_stats_raw""")
add("D01_demand_stats", "SELECT * FROM x_stats")
add("D01_demand_stats_dense", "SELECT * FROM x_stats")
cte("x_last_day", f"SELECT *, max(date_id) OVER (PARTITION BY {K}) AS last_day FROM x_sparse")
add("D02_recent_prior_28d_growth", f"""
SELECT {K}, round(CAST(sum(units_sold) FILTER (date_id > last_day - 28) AS DOUBLE) /
  nullif(sum(units_sold) FILTER (date_id BETWEEN last_day - 55 AND last_day - 28), 0) - 1, 6)
  AS demand_growth_rate FROM x_last_day GROUP BY {K}""")
cte("x_cuts", """
  SELECT round(quantile_cont(CAST(total_units AS DOUBLE), 1.0 / 3.0), 6) AS low_q,
         round(quantile_cont(CAST(total_units AS DOUBLE), 2.0 / 3.0), 6) AS high_q FROM x_stats""")
add("D03_volume_quantiles", "SELECT * FROM x_cuts")
add("D03_volume_quantiles_sketch", """
SELECT quantile_disc(total_units, 1.0 / 3.0) AS low_q, quantile_disc(total_units, 2.0 / 3.0) AS high_q,
       count(*) AS n_series FROM x_stats""")
cte("x_growth", f"""
  SELECT {K}, avg(units) AS avg_week_units, avg(units) FILTER (rn <= 4) AS recent_4wk_mean,
         avg(units) FILTER (rn BETWEEN 5 AND 8) AS prior_4wk_mean
  FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY week_id DESC) AS rn FROM x_weekly)
  GROUP BY {K}""")
add("D04_weekly_growth", f"""
SELECT {K}, round(avg_week_units, 6) AS avg_week_units, round(recent_4wk_mean, 6) AS recent_4wk_mean,
       round(prior_4wk_mean, 6) AS prior_4wk_mean FROM x_growth""")
_GUARD = """
  CASE WHEN prior_4wk_mean > 1e-9 THEN round(recent_4wk_mean / prior_4wk_mean - 1, 6) END AS demand_growth_rate,
  prior_4wk_mean IS NOT NULL AND recent_4wk_mean IS NOT NULL AND prior_4wk_mean > 1e-9 AS growth_is_defined,
  prior_4wk_mean IS NOT NULL AND recent_4wk_mean IS NOT NULL AND prior_4wk_mean <= 1e-9
    AS growth_denominator_zero"""
add("D05_growth_guard", f"SELECT {K}, {_GUARD} FROM x_growth")
_EFFECT = """CASE WHEN abs(mean_daily_units) >= 1e-6
    THEN trend_slope * (series_end - series_start + 1) / abs(mean_daily_units) * 100 END"""
cte("x_trend", f"""
  SELECT {K}, effect, CASE WHEN effect >= 10 THEN 'increasing' WHEN effect <= -10 THEN 'decreasing'
    ELSE 'flat' END AS trend_direction FROM (SELECT *, {_EFFECT} AS effect FROM x_stats)""")
add("D06_trend_effect_direction", f"""
SELECT {K}, round(effect, 4) AS trend_effect_pct, trend_direction FROM x_trend""")
cte("x_monthly", f"""
  SELECT {K}, d.month, avg(m.units) AS mean_weekly, count(*) FILTER (m.units > 0) AS obs_weeks
  FROM x_weekly m JOIN (SELECT DISTINCT wm_yr_wk, month FROM x_dates) d USING (wm_yr_wk)
  GROUP BY {K}, d.month""")
add("D07_monthly_means", f"""
SELECT {K}, month, round(mean_weekly, 6) AS mean_weekly, obs_weeks FROM x_monthly""")
cte("x_index", f"""
  SELECT *, mean_weekly / avg(mean_weekly) OVER (PARTITION BY {K}) AS idx,
         count(*) OVER (PARTITION BY {K}) AS n_active_months
  FROM x_monthly WHERE mean_weekly > 0""")
cte("x_strength", f"""
  SELECT {K}, stddev_pop(idx) / abs(avg(idx)) AS strength, max(n_active_months) AS n_active_months,
         arg_max(month, round(idx, 9) * 1000 - month * 1e-7) AS peak_month,
         arg_min(month, round(idx, 9) * 1000 + month * 1e-7) AS trough_month
  FROM x_index GROUP BY {K}""")
cte("x_season", f"""
  SELECT *, n_active_months >= 10 AND strength > 1e-6 AS has_meaningful_seasonality FROM x_strength""")
add("D08_monthly_seasonality", f"""
SELECT i.product_surr_id, i.store_surr_id, i.month, round(i.idx, 6) AS seasonality_index, i.obs_weeks,
       s.n_active_months, round(s.strength, 6) AS seasonality_strength, s.peak_month, s.trough_month,
       s.has_meaningful_seasonality FROM x_index i JOIN x_season s USING ({K})""")
add("D08_seasonality_fact", f"""
SELECT i.product_surr_id, i.store_surr_id, 'observed_full' AS analysis_window, i.month,
       round(i.idx, 6) AS seasonality_index, i.obs_weeks, true AS is_meaningful,
       'derived' AS data_provenance
FROM x_index i JOIN x_season s USING ({K}) WHERE s.has_meaningful_seasonality""")
cte("x_dow", """
  SELECT CASE WHEN grouping(store_id) = 0 THEN 'store' WHEN grouping(state_id) = 0 THEN 'state'
              WHEN grouping(category_id) = 0 THEN 'category' WHEN grouping(dept_id) = 0 THEN 'dept'
              ELSE 'all' END AS scope_type,
         coalesce(store_id, state_id, category_id, dept_id) AS scope_key, weekday_num, weekday_name,
         CAST(sum(units_sold) AS DOUBLE) AS units, count(*) AS days
  FROM x_daily JOIN x_dates USING (date_id) JOIN x_product USING (product_surr_id)
  JOIN x_store USING (store_surr_id)
  GROUP BY GROUPING SETS ((weekday_num, weekday_name), (store_id, weekday_num, weekday_name),
    (state_id, weekday_num, weekday_name), (category_id, weekday_num, weekday_name),
    (dept_id, weekday_num, weekday_name))""")
cte("x_dow_index", """
  SELECT scope_type, scope_key, coalesce(scope_key, 'all') AS scope_value, weekday_num, weekday_name,
         round((units / days) / (sum(units) OVER w / sum(days) OVER w), 6) AS dow_index, days AS obs_days
  FROM x_dow WINDOW w AS (PARTITION BY scope_type, scope_key)
  QUALIFY sum(units) OVER w > 0""")
add("D09_dow_factors", "SELECT * FROM x_dow_index")
_VOLUME = """CASE WHEN total_units <= low_q THEN 'Low' WHEN total_units <= high_q THEN 'Medium'
  ELSE 'High' END"""
_VOLATILITY = "CASE WHEN cv < 0.5 THEN 'Low' WHEN cv < 1.0 THEN 'Medium' ELSE 'High' END"
_RATIO = "(CAST(zero_demand_days AS DOUBLE) / (series_end - series_start + 1))"
_PATTERN = f"""CASE WHEN {_RATIO} < 0.5 THEN 'Smooth' WHEN {_RATIO} < 0.75 THEN 'Erratic'
  WHEN {_RATIO} < 0.9 THEN 'Lumpy' ELSE 'Intermittent' END"""
_LEVEL = "CASE {} WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
cte("x_segment", f"""
  SELECT *, volume || '*' || volatility AS risk_cell,
         CASE WHEN risk_index >= 7 THEN 'Critical' WHEN risk_index >= 4 THEN 'High'
              WHEN risk_index >= 2 THEN 'Moderate' ELSE 'Low' END AS risk_category
  FROM (SELECT *, ({_LEVEL.format('volume')}) * ({_LEVEL.format('volatility')}) AS risk_index
        FROM (SELECT s.*, {_RATIO} AS zero_demand_ratio, {_VOLUME} AS volume,
                     {_VOLATILITY} AS volatility, {_PATTERN} AS pattern
              FROM x_stats s, x_cuts))""")
add("D10_segment_volume", f"SELECT {K}, total_units, volume AS segment_volume FROM x_segment")
add("D11_segment_volatility", f"SELECT {K}, cv, volatility AS segment_volatility FROM x_segment")
add("D12_classify_demand", f"""
SELECT {K}, round(zero_demand_ratio, 6) AS zero_demand_ratio, pattern AS segment_demand FROM x_segment""")
add("D13_risk_matrix", f"SELECT {K}, risk_cell, risk_index, risk_category FROM x_segment")
cte("x_analysis", f"""
  SELECT s.product_surr_id, s.store_surr_id, 'observed_full' AS analysis_window, series_start, series_end,
         total_units, mean_daily_units, std_daily_units, cv, zero_demand_days,
         round(zero_demand_ratio, 6) AS zero_demand_ratio, round(avg_week_units, 6) AS avg_week_units,
         round(recent_4wk_mean, 6) AS recent_4wk_mean, round(prior_4wk_mean, 6) AS prior_4wk_mean,
         {_GUARD}, trend_slope, round(effect, 4) AS trend_effect_pct, trend_direction,
         round(strength, 6) AS seasonality_strength,
         coalesce(has_meaningful_seasonality, false) AS has_meaningful_seasonality,
         peak_month, trough_month,
         CASE WHEN has_meaningful_seasonality THEN n_active_months END AS n_active_months,
         volume AS segment_volume, volatility AS segment_volatility, pattern AS segment_demand,
         risk_cell, risk_category, 'derived' AS data_provenance
  FROM (SELECT * EXCLUDE (demand_growth_rate) FROM x_segment) s
  LEFT JOIN x_growth USING ({K}) LEFT JOIN x_trend USING ({K}) LEFT JOIN x_season USING ({K})""")
add("D14_demand_analysis", "SELECT * FROM x_analysis")
add("D15_demand_rows", f"""
SELECT product_id, store_id, mean_daily_units, cv, segment_volatility, demand_growth_rate,
       growth_is_defined, trend_direction, trend_effect_pct, seasonality_strength, peak_month,
       trough_month, segment_volume, segment_demand, risk_cell, risk_category, data_provenance,
       count(*) OVER () AS total_rows
FROM x_analysis JOIN x_product USING (product_surr_id) JOIN x_store USING (store_surr_id)
WHERE segment_volatility = 'High' AND region_id = 'West' AND category_id = 'C0'
ORDER BY cv DESC NULLS FIRST, product_id, store_id LIMIT 25 OFFSET 25""")
add("D16_demand_segments", """
SELECT segment_volume, segment_volatility, NULL AS risk_category, count(*) AS n
FROM x_analysis JOIN x_store USING (store_surr_id) WHERE region_id = 'West' GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, risk_category, count(*)
FROM x_analysis JOIN x_store USING (store_surr_id) WHERE region_id = 'West' GROUP BY 3""")
TOKEN = "product_id = 'Brand#3' AND store_id = 'NATION_5'"
_NAMED = "JOIN x_product USING (product_surr_id) JOIN x_store USING (store_surr_id)"
add("D17_seasonality_lookup", f"""
SELECT a.product_surr_id, a.store_surr_id, a.seasonality_strength, a.has_meaningful_seasonality,
       a.peak_month, a.trough_month, i.month, round(i.idx, 6) AS seasonality_index, i.obs_weeks
FROM x_analysis a LEFT JOIN x_index i ON a.has_meaningful_seasonality
  AND i.product_surr_id = a.product_surr_id AND i.store_surr_id = a.store_surr_id
JOIN x_product p ON p.product_surr_id = a.product_surr_id
JOIN x_store s ON s.store_surr_id = a.store_surr_id WHERE {TOKEN}""")
add("D18_dow_lookup", "SELECT * FROM x_dow_index WHERE scope_type = 'state'")

# -- forecasting ----------------------------------------------------------------------
add("E01_series_contract_check", f"""
SELECT *, n_rows = n_days AND n_days = n_expected AND n_not_finite = 0 AND n_wrong_provenance = 0
  AS is_valid
FROM (SELECT {K}, count(*) AS n_rows, count(DISTINCT date_id) AS n_days,
             max(date_id) - min(date_id) + 1 AS n_expected, CAST(0 AS BIGINT) AS n_not_finite,
             CAST(0 AS BIGINT) AS n_wrong_provenance FROM x_sparse GROUP BY {K})""")
add("E02_chronological_split", f"""
SELECT {K}, date_id, CAST(units_sold AS INTEGER) AS units_sold,
       CASE WHEN date_id <= (SELECT final_day FROM x_clock) - 28 THEN 'train' ELSE 'valid' END AS split FROM x_sparse""")
add("E02_split_check", f"""
SELECT {K}, count(*) FILTER (date_id <= (SELECT final_day FROM x_clock) - 28) AS n_train, count(*) FILTER (date_id > (SELECT final_day FROM x_clock) - 28) AS n_valid,
       max(CASE WHEN date_id <= (SELECT final_day FROM x_clock) - 28 THEN date_id END) + 1
         = min(CASE WHEN date_id > (SELECT final_day FROM x_clock) - 28 THEN date_id END) AS is_contiguous FROM x_daily GROUP BY {K}""")
cte("x_win", f"""
  SELECT {K},
         list(units_sold ORDER BY date_id) FILTER (date_id BETWEEN (SELECT final_day FROM x_clock) - 41 AND (SELECT final_day FROM x_clock) - 28) AS tail,
         list(units_sold ORDER BY date_id) FILTER (date_id BETWEEN (SELECT final_day FROM x_clock) - 27 AND (SELECT final_day FROM x_clock)) AS actual,
         list(units_sold ORDER BY date_id) FILTER (date_id BETWEEN (SELECT final_day FROM x_clock) - 13 AND (SELECT final_day FROM x_clock)) AS final_tail
  FROM x_daily WHERE date_id >= (SELECT final_day FROM x_clock) - 41 GROUP BY {K}""")
add("E03_trailing_window_arrays", f"""
SELECT {K}, array_to_string(tail, ',') AS train_tail, array_to_string(actual, ',') AS actual,
       array_to_string(final_tail, ',') AS final_tail FROM x_win""")


def _fc(tail: str) -> dict[str, str]:
    weighted = " + ".join(f"{i} * {tail}[{7 + i}]" for i in range(1, 8))
    return {
        "naive": f"CAST({tail}[14] AS DOUBLE)",
        "seasonal_naive": f"CAST({tail}[8 + (h - 1) % 7] AS DOUBLE)",
        "moving_average": f"list_sum({tail}[8:14]) / 7.0",
        "weighted_ma": f"({weighted}) / 28.0",
    }


for _name, _model in (("E04_f_naive", "naive"), ("E05_f_seasonal_naive", "seasonal_naive"),
                      ("E06_f_moving_average", "moving_average"), ("E07_f_weighted_ma", "weighted_ma")):
    add(_name, f"""
SELECT {K}, CAST(h AS INTEGER) AS horizon_step, round({_fc('final_tail')[_model]}, 6) AS forecast_value
FROM x_win, (SELECT unnest(range(1, 29)) AS h)""")
add("E10_pilot_topn", f"SELECT {K}, total_units FROM x_stats ORDER BY total_units DESC, {K} LIMIT 64")
cte("x_pilot", f"SELECT {K}, total_units FROM x_stats ORDER BY total_units DESC, {K} LIMIT 64")
add("E10_pilot_history", f"""
SELECT {K}, date_id, CAST(units_sold AS INTEGER) AS units_sold FROM x_daily JOIN x_pilot USING ({K})""")
_long = "\nUNION ALL ".join(
    f"SELECT {K}, '{m}' AS model, {i} AS model_order, h, {f} AS f, CAST(actual[h] AS DOUBLE) AS a"
    f" FROM x_win, (SELECT unnest(range(1, 29)) AS h)"
    for i, (m, f) in enumerate(_fc("tail").items())
)
cte("x_hold", _long)
cte("x_metric", f"""
  SELECT {K}, model, model_order, avg(abs(f - a)) AS mae, sqrt(avg((f - a) * (f - a))) AS rmse,
         sum(a * abs(f - a)) / CASE WHEN sum(a) > 0 THEN sum(a) ELSE 1 END AS wmae,
         sqrt(sum(a * (f - a) * (f - a)) / CASE WHEN sum(a) > 0 THEN sum(a) ELSE 1 END) AS wrmse,
         sum(abs(f - a)) AS abs_error, avg(f - a) AS bias, stddev_samp(f - a) AS sigma
  FROM x_hold GROUP BY ALL""")
_R6 = ", ".join(f"round({m}, 6) AS {m}" for m in ("mae", "rmse", "wmae", "wrmse", "abs_error", "bias"))
add("E11_holdout_metrics", f"""
SELECT {K}, model, model_order, {_R6}, round(sigma, 6) AS sigma FROM x_metric""")
_W = ", ".join(
    f"round(sum({m} * total_units) / sum(total_units), 6) AS {m}"
    for m in ("wmae", "wrmse", "mae", "rmse", "bias")
)
cte("x_model", f"""
  SELECT model, model_order, {_W} FROM x_metric JOIN x_stats USING ({K}) GROUP BY model, model_order""")
add("E12_aggregate_metrics", "SELECT * FROM x_model")
cte("x_best", f"""
  SELECT {K}, model AS best_model, round(wmae, 9) AS best_wmae FROM x_metric
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY round(wmae, 9), model_order) = 1""")
add("E13_select_best_baseline", f"SELECT {K}, best_model, round(best_wmae, 6) AS best_wmae FROM x_best")
add("E14_statistical_wins", f"""
SELECT b.product_surr_id, b.store_surr_id,
       round(b.wmae, 9) > 0 AND coalesce((round(b.wmae, 9) - round(r.wmae, 9)) / nullif(round(b.wmae, 9), 0)
         >= 0.01, false) AS wins
FROM x_metric b JOIN x_metric r USING ({K}) WHERE b.model = 'naive' AND r.model = 'weighted_ma'""")
add("E15_select_for_series", f"SELECT {K}, best_model AS model FROM x_best")
cte("x_count", "SELECT best_model AS model, count(*) AS n_series FROM x_best GROUP BY best_model")
_ORD = "list_position(['naive', 'seasonal_naive', 'moving_average', 'weighted_ma'], model)"
cte("x_champion", f"SELECT model, n_series FROM x_count ORDER BY n_series DESC, {_ORD} LIMIT 1")
add("E16_champion_model", "SELECT * FROM x_champion")
add("E17_model_registry_baselines", """
SELECT m.model_order + 1 AS model_id, m.model, 'baseline' AS family, '1-' || ((SELECT final_day FROM x_clock) - 28) AS training_window,
       CAST((SELECT final_day FROM x_clock) - 27 AS INTEGER) AS validation_start, CAST((SELECT final_day FROM x_clock) AS INTEGER) AS validation_end, wmae, wrmse, mae, rmse, bias,
       coalesce(c.n_series, 0) AS n_selected, m.model = (SELECT model FROM x_champion) AS is_selected
FROM x_model m LEFT JOIN x_count c ON c.model = m.model""")
add("E18_evaluation_fact", f"""
SELECT model_order + 1 AS model_id, model, {K}, CAST((SELECT final_day FROM x_clock) - 27 AS INTEGER) AS validation_start, CAST((SELECT final_day FROM x_clock) AS INTEGER) AS validation_end,
       {_R6}, 28 AS n_holdout, 'derived' AS data_provenance FROM x_metric""")
_final = " ".join(f"WHEN '{m}' THEN {f}" for m, f in _fc("final_tail").items())
cte("x_final", f"""
  SELECT {K}, model, CAST((SELECT final_day FROM x_clock) + h AS INTEGER) AS forecast_date, CAST(h AS INTEGER) AS h,
         round(p, 4) AS forecast_value,
         round(CASE WHEN sigma > 0 THEN greatest(p - sigma * 1.96, 0) ELSE p END, 4) AS lower_bound,
         round(CASE WHEN sigma > 0 THEN p + sigma * 1.96 ELSE p END, 4) AS upper_bound
  FROM (SELECT w.product_surr_id, w.store_surr_id, b.best_model AS model, h, m.sigma,
               CASE b.best_model {_final} END AS p
        FROM x_win w JOIN x_best b USING ({K})
        JOIN x_metric m ON m.product_surr_id = w.product_surr_id AND m.store_surr_id = w.store_surr_id
          AND m.model = b.best_model, (SELECT unnest(range(1, 29)) AS h))""")
add("E19_final_forecast", f"""
SELECT {K}, model, CAST((SELECT final_day FROM x_clock) AS INTEGER) AS forecast_origin, h AS forecast_horizon, forecast_date, forecast_value,
       lower_bound, upper_bound, true AS is_final, 'derived' AS data_provenance FROM x_final""")
_A6 = ", ".join(
    f"{mean(f'round({m}, 6)', 6)} AS {m}" for m in ("mae", "rmse", "wmae", "wrmse", "abs_error", "bias")
)
add("E20_model_support_accuracy", f"""
SELECT model_order + 1 AS model_id, model, count(DISTINCT product_surr_id * 100000 + store_surr_id) AS support_series,
       {_A6}, false AS pilot_limited FROM x_metric GROUP BY model_order, model""")
add("E21_forecast_for_series", f"""
SELECT date_id, CAST(units_sold AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS lower_bound,
       CAST(NULL AS DOUBLE) AS upper_bound, 'observed' AS data_provenance
FROM x_daily {_NAMED} WHERE {TOKEN} AND date_id > (SELECT final_day FROM x_clock) - 14
UNION ALL SELECT forecast_date, forecast_value, lower_bound, upper_bound, 'derived'
FROM x_final {_NAMED} WHERE {TOKEN}""")
