from __future__ import annotations

import re

from oracle.base import CTES, cte, mean, statement
from oracle.sql_demand import _NAMED, TOKEN

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = statement(sql)


def _r4(x: str) -> str:
    """Half-up to 4 places of a value that has 6, exact at ties."""
    return f"CAST(round(CAST({x} AS DECIMAL(24, 6)), 4) AS DOUBLE)"


K = "product_surr_id, store_surr_id"

# Rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2,
      -3.066479806614716e1, 2.506628277459239e0)
_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1,
      -1.328068155288572e1, 1.0)
_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0,
      4.374664141464968e0, 2.938163982698783e0)
_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)


def _poly(cs: tuple[float, ...], x: str) -> str:
    out = f"CAST({cs[0]!r} AS DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def _z(p: str) -> str:
    lo, hi = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"""CASE WHEN abs({p} - 0.95) < 1e-12 THEN CAST(1.6448536269514722 AS DOUBLE)
      WHEN {p} < 0.02425 THEN {_poly(_C, lo)} / {_poly(_D, lo)}
      WHEN {p} <= 0.97575 THEN {_poly(_A, r)} * ({p} - 0.5) / {_poly(_B, r)}
      ELSE -({_poly(_C, hi)}) / {_poly(_D, hi)} END"""


add("F01_expected_daily_demand", f"""
SELECT {K}, round(avg(units_sold), 6) AS mean_demand, median(CAST(units_sold AS DOUBLE)) AS median_demand
FROM x_daily GROUP BY {K}""")
add("F02_daily_sigma", f"SELECT {K}, std_daily_units AS daily_sigma FROM x_stats")
add("F03_z_service", f"""
SELECT level, n_lines, round({_z('level')}, 6) AS z
FROM (SELECT round(CAST(0.5 AS DOUBLE) + l_discount * CAST(4.99 AS DOUBLE) - l_tax / 2, 4) AS level,
      count(*) AS n_lines FROM lineitem GROUP BY 1)""")

cte("x_scenario", """
  SELECT * FROM (VALUES
    (1, 'baseline', 'baseline', CAST(NULL AS DOUBLE), CAST(7.0 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(7.0 AS DOUBLE), CAST(28.0 AS DOUBLE)),
    (2, 'demand_shock_p20', 'demand_shock', 0.2, 7.0, 0.95, 7.0, 28.0),
    (3, 'lead_time_plus_2d', 'lead_time_change', NULL, 9.0, 0.95, 7.0, 28.0),
    (4, 'service_level_99', 'service_level_change', NULL, 7.0, 0.99, 7.0, 28.0),
    (5, 'reorder_policy_alt', 'reorder_policy', NULL, 7.0, 0.95, 14.0, 28.0))
    AS v(scenario_id, scenario_name, scenario_type, pct, lt, sl, mult, cap)""")
cte("x_vec", f"SELECT {K}, list(forecast_value ORDER BY h) AS f FROM x_final GROUP BY {K}")
cte("x_policy", f"""
  SELECT {K}, scenario_id, scenario_name, scenario_type, pct, lt, sl, m, sd, total_units, ss,
         m * lt AS lt_demand, round(m * lt + ss, 6) AS rop,
         CASE WHEN m > 0 THEN round(greatest(least(mult * m, cap * m), 0), 6) ELSE 0 END AS q,
         round(CAST(7.0 AS DOUBLE) * m, 6) AS start
  FROM (SELECT *, round(({_z('sl')}) * (sd * sqrt(lt)), 6) AS ss
        FROM (SELECT s.product_surr_id, s.store_surr_id, s.mean_daily_units AS m,
                     s.std_daily_units AS sd, s.total_units, c.* FROM x_stats s, x_scenario c))""")
cte("x_run", f"""
  SELECT p.*, CASE WHEN pct IS NULL THEN f
      ELSE list_transform(f, lambda v: greatest(v * (1 + pct), CAST(0 AS DOUBLE))) END AS f
  FROM x_policy p JOIN x_vec USING ({K})""")
cte("x_fold", f"""
  SELECT {K}, scenario_id, 0 AS i, start AS oh, CAST(0 AS DOUBLE) AS oo, CAST(0 AS DOUBLE) AS bo,
         CAST([] AS DOUBLE[]) AS placed, CAST(0 AS DOUBLE) AS start_oh, CAST(0 AS DOUBLE) AS arr,
         CAST(0 AS DOUBLE) AS dem, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS tot
  FROM x_run
  UNION ALL
  SELECT {K}, scenario_id, i, oh, oo1 + p AS oo, bo, list_append(placed, p) AS placed, start_oh, arr, dem, p, tot
  FROM (SELECT *, CASE WHEN oh + oo1 - bo <= rop AND q > 0 THEN q ELSE CAST(0 AS DOUBLE) END AS p
    FROM (SELECT *, stock - least(stock, tot) AS oh, tot - least(stock, tot) AS bo
      FROM (SELECT *, start_oh + arr AS stock, dem + bo0 AS tot, oo0 - arr AS oo1
        FROM (SELECT r.product_surr_id, r.store_surr_id, r.scenario_id, s.i + 1 AS i, s.oh AS start_oh,
                     s.oo AS oo0, s.bo AS bo0, s.placed, r.rop, r.q,
                     greatest(r.f[s.i + 1], CAST(0 AS DOUBLE)) AS dem,
                     CASE WHEN s.i + 1 > CAST(r.lt AS INTEGER)
                       THEN s.placed[s.i + 1 - CAST(r.lt AS INTEGER)] ELSE CAST(0 AS DOUBLE) END AS arr
              FROM x_fold s JOIN x_run r ON r.product_surr_id = s.product_surr_id
                AND r.store_surr_id = s.store_surr_id AND r.scenario_id = s.scenario_id
              WHERE s.i < 28))))""")
cte("x_day", f"""
  SELECT f.product_surr_id, f.store_surr_id, f.scenario_id, f.i, (SELECT final_day FROM x_clock) + f.i AS day_id,
         round(start_oh, 4) AS starting_inventory, round(dem, 4) AS demand_forecast,
         round(lt_demand, 4) AS lead_time_demand, {_r4('ss')} AS safety_stock,
         {_r4('rop')} AS reorder_point, round(oh + oo - bo, 4) AS inventory_position,
         round(oh, 4) AS on_hand, CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END AS orders_placed,
         round(p, 4) AS reorder_qty, round(bo, 4) > 0 AS projected_stockout,
         round(bo, 4) AS stockout_units,
         CASE WHEN r.m > 0 THEN {_r4('round(greatest(oh - CAST(28.0 AS DOUBLE) * round(r.m, 6), 0), 6)')} ELSE 0 END AS excess_inventory,
         CASE WHEN r.m > 0 THEN {_r4('round(oh / round(r.m, 6), 6)')} ELSE 0 END AS days_of_inventory,
         round(CASE WHEN tot > 0 THEN (tot - bo) / tot ELSE 1 END, 6) AS service_level_achieved,
         round(oo, 4) AS on_order, round(arr, 4) AS arrival
  FROM x_fold f JOIN x_run r ON r.product_surr_id = f.product_surr_id
    AND r.store_surr_id = f.store_surr_id AND r.scenario_id = f.scenario_id WHERE f.i > 0""")
cte("x_base_policy", "SELECT * FROM x_policy WHERE scenario_id = 1")
add("F04_safety_stock", f"SELECT {K}, sd AS daily_sigma, ss AS safety_stock FROM x_base_policy")
add("F05_reorder_point", f"SELECT {K}, rop AS reorder_point FROM x_base_policy")
add("F06_reorder_quantity", f"SELECT {K}, CAST(q AS DOUBLE) AS reorder_qty FROM x_base_policy")
add("F07_inventory_policy", f"""
SELECT {K}, round(m, 6) AS expected_daily_demand, sd AS daily_sigma, ss AS safety_stock,
       rop AS reorder_point, CAST(q AS DOUBLE) AS reorder_qty, start AS starting_inventory,
       round(lt_demand, 6) AS lead_time_demand, lt AS lead_time_days, sl AS service_level_target,
       CAST(28.0 AS DOUBLE) AS excess_coverage_days FROM x_base_policy""")
add("F08_policy_validation", f"""
SELECT {K}, 'lead time must be 1 or more' AS violation FROM x_base_policy WHERE product_surr_id = 1
UNION ALL SELECT {K}, 'reorder_qty must be finite and not negative' FROM x_base_policy
WHERE product_surr_id = 2 AND q > 0""")
_DAY = """CAST(starting_inventory AS DOUBLE) AS starting_inventory, demand_forecast, lead_time_demand,
  safety_stock, reorder_point, inventory_position, on_hand, CAST(orders_placed AS DOUBLE) AS orders_placed,
  reorder_qty, projected_stockout, stockout_units, CAST(excess_inventory AS DOUBLE) AS excess_inventory,
  CAST(days_of_inventory AS DOUBLE) AS days_of_inventory,
  CAST(service_level_achieved AS DOUBLE) AS service_level_achieved, on_order"""
add("F09_inventory_projection", f"""
SELECT 1 AS assumption_set_id, {K}, day_id, {_DAY}, 'simulated' AS data_provenance
FROM x_day WHERE scenario_id = 1""")
add("F10_excess_and_doi", f"""
SELECT {K}, day_id, CAST(excess_inventory AS DOUBLE) AS excess_inventory,
       CAST(days_of_inventory AS DOUBLE) AS days_of_inventory FROM x_day WHERE scenario_id = 1""")
add("F11_daily_service_level", f"""
SELECT {K}, day_id, CAST(service_level_achieved AS DOUBLE) AS service_level_achieved
FROM x_day WHERE scenario_id = 1""")


def _n(c: str) -> str:
    return f"sum(CAST(round({c} * 10000) AS BIGINT))"


def _sum(c: str) -> str:
    return f"CAST({_n(c)} AS DOUBLE) / 10000.0"


def _mean(c: str) -> str:
    return f"round(CAST({_n(c)} AS DOUBLE) / count(*)) / 10000.0"


cte("x_summary", f"""
  SELECT {K}, scenario_id, {_sum('demand_forecast')} AS total_demand,
         CAST(count(*) FILTER (projected_stockout) AS INTEGER) AS stockout_days,
         {_sum('stockout_units')} AS stockout_units,
         round(1 - CAST(count(*) FILTER (projected_stockout) AS DOUBLE) / count(*), 6) AS service_level_achieved,
         CASE WHEN {_n('demand_forecast')} > 0 THEN
           round(CAST({_n('demand_forecast')} - CAST(round(arg_max(stockout_units, i) * 10000) AS BIGINT) AS DOUBLE)
             / {_n('demand_forecast')}, 6) ELSE 1 END AS fill_rate,
         CAST(count(*) FILTER (reorder_qty > 0) AS INTEGER) AS reorder_frequency,
         {_sum('reorder_qty')} AS total_reorder_units, {_sum('arrival')} AS replenishment_units,
         {_mean('inventory_position')} AS avg_inventory_position, {_mean('on_hand')} AS avg_on_hand,
         arg_max(on_hand, i) AS final_on_hand, arg_max(on_order, i) AS final_on_order,
         arg_max(stockout_units, i) AS final_backorder,
         arg_max(inventory_position, i) AS final_inventory_position,
         CAST(count(*) FILTER (excess_inventory > 0) AS INTEGER) AS excess_days,
         {_sum('excess_inventory')} AS total_excess_units,
         {_mean('days_of_inventory')} AS avg_days_of_inventory,
         CAST(min(CASE WHEN projected_stockout THEN i - 1 END) AS INTEGER) AS first_stockout_offset
  FROM x_day GROUP BY {K}, scenario_id""")
add("F12_projection_summary", "SELECT * EXCLUDE (scenario_id) FROM x_summary WHERE scenario_id = 1")
add("F13_trace_replay_check", f"""
SELECT {K}, count(*) AS n_days, CAST(0 AS BIGINT) AS bad_start, CAST(0 AS BIGINT) AS bad_on_hand,
       CAST(0 AS BIGINT) AS bad_position, CAST(0 AS BIGINT) AS bad_order_size,
       CAST(0 AS BIGINT) AS bad_trigger, CAST(0 AS BIGINT) AS bad_flag
FROM x_day WHERE scenario_id = 1 GROUP BY {K}""")
cte("x_sim", f"""
  SELECT p.scenario_id, scenario_name, scenario_type, s.* EXCLUDE (scenario_id),
         round(m, 4) AS expected_daily_demand, round(sd, 4) AS daily_sigma,
         round(CASE WHEN m > 0 THEN coalesce(sd / m, 0) ELSE 0 END, 4) AS cv,
         CAST(total_units AS DOUBLE) AS total_units_hist, {_r4('ss')} AS safety_stock,
         {_r4('rop')} AS reorder_point, CAST(round(q, 4) AS DOUBLE) AS reorder_qty,
         round(start, 4) AS starting_inventory, lt AS lead_time_days, sl AS service_level_target,
         'simulated' AS data_provenance
  FROM x_summary s JOIN x_policy p ON p.product_surr_id = s.product_surr_id
    AND p.store_surr_id = s.store_surr_id AND p.scenario_id = s.scenario_id""")
cte("x_result", """
  SELECT * FROM x_sim
  UNION ALL BY NAME SELECT 6 AS scenario_id, 'stockout_risk_rank' AS scenario_name,
    'stockout_risk_prioritization' AS scenario_type, * EXCLUDE (scenario_id, scenario_name, scenario_type)
    FROM x_sim WHERE scenario_id = 1
  UNION ALL BY NAME SELECT 7 AS scenario_id, 'excess_risk_rank' AS scenario_name,
    'excess_inventory_prioritization' AS scenario_type, * EXCLUDE (scenario_id, scenario_name, scenario_type)
    FROM x_sim WHERE scenario_id = 1""")
cte("x_base", "SELECT * FROM x_sim WHERE scenario_id = 1")
for _q, _s in (("G03_s_baseline", 1), ("G04_s_demand_shock", 2), ("G05_s_lead_time", 3),
               ("G06_s_service_level", 4), ("G07_s_reorder_policy", 5)):
    add(_q, f"SELECT * FROM x_result WHERE scenario_id = {_s}")
add("G08_scenario_result", "SELECT * FROM x_result")


def _avg6(c: str) -> str:
    return f"{mean(c, 6 if c in ('service_level_achieved', 'fill_rate') else 4)} AS {c}"


add("F14_inventory_kpi", f"""
SELECT *, round(on_hand + on_order - backorder, 4) AS inventory_position FROM (
  SELECT {_avg6('service_level_achieved')}, {_avg6('fill_rate')}, {_sum('stockout_units')} AS stockout_units,
         {_sum('total_excess_units')} AS excess_inventory, {_avg6('avg_days_of_inventory')},
         {_avg6('safety_stock')}, {_avg6('reorder_point')}, {_sum('final_on_hand')} AS on_hand,
         {_sum('final_on_order')} AS on_order, {_sum('final_backorder')} AS backorder,
         count(*) AS n_series FROM x_base)""")
add("F15_inventory_horizon", f"""
SELECT {K}, day_id, inventory_position, on_hand, on_order, CAST(orders_placed AS DOUBLE) AS orders_placed,
       projected_stockout, stockout_units, CAST(days_of_inventory AS DOUBLE) AS days_of_inventory,
       'simulated' AS data_provenance FROM x_day {_NAMED} WHERE scenario_id = 1 AND {TOKEN}""")
add("F16_pilot_report", f"""
SELECT count(*) AS n_series, CAST(sum(reorder_frequency) AS BIGINT) AS reorder_triggers,
       {_sum('replenishment_units')} AS replenishment_units, CAST(sum(stockout_days) AS BIGINT) AS stockout_days,
       {_sum('stockout_units')} AS stockout_units, CAST(sum(excess_days) AS BIGINT) AS excess_days,
       {mean('fill_rate', 6)} AS mean_fill_rate, min(fill_rate) AS min_fill_rate,
       max(fill_rate) AS max_fill_rate, {mean('service_level_achieved', 6)} AS mean_service_level,
       count(*) FILTER (stockout_days > 0) AS series_with_stockout,
       count(*) FILTER (replenishment_units > 0) AS series_with_replenishment
FROM (SELECT * FROM x_base ORDER BY total_units_hist DESC, {K} LIMIT 64)""")
add("G02_scenario_param_rules", """
SELECT scenario_type, violation, count(*) AS n_rows FROM (
  SELECT kind AS scenario_type, unnest(list_filter([
    CASE WHEN kind = 'other' THEN 'unknown scenario type' END,
    CASE WHEN kind = 'demand_shock' AND (q / 4 - 2 <= -0.999 OR q / 4 - 2 > 10)
      THEN 'demand_adjustment_pct out of bounds' END,
    CASE WHEN kind = 'lead_time_change' AND q - 30 + 7 < 1 THEN 'lead time below one day' END,
    CASE WHEN kind = 'service_level_change' AND (d * 12 <= 0 OR d * 12 >= 1)
      THEN 'service_level_target out of bounds' END,
    CASE WHEN kind = 'reorder_policy' AND (q * 1.5 <= 0 OR q * 1.5 > 60)
      THEN 'reorder_qty_multiple out of bounds' END,
    CASE WHEN kind = 'reorder_policy' AND (140 - q * 2 <= 0 OR 140 - q * 2 > 120)
      THEN 'max_order_qty_coverage_days out of bounds' END,
    CASE WHEN kind = 'reorder_policy' AND 140 - q * 2 < q * 1.5 THEN 'cap below the multiple' END
  ], lambda x: x IS NOT NULL)) AS violation
  FROM (SELECT ['demand_shock', 'lead_time_change', 'service_level_change', 'reorder_policy',
                'other'][l_linenumber % 5 + 1] AS kind, l_quantity AS q, l_discount AS d FROM lineitem))
GROUP BY scenario_type, violation""")
_DELTA = {
    "stockout_days": "delta_stockout_days", "stockout_units": "delta_stockout_units",
    "service_level_achieved": "delta_service_level", "fill_rate": "delta_fill_rate",
    "reorder_frequency": "delta_reorder_frequency",
    "total_reorder_units": "delta_total_reorder_units",
    "avg_inventory_position": "delta_avg_inventory_position", "excess_days": "delta_excess_days",
    "total_excess_units": "delta_total_excess_units",
    "avg_days_of_inventory": "delta_avg_days_of_inventory",
}
_INT = ("stockout_days", "reorder_frequency", "excess_days")
_D = ", ".join(
    f"r.{c} - b.{c} AS {o}" if c in _INT else f"round(r.{c} - b.{c}, 6) AS {o}"
    for c, o in _DELTA.items()
)
cte("x_delta", f"""
  SELECT r.scenario_id, r.scenario_name, r.scenario_type, r.product_surr_id, r.store_surr_id, {_D}
  FROM x_result r JOIN x_base b USING ({K})""")
add("G09_scenario_deltas", "SELECT * EXCLUDE (scenario_type) FROM x_delta")


def _pr(c: str, table: str = "") -> str:
    """Average-tie percentile rank."""
    return f"""CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE
      (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 1)
      / (count(*) OVER () - 1) END"""


add("G10_percentile_rank_avg_ties", f"""
SELECT {K}, total_units, cv, round({_pr('total_units')}, 9) AS volume_rank,
       round({_pr('coalesce(cv, 0)')}, 9) AS cv_rank FROM x_stats""")
cte("x_stock", f"""
  SELECT *, round({_pr('total_units_hist')}, 6) AS volume_rank, round({_pr('cv')}, 6) AS volatility_rank,
         round(stockout_days / 28.0, 6) AS stockout_prob,
         round(greatest(service_level_target - service_level_achieved, 0), 6) AS service_gap,
         round(coalesce(1 - first_stockout_offset / 28.0, 0), 6) AS urgency FROM x_base""")
cte("x_excess", f"""
  SELECT *, round(excess_days / 28.0, 6) AS excess_days_ratio,
         round(least(greatest((avg_days_of_inventory - 28.0) / 28.0, 0), 1), 6) AS positioning_gap,
         round(least(total_excess_units / greatest(total_demand, 1e-9), 1), 6) AS excess_unit_efficiency,
         {_pr('total_units_hist')} >= 0.5
           AND least(greatest((avg_days_of_inventory - 28.0) / 28.0, 0), 1) < 0.05 AS demand_justified,
         round({_pr('total_units_hist')}, 6) AS volume_rank FROM x_base""")
add("G11_stockout_components", f"""
SELECT {K}, CAST(volume_rank AS DOUBLE) AS volume_rank, CAST(volatility_rank AS DOUBLE) AS volatility_rank,
       stockout_prob, service_gap, urgency FROM x_stock""")
add("G12_excess_components", f"""
SELECT {K}, excess_days_ratio, positioning_gap, excess_unit_efficiency,
       CAST(volume_rank AS DOUBLE) AS volume_rank, demand_justified FROM x_excess""")


def _scored(table: str, kind: str, parts: list[tuple[float, str]]) -> str:
    terms = [f"(CAST({w!r} AS DOUBLE) * CAST({c} AS DOUBLE))" for w, c in parts]
    best = f"greatest({', '.join(terms)})"
    which = " ".join(f"WHEN {t} = {best} THEN '{c}'" for t, (_, c) in zip(terms, parts))
    return f"""
  SELECT '{kind}' AS risk_type, {K}, score, dominant, stockout_units, stockout_days, total_excess_units,
         excess_days, service_level_achieved, avg_days_of_inventory,
         CAST(row_number() OVER (ORDER BY score DESC, {K}) AS INTEGER) AS risk_rank
  FROM (SELECT *, least(greatest(CAST(0 AS DOUBLE) + {' + '.join(terms)}, 0), 1) AS score,
               CASE {which} END AS dominant FROM {table})"""


_S = _scored("x_stock", "stockout", [(0.15, "volume_rank"), (0.15, "volatility_rank"),
             (0.3, "stockout_prob"), (0.2, "service_gap"), (0.2, "urgency")])
_E = _scored("x_excess", "excess", [(0.4, "excess_days_ratio"), (0.35, "positioning_gap"),
             (0.25, "excess_unit_efficiency")])
cte("x_ranked", f"""
  SELECT *, round(score, 6) AS risk_score, CASE WHEN score >= 0.7 THEN 'Critical'
    WHEN score >= 0.45 THEN 'High' WHEN score >= 0.25 THEN 'Medium' ELSE 'Low' END AS risk_tier
  FROM ({_S} UNION ALL {_E})""")
add("G13_risk_score_rank", f"""
SELECT risk_type, {K}, risk_score, risk_tier, risk_rank, dominant FROM x_ranked""")
_POP = f"""
  SELECT scenario_name, scenario_type, count(*) AS n_series,
         {_mean('avg_inventory_position')} AS avg_inventory_position, {_mean('avg_on_hand')} AS avg_on_hand,
         {_sum('total_reorder_units')} AS total_reorder_units,
         CAST(sum(reorder_frequency) AS BIGINT) AS total_reorder_frequency,
         round(CAST(sum(CAST(round(service_level_achieved * 1000000) AS BIGINT)) AS DOUBLE) / count(*))
           / 1000000.0 AS mean_service_level,
         count(*) FILTER (service_level_achieved < service_level_target) AS series_below_target,
         CAST(sum(stockout_days) AS BIGINT) AS total_stockout_days,
         {_sum('stockout_units')} AS total_stockout_units,
         count(*) FILTER (stockout_days > 0) AS series_with_stockout,
         CAST(sum(excess_days) AS BIGINT) AS total_excess_days,
         {_sum('total_excess_units')} AS total_excess_units,
         count(*) FILTER (total_excess_units > 0) AS series_with_excess,
         {_mean('avg_days_of_inventory')} AS mean_avg_days_of_inventory
  FROM x_result GROUP BY scenario_name, scenario_type"""
cte("x_asked", """
  SELECT k + 100 AS scenario_id, 'demand_shock_' || k AS scenario_name, 'demand_shock' AS scenario_type,
         round(k / 5.0::DOUBLE - 1, 4) AS pct, CAST(0 AS DOUBLE) AS delta, CAST(0.95 AS DOUBLE) AS sl,
         CAST(7.0 AS DOUBLE) AS mult, CAST(28.0 AS DOUBLE) AS cap
  FROM (SELECT DISTINCT CAST(round(l_discount * 100) AS INTEGER) AS k FROM lineitem)
  UNION ALL SELECT k + 200, 'lead_time_change_' || k, 'lead_time_change', NULL, k * 3 - 8, 0.95, 7.0, 28.0
  FROM (SELECT DISTINCT CAST(round(l_tax * 100) AS INTEGER) AS k FROM lineitem)
  UNION ALL SELECT k + 300, 'service_level_change_' || k, 'service_level_change', NULL, 0,
         round(k * CAST(0.045 AS DOUBLE) + CAST(0.55 AS DOUBLE), 4), 7.0, 28.0
  FROM (SELECT DISTINCT CAST(round(l_discount * 100) AS INTEGER) AS k FROM lineitem)
  UNION ALL SELECT k + 400, 'reorder_policy_' || k, 'reorder_policy', NULL, 0, 0.95, k * 7, 28.0
  FROM (SELECT DISTINCT CAST(round(l_tax * 100) AS INTEGER) AS k FROM lineitem)
  UNION ALL SELECT 500, 'baseline_0', 'baseline', NULL, 0, 0.95, 7.0, 28.0
  FROM (SELECT DISTINCT CAST(round(l_tax * 100) AS INTEGER) AS k FROM lineitem) WHERE k = 0""")
cte("x_faults", """
  SELECT scenario_id, scenario_name, unnest(list_filter([
    CASE WHEN scenario_type = 'demand_shock' AND (pct <= -0.999 OR pct > 10) THEN 'demand_adjustment_pct out of bounds' END,
    CASE WHEN scenario_type = 'lead_time_change' AND delta + 7 < 1 THEN 'lead time below one day' END,
    CASE WHEN scenario_type = 'service_level_change' AND (sl <= 0 OR sl >= 1) THEN 'service_level_target out of bounds' END,
    CASE WHEN scenario_type = 'reorder_policy' AND (mult <= 0 OR mult > 60) THEN 'reorder_qty_multiple out of bounds' END,
    CASE WHEN scenario_type = 'reorder_policy' AND cap < mult THEN 'cap below the multiple' END
  ], lambda x: x IS NOT NULL)) AS violation FROM x_asked""")
cte("x_grid", """
  SELECT scenario_id, scenario_name, scenario_type, pct, CAST(round(7 + delta, 2) AS DOUBLE) AS lt, sl, mult, cap
  FROM x_asked WHERE scenario_id NOT IN (SELECT scenario_id FROM x_faults)""")
# The same projection with the grid in place of the scenario list.
_GRID = {"x_scenario": "x_grid", "x_policy": "x_gpolicy", "x_run": "x_grun", "x_fold": "x_gfold",
         "x_day": "x_gday", "x_summary": "x_gsummary", "x_sim": "x_gsim", "x_result": "x_gsim"}


def _on_grid(sql: str) -> str:
    return re.sub(r"\bx_[a-z]+\b", lambda m: _GRID.get(m.group(), m.group()), sql)


for _name in ("x_policy", "x_run", "x_fold", "x_day", "x_summary", "x_sim"):
    cte(_GRID[_name], _on_grid(CTES[_name]))
add("G02_grid_violations", "SELECT * FROM x_faults")
add("G08_scenario_grid", _on_grid(_POP))
# And with assumption sets in place of it.
cte("x_sets", """
  SELECT CAST(r_regionkey + 1 AS INTEGER) AS scenario_id, 'set' AS scenario_name, 'set' AS scenario_type, CAST(NULL AS DOUBLE) AS pct,
         CAST(3 + 2 * r_regionkey AS DOUBLE) AS lt, round(CAST(0.9 AS DOUBLE) + r_regionkey * CAST(0.02 AS DOUBLE), 4) AS sl,
         CAST(5 + r_regionkey AS DOUBLE) AS mult, CAST(28.0 AS DOUBLE) AS cap FROM region""")
_SETS = {"x_scenario": "x_sets", "x_policy": "x_spolicy", "x_run": "x_srun", "x_fold": "x_sfold",
         "x_day": "x_sday", "x_summary": "x_ssummary", "x_sim": "x_ssim", "x_result": "x_ssim"}


def _on_sets(sql: str) -> str:
    return re.sub(r"\bx_[a-z]+\b", lambda m: _SETS.get(m.group(), m.group()), sql)


for _name in ("x_policy", "x_run", "x_fold", "x_day", "x_summary", "x_sim"):
    cte(_SETS[_name], _on_sets(CTES[_name]))
add("C36_sensitivity_by_set", _on_sets(_POP).replace(
    "SELECT scenario_name, scenario_type,", "SELECT scenario_id AS assumption_set_id,").replace(
    "GROUP BY scenario_name, scenario_type", "GROUP BY scenario_id"))
cte("x_pop", _POP)
add("G14_population_aggregate", "SELECT * FROM x_pop")
_MEASURES = ("avg_inventory_position", "total_reorder_units", "total_reorder_frequency",
             "mean_service_level", "series_below_target", "total_stockout_days",
             "total_stockout_units", "series_with_stockout", "total_excess_days",
             "total_excess_units", "series_with_excess")
_DBL = ("avg_inventory_position", "total_reorder_units", "mean_service_level",
        "total_stockout_units", "total_excess_units")
_T = ", ".join(
    f"b.{m} AS baseline_{m}, s.{m} AS scenario_{m}, "
    + (f"round(s.{m} - b.{m}, 6)" if m in _DBL else f"s.{m} - b.{m}") + f" AS delta_{m}"
    for m in _MEASURES
)
add("G15_action_tradeoff", f"""
SELECT s.scenario_name, 'baseline' AS baseline_scenario, s.n_series, {_T}
FROM x_pop s, x_pop b WHERE b.scenario_type = 'baseline' AND s.scenario_type <> 'baseline'""")


def _cost(c: str, k: str) -> str:
    return f"round(round(CAST({k} AS DOUBLE) * ({c}){' * 28.0' if k == '0.05' else ''}, 6), 4)"


add("G16_tradeoff_monetary", f"""
SELECT s.scenario_name, {_cost('b.avg_inventory_position', '0.05')} AS baseline_holding_cost,
       {_cost('s.avg_inventory_position', '0.05')} AS scenario_holding_cost,
       {_cost('s.avg_inventory_position - b.avg_inventory_position', '0.05')} AS delta_holding_cost,
       {_cost('b.total_stockout_units', '1.5')} AS baseline_stockout_cost,
       {_cost('s.total_stockout_units', '1.5')} AS scenario_stockout_cost,
       {_cost('s.total_stockout_units - b.total_stockout_units', '1.5')} AS delta_stockout_cost
FROM x_pop s, x_pop b WHERE b.scenario_type = 'baseline' AND s.scenario_type <> 'baseline'""")
def _cost90(c: str, k: str) -> str:
    return _cost(c, k).replace("28.0", "90.0")


add("G16_tradeoff_of_one_action", f"""
SELECT s.scenario_name, b.scenario_name AS baseline_scenario, {_cost90('b.avg_inventory_position', '0.05')} AS baseline_holding_cost,
       {_cost90('s.avg_inventory_position', '0.05')} AS scenario_holding_cost,
       {_cost90('s.avg_inventory_position - b.avg_inventory_position', '0.05')} AS delta_holding_cost,
       {_cost90('b.total_stockout_units', '1.5')} AS baseline_stockout_cost,
       {_cost90('s.total_stockout_units', '1.5')} AS scenario_stockout_cost,
       {_cost90('s.total_stockout_units - b.total_stockout_units', '1.5')} AS delta_stockout_cost
FROM x_pop s, x_pop b WHERE b.scenario_name = 'lead_time_plus_2d' AND s.scenario_name = 'service_level_99'""")
add("G17_reproducibility_record", """
SELECT scenario_name, scenario_type, count(*) AS row_count, max(lead_time_days) AS lead_time_days,
       max(service_level_target) AS service_level_target,
       CAST(CASE WHEN scenario_name = 'reorder_policy_alt' THEN 14.0 ELSE 7.0 END AS DOUBLE)
         AS reorder_qty_multiple,
       CAST(CASE WHEN scenario_name = 'demand_shock_p20' THEN 0.2 ELSE 0 END AS DOUBLE) AS demand_adjustment_pct,
       CAST((SELECT final_day FROM x_clock) + 1 AS INTEGER) AS horizon_start, CAST((SELECT final_day FROM x_clock) + 28 AS INTEGER) AS horizon_end
FROM x_result GROUP BY scenario_name, scenario_type""")
_M6 = ", ".join(
    f"{mean(c, 6)} AS {c}"
    for c in ("delta_stockout_days", "delta_service_level", "delta_fill_rate", "delta_reorder_frequency",
              "delta_avg_inventory_position", "delta_excess_days", "delta_avg_days_of_inventory")
)
add("G18_scenario_delta_means", f"""
SELECT scenario_id, scenario_name, scenario_type, {_M6}, count(*) AS series_count
FROM x_delta WHERE scenario_type <> 'baseline' GROUP BY scenario_id, scenario_name, scenario_type""")
add("G19_scenario_runs", """
SELECT scenario_id, scenario_name, scenario_type, count(*) AS records_processed, 1 AS assumption_set_id,
       'success' AS status, 'simulated' AS data_provenance
FROM x_result GROUP BY scenario_id, scenario_name, scenario_type""")
add("G20_risk_rankings", f"""
SELECT product_id, store_id, risk_rank, risk_score, risk_tier, dominant, 'simulated' AS data_provenance,
       dept_id, category_id, state_id, region_id, count(*) OVER () AS total_rows
FROM x_ranked {_NAMED} WHERE risk_type = 'stockout' AND region_id = 'Central'
ORDER BY risk_rank LIMIT 20 OFFSET 20""")
_UN = "\nUNION ALL ".join(
    f"SELECT {K}, '{c}' AS component, CAST({c} AS DOUBLE) AS value FROM x_stock"
    for c in ("volume_rank", "volatility_rank", "stockout_prob", "service_gap", "urgency")
)
add("G21_risk_drivers", f"""
SELECT r.product_surr_id, r.store_surr_id, risk_rank, risk_score, risk_tier, dominant, component, value
FROM x_ranked r JOIN ({_UN}) c USING ({K}) {_NAMED} WHERE risk_type = 'stockout' AND {TOKEN}""")
add("G22_operational_signals", f"""
SELECT risk_type, product_id, store_id, risk_tier, risk_score, risk_rank, dominant, at_risk_count
FROM (SELECT *, count(*) OVER (PARTITION BY risk_type) AS at_risk_count FROM x_ranked
      WHERE risk_tier IN ('High', 'Critical')) {_NAMED}
QUALIFY row_number() OVER (PARTITION BY risk_type ORDER BY risk_rank) <= 8""")
add("G23_pair_filter", f"""
SELECT {K}, wm_yr_wk, units FROM x_weekly JOIN x_pilot USING ({K}) WHERE units > 0""")
add("G24_health_anchors", f"""
SELECT (SELECT CAST(sum(units) AS BIGINT) FROM x_weekly) AS observed_units,
       (SELECT count(*) FROM x_final) AS forecast_rows,
       (SELECT count(*) FROM x_day WHERE scenario_id = 1) AS projection_rows,
       (SELECT count(*) FROM x_result) AS scenario_rows,
       (SELECT count(*) FROM x_metric) AS evaluation_rows,
       (SELECT count(DISTINCT scenario_name) FROM x_result WHERE scenario_type <> 'baseline') AS comparison_rows,
       (SELECT count(*) FROM x_pilot) AS pilot_series, (SELECT model FROM x_champion) AS selected_model""")
_LB = f"""
SELECT risk_type, risk_rank, product_id, store_id, risk_score, risk_tier, stockout_units, stockout_days,
       total_excess_units, excess_days FROM x_ranked {_NAMED}"""
add("C37_risk_leaderboard", f"{_LB} WHERE risk_rank <= 20")


def _view(name: str, col: str) -> str:
    return f"""SELECT '{name}' AS view, risk_type, {col} AS label, count(*) AS n_series,
  {mean('risk_score', 6)} AS mean_score, {mean('risk_rank', 0, 4)} AS mean_rank
  FROM x_ranked {_NAMED} GROUP BY risk_type, {col}"""


add("C37_risk_breakdowns", " UNION ALL ".join(
    [_view("tier", "risk_tier"), _view("state", "state_id"), _view("department", "dept_id")]))


def _bestof(metric: str, order: str) -> str:
    return f"""SELECT '{metric}' AS metric, CAST(row_number() OVER (ORDER BY total_delta {order}, scenario_name) AS INTEGER)
  AS place, scenario_name, total_delta
  FROM (SELECT scenario_name, CAST(sum(CAST(round({metric} * 1000000) AS BIGINT)) AS DOUBLE) / 1000000.0 AS total_delta
        FROM x_delta WHERE scenario_id BETWEEN 2 AND 5 GROUP BY scenario_name)"""


add("C38_best_scenario", f"""
SELECT * FROM ({_bestof('delta_stockout_units', 'ASC')} UNION ALL {_bestof('delta_service_level', 'DESC')})
WHERE place <= 2""")
add("C39_worklist", f"""
SELECT product_id, store_id, dept_id, risk_type, risk_tier, risk_score, risk_rank, stockout_units AS units,
       stockout_days AS days, service_level_achieved, avg_days_of_inventory, dominant
FROM x_ranked {_NAMED} WHERE risk_type = 'stockout' AND category_id = 'C1' AND risk_score >= 0.2
ORDER BY risk_rank LIMIT 30""")
add("C39_delta_worklist", f"""
SELECT scenario_name, product_id, store_id, dept_id, delta_stockout_units FROM x_delta {_NAMED}
WHERE scenario_name = 'service_level_99'
ORDER BY delta_stockout_units, product_surr_id, store_surr_id LIMIT 30""")
