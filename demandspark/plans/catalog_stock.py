"""Replenishment, scenarios and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.config import SERIES
from demandspark.functions.exprs import z_service
from demandspark.functions.ordering import percentile_rank
from demandspark.operators import facts, forecast, replenish, risk, scenario
from demandspark.plans.catalog import query, rounded
from demandspark.plans.catalog_demand import TOKEN
from demandspark.plans.retail import RetailTables


@query("F01_expected_daily_demand")
def f01(t: RetailTables) -> DataFrame:
    days = t.clock.observed_end
    mean = replenish.expected_daily_demand(t.daily, days)
    median = replenish.expected_daily_demand(t.daily, days, "median")
    return mean.select(*SERIES, F.round("expected_daily_demand", 6).alias("mean_demand")).join(
        median.withColumnRenamed("expected_daily_demand", "median_demand"), SERIES
    )


@query("F02_daily_sigma", one_pass=True)
def f02(t: RetailTables) -> DataFrame:
    return t.stats.select(
        *SERIES, replenish.daily_sigma(F.col("std_daily_units")).alias("daily_sigma")
    )


@query("F03_z_service")
def f03(t: RetailTables) -> DataFrame:
    """Quantiles of the service levels that order-line discounts and taxes give."""
    level = F.round(0.5 + F.col("l_discount") * 4.99 - F.col("l_tax") / 2, 4)
    return (
        t.source.table("lineitem")
        .select(level.alias("level"))
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("n_lines"))
        .withColumn("z", F.round(z_service(F.col("level")), 6))
    )


@query("F04_safety_stock", one_pass=True)
def f04(t: RetailTables) -> DataFrame:
    return t.policy.select(*SERIES, "daily_sigma", "safety_stock")


@query("F05_reorder_point", one_pass=True)
def f05(t: RetailTables) -> DataFrame:
    return t.policy.select(*SERIES, "reorder_point")


@query("F06_reorder_quantity", one_pass=True)
def f06(t: RetailTables) -> DataFrame:
    return t.policy.select(*SERIES, "reorder_qty")


@query("F07_inventory_policy", one_pass=True)
def f07(t: RetailTables) -> DataFrame:
    return rounded(t.policy, {"lead_time_demand": 6}).select(
        *SERIES, "expected_daily_demand", "daily_sigma", "safety_stock", "reorder_point",
        "reorder_qty", "starting_inventory", "lead_time_demand", "lead_time_days",
        "service_level_target", "excess_coverage_days",
    )


@query("F08_policy_validation", one_pass=True)
def f08(t: RetailTables) -> DataFrame:
    """Violations once one lead time and one order size per store are broken."""
    broken = t.policy.withColumns(
        {
            "lead_time_days": F.when(
                F.col("product_surr_id") == 1, F.lit(0.5)
            ).otherwise(F.col("lead_time_days")),
            "reorder_qty": F.when(
                F.col("product_surr_id") == 2, -F.col("reorder_qty")
            ).otherwise(F.col("reorder_qty")),
        }
    )
    return replenish.policy_validation(broken)


@query("F09_inventory_projection")
def f09(t: RetailTables) -> DataFrame:
    return t.projection


@query("F10_excess_and_doi")
def f10(t: RetailTables) -> DataFrame:
    return t.projection.select(*SERIES, "day_id", "excess_inventory", "days_of_inventory")


@query("F11_daily_service_level")
def f11(t: RetailTables) -> DataFrame:
    return t.projection.select(*SERIES, "day_id", "service_level_achieved")


@query("F12_projection_summary")
def f12(t: RetailTables) -> DataFrame:
    return replenish.projection_summary(t.traced, SERIES)


@query("F13_trace_replay_check")
def f13(t: RetailTables) -> DataFrame:
    return replenish.trace_replay_check(t.projection, t.policy)


@query("F14_inventory_kpi")
def f14(t: RetailTables) -> DataFrame:
    return replenish.inventory_kpi(t.baseline)


@query("F15_inventory_horizon")
def f15(t: RetailTables) -> DataFrame:
    return replenish.inventory_horizon(t.projection, t.product, t.store, TOKEN)


@query("F16_pilot_report")
def f16(t: RetailTables) -> DataFrame:
    return replenish.pilot_report(t.baseline)


# -- scenarios --------------------------------------------------------------------------


@query("G02_scenario_param_rules")
def g02(t: RetailTables) -> DataFrame:
    """Violations per rule of a what-if grid with one row per order line."""
    line = t.source.table("lineitem")
    kinds = ["demand_shock", "lead_time_change", "service_level_change", "reorder_policy", "other"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") % 5 + 1).cast("int"))

    def only(name: str, value):
        return F.when(kind == name, value)

    grid = line.select(
        kind.alias("scenario_type"),
        only("demand_shock", F.col("l_quantity") / 4 - 2).alias("demand_adjustment_pct"),
        only("lead_time_change", F.col("l_quantity") - 30).alias("lead_time_delta_days"),
        only("service_level_change", F.col("l_discount") * 12).alias("service_level_target"),
        only("reorder_policy", F.col("l_quantity") * 1.5).alias("reorder_qty_multiple"),
        only("reorder_policy", 140 - F.col("l_quantity") * 2).alias("max_order_qty_coverage_days"),
    )
    return (
        scenario.scenario_param_rules(grid)
        .groupBy("scenario_type", "violation")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _grid(t: RetailTables) -> DataFrame:
    """A what-if grid made from the discounts and taxes that order lines have: sound rows and others."""
    line = t.source.table("lineitem")
    discount = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    none = F.lit(None).cast("double")

    def rows(level, first: int, kind: str, **given) -> DataFrame:
        levels = line.select(level.alias("_k")).distinct()
        names = ("demand_adjustment_pct", "lead_time_delta_days", "service_level_target", "reorder_qty_multiple", "max_order_qty_coverage_days")
        return levels.select(
            (F.col("_k") + first).alias("scenario_id"),
            F.concat(F.lit(kind + "_"), F.col("_k").cast("string")).alias("scenario_name"),
            F.lit(kind).alias("scenario_type"),
            *[given.get(c, none).cast("double").alias(c) for c in names],
        )

    k = F.col("_k")
    return (
        rows(discount, 100, "demand_shock", demand_adjustment_pct=F.round(k / 5.0 - 1, 4))
        .unionByName(rows(tax, 200, "lead_time_change", lead_time_delta_days=k * 3 - 8))
        .unionByName(rows(discount, 300, "service_level_change", service_level_target=F.round(k * 0.045 + 0.55, 4)))
        .unionByName(rows(tax, 400, "reorder_policy", reorder_qty_multiple=k * 7, max_order_qty_coverage_days=F.lit(28)))
        .unionByName(rows(tax, 500, "baseline").filter("scenario_id = 500"))
    )


@query("G02_grid_violations")
def g02_grid(t: RetailTables) -> DataFrame:
    return scenario.split_grid(_grid(t))[1]


@query("G08_scenario_grid")
def g08_grid(t: RetailTables) -> DataFrame:
    """Portfolio outcome of every sound row of the grid over all series."""
    return scenario.population_aggregate(scenario.grid_result(t.moments, t.vectors, _grid(t)))


def _one(t: RetailTables, name: str) -> DataFrame:
    return t.scenario(name)


@query("G03_s_baseline")
def g03(t: RetailTables) -> DataFrame:
    return _one(t, "baseline")


@query("G04_s_demand_shock")
def g04(t: RetailTables) -> DataFrame:
    return _one(t, "demand_shock_p20")


@query("G05_s_lead_time")
def g05(t: RetailTables) -> DataFrame:
    return _one(t, "lead_time_plus_2d")


@query("G06_s_service_level")
def g06(t: RetailTables) -> DataFrame:
    return _one(t, "service_level_99")


@query("G07_s_reorder_policy")
def g07(t: RetailTables) -> DataFrame:
    return _one(t, "reorder_policy_alt")


@query("G08_scenario_result")
def g08(t: RetailTables) -> DataFrame:
    return scenario.scenario_result(t.moments, t.vectors)


@query("G09_scenario_deltas")
def g09(t: RetailTables) -> DataFrame:
    return t.deltas.select(
        "scenario_id", "scenario_name", *SERIES, *scenario.DELTAS.values()
    )


@query("G10_percentile_rank_avg_ties")
def g10(t: RetailTables) -> DataFrame:
    ranked = percentile_rank(t.stats.select(*SERIES, "total_units", "cv"), "total_units", "volume_rank")
    return rounded(
        percentile_rank(ranked, "cv", "cv_rank"), {"volume_rank": 9, "cv_rank": 9}
    )


@query("G11_stockout_components")
def g11(t: RetailTables) -> DataFrame:
    return risk.stockout_components(t.baseline).select(
        *SERIES, "volume_rank", "volatility_rank", "stockout_prob", "service_gap", "urgency"
    )


@query("G12_excess_components")
def g12(t: RetailTables) -> DataFrame:
    return risk.excess_components(t.baseline).select(
        *SERIES, "excess_days_ratio", "positioning_gap", "excess_unit_efficiency", "volume_rank",
        "demand_justified",
    )


@query("G13_risk_score_rank")
def g13(t: RetailTables) -> DataFrame:
    return t.ranked.select(
        "risk_type", *SERIES, "risk_score", "risk_tier", "risk_rank", "dominant"
    )


@query("G14_population_aggregate")
def g14(t: RetailTables) -> DataFrame:
    return scenario.population_aggregate(t.results)


@query("G15_action_tradeoff")
def g15(t: RetailTables) -> DataFrame:
    rows = scenario.action_tradeoff(scenario.population_aggregate(t.results))
    return rows.select(
        "scenario_name", "baseline_scenario", "n_series", "inventory_exposure.*",
        "service_level_effect.*", "stockout_impact.*", "excess_impact.*",
    )


@query("G16_tradeoff_monetary")
def g16(t: RetailTables) -> DataFrame:
    rows = scenario.action_tradeoff(scenario.population_aggregate(t.results), 0.05, 1.5)
    return rounded(
        rows.select("scenario_name", "monetary.*"),
        {
            f"{who}_{what}": 4
            for who in ("baseline", "scenario", "delta")
            for what in ("holding_cost", "stockout_cost")
        },
    )


@query("G16_tradeoff_of_one_action")
def g16_one(t: RetailTables) -> DataFrame:
    """A higher service level against a longer lead time, stock held for 90 days."""
    rows = scenario.action_tradeoff(
        scenario.population_aggregate(t.results), 0.05, 1.5, days=90.0, target="service_level_99", baseline="lead_time_plus_2d"
    )
    costs = [f"{who}_{what}" for who in ("baseline", "scenario", "delta") for what in ("holding_cost", "stockout_cost")]
    return rounded(rows.select("scenario_name", "baseline_scenario", "monetary.*"), {c: 4 for c in costs})


@query("G17_reproducibility_record")
def g17(t: RetailTables) -> DataFrame:
    return scenario.reproducibility_record(t.results, t.clock).drop("record")


@query("G18_scenario_delta_means")
def g18(t: RetailTables) -> DataFrame:
    return scenario.scenario_delta_means(t.deltas)


@query("G19_scenario_runs")
def g19(t: RetailTables) -> DataFrame:
    return scenario.scenario_runs(t.results)


@query("G20_risk_rankings")
def g20(t: RetailTables) -> DataFrame:
    return risk.risk_rankings(
        t.ranked, t.product, t.store, "stockout", {"region": "Central"}, number=2, size=20
    ).drop("risk_components")


@query("G21_risk_drivers")
def g21(t: RetailTables) -> DataFrame:
    return risk.risk_drivers(t.ranked, t.product, t.store, TOKEN, "stockout")


@query("G22_operational_signals")
def g22(t: RetailTables) -> DataFrame:
    return risk.operational_signals(t.ranked, t.product, t.store)


@query("G23_pair_filter")
def g23(t: RetailTables) -> DataFrame:
    """Weekly rows of the series at the top of the volume order."""
    return facts.pair_filter(t.sold_weeks, t.pilot).select(*SERIES, "wm_yr_wk", "units")


@query("G24_health_anchors")
def g24(t: RetailTables) -> DataFrame:
    """Row counts and sums of each layer in one row."""
    n = F.count(F.lit(1))
    tradeoff = t.results.filter("scenario_type <> 'baseline'").agg(F.countDistinct("scenario_name"))
    return t.sold_weeks.agg(F.sum("units").alias("observed_units")).select(
        "observed_units",
        t.final.filter("is_final").agg(n).scalar().alias("forecast_rows"),
        t.projection.agg(n).scalar().alias("projection_rows"),
        t.results.agg(n).scalar().alias("scenario_rows"),
        t.scored.agg(n).scalar().alias("evaluation_rows"),
        tradeoff.scalar().alias("comparison_rows"),
        t.pilot.agg(n).scalar().alias("pilot_series"),
        forecast.champion_model(t.selected).agg(F.max("model")).scalar().alias("selected_model"),
    )


# -- measures on results and dashboards ----------------------------------------------------


@query("C37_risk_leaderboard")
def c37(t: RetailTables) -> DataFrame:
    return risk.risk_leaderboard(t.ranked, t.product, t.store, "stockout", 20).unionByName(
        risk.risk_leaderboard(t.ranked, t.product, t.store, "excess", 20)
    )


@query("C37_risk_breakdowns")
def c37_breakdowns(t: RetailTables) -> DataFrame:
    return risk.risk_breakdowns(t.ranked, t.product, t.store)


@query("C38_best_scenario")
def c38(t: RetailTables) -> DataFrame:
    return scenario.best_scenario(t.deltas, "delta_stockout_units", True).unionByName(
        scenario.best_scenario(t.deltas, "delta_service_level", False)
    )


@query("C39_worklist")
def c39(t: RetailTables) -> DataFrame:
    return risk.worklist(
        t.ranked, t.product, t.store, "stockout", {"category": "C1"}, min_score=0.2
    ).drop("risk_components")


@query("C39_delta_worklist")
def c39_delta(t: RetailTables) -> DataFrame:
    return risk.delta_worklist(
        t.deltas, t.product, t.store, "service_level_99", "delta_stockout_units"
    )


# -- the same on the full model choice ------------------------------------------------------


@query("F09_inventory_projection_with_fits")
def f09_fits(t: RetailTables) -> DataFrame:
    """The projection of forecasts that statistical models take part in."""
    return t.with_fits.projection


@query("G08_scenario_result_with_fits")
def g08_fits(t: RetailTables) -> DataFrame:
    return t.with_fits.results


@query("G13_risk_score_rank_with_fits")
def g13_fits(t: RetailTables) -> DataFrame:
    return t.with_fits.ranked.select(
        "risk_type", *SERIES, "risk_score", "risk_tier", "risk_rank", "dominant"
    )
