"""Dashboard measures over results, ranks and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.config import SERIES
from demandspark.operators import demand, forecast, measures, scenario
from demandspark.plans.catalog import query
from demandspark.plans.retail import RetailTables

SCENARIO = ["scenario_name"]


def _by_store(t: RetailTables) -> DataFrame:
    return t.results.join(t.store.select("store_surr_id", "region_id"), "store_surr_id")


@query("C26_m_inventory_totals")
def c26(t: RetailTables) -> DataFrame:
    return measures.inventory_totals(_by_store(t), ["scenario_name", "region_id"])


@query("C27_m_avg_service_level")
def c27(t: RetailTables) -> DataFrame:
    return measures.avg_service_level(_by_store(t), ["scenario_name", "region_id"])


@query("C28_m_fill_rate")
def c28(t: RetailTables) -> DataFrame:
    return measures.fill_rates(t.results, SCENARIO)


@query("C29_m_inventory_means")
def c29(t: RetailTables) -> DataFrame:
    return measures.inventory_means(t.results, SCENARIO)


@query("C29_m_risk_measures")
def c29_risk(t: RetailTables) -> DataFrame:
    return measures.risk_measures(t.ranked, ["risk_type", "risk_tier"])


@query("C30_m_service_gap")
def c30(t: RetailTables) -> DataFrame:
    return measures.service_gap(t.results, SCENARIO)


@query("C31_m_scenario_deltas")
def c31(t: RetailTables) -> DataFrame:
    return measures.scenario_measure_deltas(t.results)


def _evaluation(t: RetailTables) -> DataFrame:
    return forecast.evaluation_fact(t.scored, t.clock)


@query("C32_m_forecast_accuracy")
def c32(t: RetailTables) -> DataFrame:
    return measures.forecast_accuracy(_evaluation(t), t.stats, ["model"])


@query("C33_m_provenance_label")
def c33(t: RetailTables) -> DataFrame:
    """Label of one fact per scenario, and of all facts of a series."""
    per_scenario = measures.provenance_label(t.results, SCENARIO).select(
        F.col("scenario_name").alias("scope"), "provenance_label"
    )
    mixed = t.results.select("data_provenance").unionByName(
        _evaluation(t).select("data_provenance")
    )
    everything = measures.provenance_label(
        mixed.withColumn("scope", F.lit("all facts")), ["scope"], "unknown"
    )
    return per_scenario.unionByName(everything)


@query("C34_segment_histograms")
def c34(t: RetailTables) -> DataFrame:
    return measures.segment_histograms(t.analysis, t.product)


@query("C34_seasonality_by_month")
def c34_months(t: RetailTables) -> DataFrame:
    return measures.seasonality_by_month(demand.seasonality_fact(t.seasonal))


@query("C35_accuracy_by_hierarchy")
def c35(t: RetailTables) -> DataFrame:
    return measures.accuracy_by_hierarchy(_evaluation(t), t.stats, t.product, t.store)


@query("C35_common_pilot_accuracy")
def c35_pilot(t: RetailTables) -> DataFrame:
    """All six models on the series that every one of them was scored on."""
    common = measures.common_series(forecast.evaluation_fact(t.scored_all, t.clock))
    return measures.forecast_accuracy(common, t.stats, ["model"])


@query("C36_inventory_by_day")
def c36(t: RetailTables) -> DataFrame:
    return measures.inventory_by_day(t.projection)


@query("C36_sensitivity_by_set")
def c36_sets(t: RetailTables) -> DataFrame:
    """Portfolio outcome under five assumption sets, one for each region row: longer lead times, higher levels, larger orders."""
    k = F.col("r_regionkey")
    sets = t.source.table("region").select(
        (k + 1).cast("int").alias("assumption_set_id"),
        (3 + 2 * k).alias("lead_time_days"),
        F.round(0.9 + k * 0.02, 4).alias("service_level"),
        (5 + k).alias("reorder_qty_multiple"),
    )
    return scenario.sensitivity(t.moments, t.vectors, sets)


@query("C36_inventory_breakdowns")
def c36_breakdowns(t: RetailTables) -> DataFrame:
    return measures.inventory_breakdowns(t.baseline, t.product, t.store)


@query("C40_forecast_volume_by_week", one_pass=True)
def c40(t: RetailTables) -> DataFrame:
    return forecast.forecast_volume_by_week(t.final, t.dates)
