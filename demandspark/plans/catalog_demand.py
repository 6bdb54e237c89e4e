"""Demand statistics, segments and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.config import BASELINE_MODELS, SERIES
from demandspark.operators import demand, demand_views, forecast, forecast_fit
from demandspark.plans.catalog import query, rounded
from demandspark.plans.retail import RetailTables
from demandspark.session import stage


@query("D01_demand_stats", one_pass=True)
def d01(t: RetailTables) -> DataFrame:
    return t.stats


@query("D01_demand_stats_dense", one_pass=True)
def d01_dense(t: RetailTables) -> DataFrame:
    """The same from a complete daily fact, spans taken from the rows."""
    return demand.demand_stats(t.daily_dense)


@query("D02_recent_prior_28d_growth", one_pass=True)
def d02(t: RetailTables) -> DataFrame:
    return demand.recent_prior_growth(t.daily)


@query("D03_volume_quantiles")
def d03(t: RetailTables) -> DataFrame:
    return rounded(demand.volume_quantiles(t.stats), {"low_q": 6, "high_q": 6})


@query("D03_volume_quantiles_sketch", one_pass=True)
def d03_sketch(t: RetailTables) -> DataFrame:
    """The cuts from sketches of each store, merged."""
    return demand.sketched_volume_quantiles(demand.volume_sketches(t.stats, ["store_surr_id"]))


@query("D04_weekly_growth", one_pass=True)
def d04(t: RetailTables) -> DataFrame:
    return rounded(
        t.growth, {"avg_week_units": 6, "recent_4wk_mean": 6, "prior_4wk_mean": 6}
    )


@query("D05_growth_guard", one_pass=True)
def d05(t: RetailTables) -> DataFrame:
    guard = demand.growth_guard(F.col("recent_4wk_mean"), F.col("prior_4wk_mean"))
    return rounded(
        t.growth.select(*SERIES, *[c.alias(n) for n, c in guard.items()]),
        {"demand_growth_rate": 6},
    )


@query("D06_trend_effect_direction", one_pass=True)
def d06(t: RetailTables) -> DataFrame:
    span = F.col("series_end") - F.col("series_start") + 1
    effect = demand.trend_effect(F.col("trend_slope"), span, F.col("mean_daily_units"))
    return t.stats.select(
        *SERIES,
        F.round(effect, 4).alias("trend_effect_pct"),
        demand.trend_direction(effect).alias("trend_direction"),
    )


@query("D07_monthly_means", one_pass=True)
def d07(t: RetailTables) -> DataFrame:
    return rounded(t.monthly, {"mean_weekly": 6})


@query("D08_monthly_seasonality", one_pass=True)
def d08(t: RetailTables) -> DataFrame:
    return rounded(t.seasonal, {"seasonality_index": 6, "seasonality_strength": 6})


@query("D08_seasonality_fact")
def d08_fact(t: RetailTables) -> DataFrame:
    return rounded(demand.seasonality_fact(t.seasonal), {"seasonality_index": 6})


@query("D09_dow_factors")
def d09(t: RetailTables) -> DataFrame:
    return rounded(t.dow, {"dow_index": 6})


def _segmented(t: RetailTables) -> DataFrame:
    return demand.with_segments(t.stats, *demand.volume_cuts(t.stats))


@query("D10_segment_volume")
def d10(t: RetailTables) -> DataFrame:
    return _segmented(t).select(*SERIES, "total_units", "segment_volume")


@query("D11_segment_volatility", one_pass=True)
def d11(t: RetailTables) -> DataFrame:
    return t.stats.select(
        *SERIES, "cv", demand.segment_volatility(F.col("cv")).alias("segment_volatility")
    )


@query("D12_classify_demand", one_pass=True)
def d12(t: RetailTables) -> DataFrame:
    ratio = F.col("zero_demand_days") / (F.col("series_end") - F.col("series_start") + 1)
    return t.stats.select(
        *SERIES,
        F.round(ratio, 6).alias("zero_demand_ratio"),
        demand.classify_demand(ratio).alias("segment_demand"),
    )


@query("D13_risk_matrix")
def d13(t: RetailTables) -> DataFrame:
    return _segmented(t).select(*SERIES, "risk_cell", "risk_index", "risk_category")


ANALYSIS_PLACES = {
    "zero_demand_ratio": 6,
    "avg_week_units": 6,
    "recent_4wk_mean": 6,
    "prior_4wk_mean": 6,
    "demand_growth_rate": 6,
    "trend_effect_pct": 4,
    "seasonality_strength": 6,
}


@query("D14_demand_analysis")
def d14(t: RetailTables) -> DataFrame:
    return rounded(t.analysis, ANALYSIS_PLACES)


@query("D15_demand_rows")
def d15(t: RetailTables) -> DataFrame:
    """Second page of the intermittent, high-variation series of one region."""
    rows = demand_views.demand_rows(
        t.analysis,
        t.product,
        t.store,
        {"volatility_class": "High", "region": "West", "category": "C0"},
        "cv_desc",
        number=2,
        size=25,
    )
    return rounded(
        rows, {c: ANALYSIS_PLACES[c] for c in ANALYSIS_PLACES if c in rows.columns}
    )


@query("D16_demand_segments")
def d16(t: RetailTables) -> DataFrame:
    return demand_views.demand_segments(t.analysis, t.product, t.store, {"region": "West"})


TOKEN = "Brand#3:NATION_5"


@query("D17_seasonality_lookup")
def d17(t: RetailTables) -> DataFrame:
    rows = demand_views.seasonality_lookup(
        t.analysis, demand.seasonality_fact(t.seasonal), t.product, t.store, TOKEN
    )
    return rounded(rows, {"seasonality_strength": 6, "seasonality_index": 6})


@query("D18_dow_lookup")
def d18(t: RetailTables) -> DataFrame:
    return rounded(demand_views.dow_lookup(t.dow, "state"), {"dow_index": 6})


# -- forecasting ------------------------------------------------------------------------


@query("E01_series_contract_check", one_pass=True)
def e01(t: RetailTables) -> DataFrame:
    return forecast.series_contract_check(t.daily)


@query("E02_chronological_split", one_pass=True)
def e02(t: RetailTables) -> DataFrame:
    return forecast.chronological_split(t.daily, t.clock).select(
        *SERIES, "date_id", "units_sold", "split"
    )


@query("E02_split_check", one_pass=True)
def e02_check(t: RetailTables) -> DataFrame:
    return forecast.split_check(forecast.chronological_split(t.daily_dense, t.clock))


@query("E03_trailing_window_arrays", one_pass=True)
def e03(t: RetailTables) -> DataFrame:
    """The arrays as day-ordered text."""
    text = lambda c: F.array_join(
        F.transform(c, lambda v: v.cast("long").cast("string")), ","
    ).alias(c)
    return t.windows.select(*SERIES, *map(text, ("train_tail", "actual", "final_tail")))


def _baseline(name: str, model: str):
    @query(name, one_pass=True)
    def run(t: RetailTables) -> DataFrame:
        rows = forecast.single_baseline(t.windows, "final_tail", model, t.clock.horizon)
        return rounded(rows, {"forecast_value": 6})


_baseline("E04_f_naive", "naive")
_baseline("E05_f_seasonal_naive", "seasonal_naive")
_baseline("E06_f_moving_average", "moving_average")
_baseline("E07_f_weighted_ma", "weighted_ma")


def _fitted(t: RetailTables, model: str) -> DataFrame:
    days = t.clock.observed_end - t.clock.observed_start + 1
    fits = forecast_fit.fit_arrays(t.histories, {"final": days}, t.clock.horizon, (model,))
    return fits.select(
        *SERIES,
        "model",
        "is_fitted",
        F.posexplode("forecast").alias("_i", "forecast_value"),
    ).withColumn("horizon_step", F.col("_i") + 1).drop("_i")


@query("E08_f_holt_winters")
def e08(t: RetailTables) -> DataFrame:
    return _fitted(t, "ets_holt_winters")


@query("E09_f_sarima_airline")
def e09(t: RetailTables) -> DataFrame:
    return _fitted(t, "sarima")


@query("E10_pilot_topn", one_pass=True)
def e10(t: RetailTables) -> DataFrame:
    return t.pilot


@query("E10_pilot_history")
def e10_history(t: RetailTables) -> DataFrame:
    return t.pilot_history.select(*SERIES, "date_id", "units_sold")


METRIC_PLACES = {m: 6 for m in ("mae", "rmse", "wmae", "wrmse", "abs_error", "bias", "sigma")}


@query("E11_holdout_metrics", one_pass=True)
def e11(t: RetailTables) -> DataFrame:
    return rounded(t.scored, METRIC_PLACES)


@query("E12_aggregate_metrics")
def e12(t: RetailTables) -> DataFrame:
    return rounded(
        forecast.aggregate_metrics(t.scored, t.stats),
        {m: 6 for m in ("mae", "rmse", "wmae", "wrmse", "bias")},
    )


@query("E13_select_best_baseline")
def e13(t: RetailTables) -> DataFrame:
    return rounded(forecast.select_best_baseline(t.scored), {"best_wmae": 6})


@query("E14_statistical_wins")
def e14(t: RetailTables) -> DataFrame:
    """The margin rule with the weighted average standing in as the challenger."""
    best = forecast.select_best_baseline(t.scored.filter("model = 'naive'"))
    rival = t.scored.filter("model = 'weighted_ma'").select(*SERIES, F.round("wmae", 9).alias("rival"))
    return best.join(rival, SERIES).select(
        *SERIES,
        forecast.statistical_wins(F.col("rival"), F.col("best_wmae")).alias("wins"),
    )


@query("E15_select_for_series")
def e15(t: RetailTables) -> DataFrame:
    """Choice among the baselines, which is the rule outside the pilot."""
    return t.selected


@query("E15_select_for_series_with_fits")
def e15_all(t: RetailTables) -> DataFrame:
    return t.selected_all


@query("E16_champion_model")
def e16(t: RetailTables) -> DataFrame:
    return forecast.champion_model(t.selected)


@query("E17_model_registry")
def e17(t: RetailTables) -> DataFrame:
    return forecast.model_registry(t.scored_all, t.selected_all, t.stats, t.clock)


@query("E17_model_registry_baselines")
def e17_base(t: RetailTables) -> DataFrame:
    registry = forecast.model_registry(t.scored, t.selected, t.stats, t.clock)
    return registry.select(
        "model_id", "model", "family", "training_window", "validation_start", "validation_end",
        "wmae", "wrmse", "mae", "rmse", "bias", "n_selected", "is_selected",
    )


@query("E18_evaluation_fact")
def e18(t: RetailTables) -> DataFrame:
    return forecast.evaluation_fact(t.scored, t.clock)


@query("E18_evaluation_fact_with_fits")
def e18_all(t: RetailTables) -> DataFrame:
    return forecast.evaluation_fact(t.scored_all, t.clock)


@query("E19_final_forecast", one_pass=True)
def e19(t: RetailTables) -> DataFrame:
    return t.final


@query("E19_final_forecast_with_fits")
def e19_all(t: RetailTables) -> DataFrame:
    return forecast.final_forecast(t.chosen_all, t.clock)


@query("E20_model_support_accuracy")
def e20(t: RetailTables) -> DataFrame:
    return forecast.model_support_accuracy(forecast.evaluation_fact(t.scored, t.clock))


@query("E21_forecast_for_series")
def e21(t: RetailTables) -> DataFrame:
    recent = t.daily_dense.filter(
        F.col("date_id") > t.clock.observed_end - t.clock.trailing_days
    )
    return forecast.forecast_for_series(t.final, recent, t.product, t.store, TOKEN, t.clock)
