"""Contract checks, baseline forecasts, holdout evaluation and model choice."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from demandspark.config import (
    BASELINE_MODELS,
    DERIVED,
    MODEL_ORDER,
    OBSERVED,
    SERIES,
    STATISTICAL_MODELS,
    Clock,
    ForecastRules,
)
from demandspark.functions.arrays import BASELINES, error_metrics
from demandspark.functions.exprs import exact_mean, ratio, scaled
from demandspark.functions.ordering import page

RULES = ForecastRules()
METRICS = ("mae", "rmse", "wmae", "wrmse", "abs_error", "bias")


# -- contract -------------------------------------------------------------------------


def series_contract_check(daily: DataFrame, provenance: str = OBSERVED) -> DataFrame:
    """Per series: repeated days, gaps, non-finite units, wrong provenance."""
    units = F.col("units_sold").cast("double")
    broken = units.isNull() | F.isnan(units) | (F.abs(units) == F.lit(float("inf")))
    # Equal days meet before days are counted, so no day set is ever built.
    per_day = daily.groupBy(*SERIES, "date_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(broken).alias("_broken"),
        F.count_if(~F.col("demand_source").eqNullSafe(provenance)).alias("_foreign"),
    )
    checked = per_day.groupBy(*SERIES).agg(
        F.sum("_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_days"),
        (F.max("date_id") - F.min("date_id") + 1).alias("n_expected"),
        F.sum("_broken").alias("n_not_finite"),
        F.sum("_foreign").alias("n_wrong_provenance"),
    )
    return checked.withColumn(
        "is_valid",
        (F.col("n_rows") == F.col("n_days"))
        & (F.col("n_days") == F.col("n_expected"))
        & (F.col("n_not_finite") == 0)
        & (F.col("n_wrong_provenance") == 0),
    )


def chronological_split(daily: DataFrame, clock: Clock) -> DataFrame:
    """Label training and holdout days by date alone; later days drop out."""
    day = F.col("date_id")
    return daily.filter(day <= clock.holdout_end).withColumn(
        "split", F.when(day <= clock.train_end, "train").otherwise("valid")
    )


def split_check(split: DataFrame) -> DataFrame:
    """Per series: both sides there, and no gap between them."""
    train, valid = F.col("split") == "train", F.col("split") == "valid"
    day = F.col("date_id")
    return split.groupBy(*SERIES).agg(
        F.count_if(train).alias("n_train"),
        F.count_if(valid).alias("n_valid"),
        (F.max(F.when(train, day)) + 1 == F.min(F.when(valid, day))).alias("is_contiguous"),
    )


# -- trailing windows -------------------------------------------------------------------


def trailing_window_arrays(
    daily: DataFrame, windows: dict[str, tuple[int, int]], series: DataFrame | None = None
) -> DataFrame:
    """Day-ordered arrays of the given windows, missing days as 0.

    Only days inside the windows are collected, so an array holds a few weeks
    of one series. With a `series` table the day filter reaches the scan;
    without one the series come from the same single pass.
    """
    lo = min(a for a, _ in windows.values())
    hi = max(b for _, b in windows.values())
    inside = F.col("date_id").between(lo, hi)
    cell = F.struct("date_id", F.col("units_sold").cast("double").alias("units"))
    if series is not None:
        daily = daily.filter(inside)
    held = daily.groupBy(*SERIES).agg(F.collect_list(F.when(inside, cell)).alias("_cells"))
    if series is not None:
        held = series.select(*SERIES).join(held, SERIES, "left")
    by_day = held.withColumn(
        "_by_day", F.map_from_entries(F.coalesce("_cells", F.array().cast("array<struct<date_id:int,units:double>>")))
    )

    def window(a: int, b: int) -> Column:
        return F.transform(
            F.sequence(F.lit(a), F.lit(b)),
            lambda d: F.coalesce(F.try_element_at(F.col("_by_day"), d), F.lit(0.0)),
        )

    return by_day.select(*SERIES, *[window(*w).alias(name) for name, w in windows.items()])


def forecast_windows(clock: Clock) -> dict[str, tuple[int, int]]:
    return {
        "train_tail": (clock.trailing_start, clock.train_end),
        "actual": (clock.holdout_start, clock.holdout_end),
        "final_tail": (clock.observed_end - clock.trailing_days + 1, clock.observed_end),
    }


# -- baselines and evaluation --------------------------------------------------------------


def _model_array(forecast_of) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(i).alias("model_order"),
                forecast_of(m).alias("forecast"),
            )
            for i, m in enumerate(BASELINE_MODELS)
        ]
    )


def baseline_forecasts(windows: DataFrame, history: str, horizon: int = 28) -> DataFrame:
    """Four rows per series, one per baseline, each with its forecast array."""
    models = _model_array(lambda m: BASELINES[m](F.col(history), horizon))
    return windows.select(*windows.columns, F.inline(models))


def single_baseline(windows: DataFrame, history: str, model: str, horizon: int = 28) -> DataFrame:
    return windows.select(
        *SERIES,
        F.posexplode(BASELINES[model](F.col(history), horizon)).alias("_i", "forecast_value"),
    ).select(*SERIES, (F.col("_i") + 1).alias("horizon_step"), "forecast_value")


def holdout_metrics(forecasts: DataFrame) -> DataFrame:
    """Errors of each series and model over the holdout, row by row, no shuffle."""
    return forecasts.withColumn(
        "_m", error_metrics(F.col("forecast"), F.col("actual"))
    ).select(*SERIES, "model", "model_order", "_m.*")


def evaluate(
    windows: DataFrame, statistical: DataFrame | None = None, horizon: int = 28
) -> DataFrame:
    """Holdout metrics of the baselines and, where given, of statistical fits."""
    scored = holdout_metrics(baseline_forecasts(windows, "train_tail", horizon))
    if statistical is None:
        return scored
    fits = statistical.join(windows.select(*SERIES, "actual"), SERIES)
    return scored.unionByName(holdout_metrics(fits))


def aggregate_metrics(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """Metrics per model, series weighted by their total units."""
    weighted = scored.join(stats.select(*SERIES, "total_units"), SERIES)
    w = F.col("total_units")
    return weighted.groupBy("model", "model_order").agg(
        *[
            ratio(F.sum(F.col(m) * w), F.sum(w)).alias(m)
            for m in ("wmae", "wrmse", "mae", "rmse", "bias")
        ]
    )


# Scores that agree to nine places are ties.
def _score() -> Column:
    return F.round("wmae", 9)


def select_best_baseline(scored: DataFrame) -> DataFrame:
    """Lowest score per series; the simpler model wins a tie."""
    kept = scored.filter(F.col("model").isin(*BASELINE_MODELS))
    finite = F.when(_score().isNotNull() & ~F.isnan(_score()), F.struct(_score(), "model_order"))
    return kept.groupBy(*SERIES).agg(
        F.coalesce(F.min_by("model", finite), F.lit(BASELINE_MODELS[0])).alias("best_model"),
        F.min(F.when(finite.isNotNull(), _score())).alias("best_wmae"),
    )


def statistical_wins(stat: Column, base: Column, margin: float = RULES.selection_improvement) -> Column:
    finite = ~F.isnan(stat) & ~F.isnan(base) & (base > 0)
    return F.coalesce(finite & (F.try_divide(base - stat, base) >= margin), F.lit(False))


def select_for_series(
    scored: DataFrame, margin: float = RULES.selection_improvement
) -> DataFrame:
    """Best baseline, unless a statistical model beats it by the margin."""
    best = select_best_baseline(scored)
    stats = scored.filter(F.col("model").isin(*STATISTICAL_MODELS)).join(best, SERIES)
    winners = (
        stats.filter(statistical_wins(_score(), F.col("best_wmae"), margin))
        .groupBy(*SERIES)
        .agg(F.min_by("model", F.struct(_score(), "model_order")).alias("_winner"))
    )
    return best.join(winners, SERIES, "left").select(
        *SERIES, F.coalesce("_winner", "best_model").alias("model")
    )


def _order_of(model: Column) -> Column:
    expr = F.lit(len(MODEL_ORDER))
    for i, m in enumerate(MODEL_ORDER):
        expr = F.when(model == m, i).otherwise(expr)
    return expr


def selection_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("model").agg(F.count(F.lit(1)).alias("n_series"))


def champion_model(selected: DataFrame) -> DataFrame:
    """The model chosen most often; ties by the fixed order."""
    return (
        selection_counts(selected)
        .withColumn("_o", _order_of(F.col("model")))
        .orderBy(F.desc("n_series"), "_o")
        .limit(1)
        .drop("_o")
    )


def model_parameters(model: str, rules: ForecastRules = RULES) -> str:
    """The numbers a model works with, as JSON."""
    week = rules.seasonality
    numbers: dict[str, dict] = {
        "seasonal_naive": {"period": week},
        "moving_average": {"window": rules.ma_window},
        "weighted_ma": {"window": rules.ma_window},
        "ets_holt_winters": {"period": week, "min_points": rules.min_train_points},
        "sarima": {"order": [0, 1, 1], "seasonal_order": [0, 1, 1, week], "min_points": rules.min_train_points},
    }
    return json.dumps({"model": model, **numbers.get(model, {})})


def model_family(model: Column) -> Column:
    return F.when(model.isin(*STATISTICAL_MODELS), "statistical").otherwise("baseline")


def model_registry(
    scored: DataFrame, selected: DataFrame, stats: DataFrame, clock: Clock
) -> DataFrame:
    """One row per evaluated model with its metrics, choice count and reason.

    The champion is the most chosen model if it is a baseline; a statistical
    model is selected if it beats the best baseline on the series it was
    fitted on.
    """
    weights = stats.select(*SERIES, "total_units")
    metrics = aggregate_metrics(scored, stats)
    pilot = scored.filter(F.col("model").isin(*STATISTICAL_MODELS)).select(*SERIES).distinct()
    on_pilot = (
        aggregate_metrics(
            scored.filter(F.col("model").isin(*BASELINE_MODELS)).join(pilot, SERIES, "left_semi"),
            weights,
        )
        .agg(F.min("wmae"))
        .scalar()
    )
    champion = champion_model(selected).agg(F.max("model")).scalar()
    params, family = F.lit(None).cast("string"), model_family(F.col("model"))
    for m in MODEL_ORDER:
        params = F.when(F.col("model") == m, model_parameters(m)).otherwise(params)
    counts = selection_counts(selected)
    is_selected = F.when(F.col("family") == "baseline", F.col("model") == champion).otherwise(
        statistical_wins(F.col("wmae"), on_pilot)
    )
    reason = (
        F.when(
            (F.col("family") == "baseline") & F.col("is_selected"),
            F.concat(F.lit("champion: chosen for "), F.col("n_selected"), F.lit(" series")),
        )
        .when(
            F.col("family") == "baseline",
            F.concat(F.lit("not champion: chosen for "), F.col("n_selected"), F.lit(" series")),
        )
        .when(F.col("is_selected"), "beats the best baseline on its series")
        .otherwise("does not beat the best baseline on its series")
    )
    return (
        metrics.join(counts, "model", "left")
        .select(
            (F.col("model_order") + 1).alias("model_id"),
            F.col("model"),
            family.alias("family"),
            params.alias("params_json"),
            F.lit("chronological_holdout").alias("validation_method"),
            F.lit(f"{clock.observed_start}-{clock.train_end}").alias("training_window"),
            F.lit(clock.holdout_start).alias("validation_start"),
            F.lit(clock.holdout_end).alias("validation_end"),
            *[F.round(m, 6).alias(m) for m in ("wmae", "wrmse", "mae", "rmse", "bias")],
            F.coalesce("n_series", F.lit(0)).cast("long").alias("n_selected"),
        )
        .withColumn("is_selected", F.coalesce(is_selected, F.lit(False)))
        .withColumn("selection_rationale", reason)
        .withColumn(
            "metrics_json", F.to_json(F.struct("wmae", "wrmse", "mae", "rmse", "bias"))
        )
        .withColumn("data_provenance", F.lit(DERIVED))
    )


def evaluation_fact(scored: DataFrame, clock: Clock) -> DataFrame:
    return scored.select(
        (F.col("model_order") + 1).alias("model_id"),
        "model",
        *SERIES,
        F.lit(clock.holdout_start).alias("validation_start"),
        F.lit(clock.holdout_end).alias("validation_end"),
        *[F.round(m, 6).alias(m) for m in METRICS],
        F.lit(clock.horizon).alias("n_holdout"),
        F.lit(DERIVED).alias("data_provenance"),
    )


# -- final forecast ------------------------------------------------------------------------


def chosen_baseline(windows: DataFrame, clock: Clock) -> DataFrame:
    """Best baseline of each series, refitted at the end of history.

    The same choice as `select_best_baseline` and `chosen_forecast` make, but
    within the row of a series: no join and no shuffle. Use it when there are
    no statistical fits to weigh in.
    """
    horizon = clock.horizon
    candidates = F.array(
        *[
            F.struct(F.lit(i).alias("model_order"), F.lit(m).alias("model"),
                     BASELINES[m](F.col("train_tail"), horizon).alias("f"),
                     BASELINES[m](F.col("final_tail"), horizon).alias("point"))
            for i, m in enumerate(BASELINE_MODELS)
        ]
    )

    def scored(c: Column) -> Column:
        return F.transform(
            F.array(error_metrics(c["f"], F.col("actual"))),
            lambda m: F.struct(
                F.coalesce(F.round(m["wmae"], 9), F.lit(float("inf"))).alias("score"),
                c["model_order"].alias("model_order"),
                c["model"].alias("model"),
                m["sigma"].alias("sigma"),
                c["point"].alias("point"),
            ),
        )[0]

    best = F.array_min(F.transform(candidates, scored))
    return windows.withColumn("_best", best).select(
        *SERIES, "_best.model", "_best.sigma", "_best.point"
    )


def chosen_forecast(
    windows: DataFrame,
    scored: DataFrame,
    selected: DataFrame,
    clock: Clock,
    statistical_final: DataFrame | None = None,
) -> DataFrame:
    """Chosen model of each series refitted at the end of history, as an array.

    Comes with the deviation of the holdout errors. A series whose statistical
    refit is missing takes the seasonal naive one.
    """
    horizon = clock.horizon
    per_model = {m: BASELINES[m](F.col("final_tail"), horizon) for m in BASELINE_MODELS}
    chosen = windows.select(*SERIES, "final_tail").join(selected, SERIES)
    if statistical_final is None:
        chosen = chosen.withColumn("_fit", F.lit(None).cast("array<double>"))
    else:
        fits = statistical_final.select(*SERIES, "model", F.col("forecast").alias("_fit"))
        chosen = chosen.join(fits, [*SERIES, "model"], "left")
    is_stat = F.col("model").isin(*STATISTICAL_MODELS)
    chosen = chosen.withColumn(
        "model", F.when(is_stat & F.col("_fit").isNull(), "seasonal_naive").otherwise(F.col("model"))
    )
    point = reduce(
        lambda acc, m: F.when(F.col("model") == m, per_model[m]).otherwise(acc),
        BASELINE_MODELS,
        F.col("_fit"),
    )
    sigma = scored.select(*SERIES, F.col("model"), "sigma")
    return chosen.join(sigma, [*SERIES, "model"], "left").select(
        *SERIES, "model", "sigma", point.alias("point")
    )


def final_forecast(chosen: DataFrame, clock: Clock, z: float = RULES.pi_z) -> DataFrame:
    """One row per series and forecast day with its band.

    The band is the point plus and minus z times the error deviation, floored
    at 0; without a deviation it is the point.
    """
    rows = chosen.select(*SERIES, "model", "sigma", F.posexplode("point").alias("_i", "_point"))
    wide = F.col("sigma") > 0
    band = F.when(wide, F.col("sigma") * F.lit(z)).otherwise(0.0)
    lower = F.when(wide, F.greatest(F.col("_point") - band, F.lit(0.0))).otherwise(F.col("_point"))
    return rows.select(
        *SERIES,
        "model",
        F.lit(clock.observed_end).alias("forecast_origin"),
        (F.col("_i") + 1).alias("forecast_horizon"),
        (F.col("_i") + clock.forecast_start).alias("forecast_date"),
        F.round("_point", 4).alias("forecast_value"),
        F.round(lower, 4).alias("lower_bound"),
        F.round(F.col("_point") + band, 4).alias("upper_bound"),
        F.lit(True).alias("is_final"),
        F.lit(DERIVED).alias("data_provenance"),
    )


def chosen_vectors(chosen: DataFrame) -> DataFrame:
    """Forecast array of each series as it is stored, without exploding it."""
    return chosen.select(
        *SERIES, F.transform("point", lambda v: F.round(v, 4)).alias("forecast")
    )


def final_vectors(forecast: DataFrame) -> DataFrame:
    """The forecast of each series as one array ordered by day (horizon-long)."""
    cell = F.struct("forecast_date", F.coalesce("forecast_value", F.lit(0.0)).alias("v"))
    return forecast.groupBy(*SERIES).agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("forecast")
    )


def forecast_volume_by_week(forecast: DataFrame, dates: DataFrame) -> DataFrame:
    """Forecast units and mean band width per week."""
    days = dates.select(F.col("date_id").alias("forecast_date"), "wm_yr_wk")
    width = F.sum(scaled(F.col("upper_bound")) - scaled(F.col("lower_bound"))) * 100
    return (
        forecast.join(F.broadcast(days), "forecast_date")
        .groupBy("wm_yr_wk")
        .agg(
            (F.sum(scaled(F.col("forecast_value"))) / 10000.0).alias("forecast_units"),
            (F.round(ratio(width, F.count(F.lit(1)))) / 1e6).alias("mean_interval_width"),
        )
    )


# -- pilot ---------------------------------------------------------------------------------


def pilot_topn(stats: DataFrame, n: int = RULES.pilot_top_n) -> DataFrame:
    """The n series with the most units, ids breaking ties."""
    return (
        stats.select(*SERIES, "total_units").orderBy(F.desc("total_units"), *SERIES).limit(n)
    )


# -- reads ---------------------------------------------------------------------------------


def model_support_accuracy(evaluation: DataFrame) -> DataFrame:
    """Mean metrics and number of series per model, pilot models flagged."""
    return evaluation.groupBy("model_id", "model").agg(
        F.countDistinct(*SERIES).alias("support_series"),
        *[exact_mean(F.col(m), 6).alias(m) for m in METRICS],
        F.first(F.col("model").isin(*STATISTICAL_MODELS)).alias("pilot_limited"),
    )


def forecast_for_series(
    forecast: DataFrame,
    daily: DataFrame,
    product: DataFrame,
    store: DataFrame,
    token: str,
    clock: Clock,
    history_days: int = 14,
) -> DataFrame:
    """Forecast of one series after its last observed days, ordered by day."""
    from demandspark.operators.demand_views import one_series

    none = F.lit(None).cast("double")
    ahead = one_series(forecast.filter("is_final"), token, product, store).select(
        F.col("forecast_date").alias("date_id"),
        F.col("forecast_value").alias("value"),
        "lower_bound",
        "upper_bound",
        "data_provenance",
    )
    recent = daily.filter(
        F.col("date_id").between(clock.observed_end - history_days + 1, clock.observed_end)
    )
    past = one_series(recent, token, product, store).select(
        "date_id",
        F.col("units_sold").cast("double").alias("value"),
        none.alias("lower_bound"),
        none.alias("upper_bound"),
        F.lit(OBSERVED).alias("data_provenance"),
    )
    return page(past.unionByName(ahead), [F.asc("date_id")], 1, history_days + clock.horizon)
