"""Statistical fits of whole series.

Spark makes one array of each history, whose length the calendar bounds, and deals
the arrays over all tasks; a fit sees one array at a time. The fits try
a fixed grid of parameters and keep the one with the least squared one-step
error, so they give the same result everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from demandspark.config import MODEL_ORDER, SERIES, STATISTICAL_MODELS, Clock, ForecastRules
from demandspark.operators.facts import densify_daily, pair_filter
from demandspark.session import spread

RULES = ForecastRules()
SMOOTHING = np.array([0.02, 0.05, 0.1, 0.2, 0.4])
MOVING = np.array([-0.95, -0.8, -0.6, -0.4, -0.2, 0.0, 0.2])


def holt_winters(y: np.ndarray, horizon: int, period: int = 7) -> np.ndarray:
    """Additive level, trend and season; every grid point advances at once."""
    alpha, beta, gamma = (
        g.ravel() for g in np.meshgrid(SMOOTHING, SMOOTHING, SMOOTHING, indexing="ij")
    )
    first, second = y[:period].mean(), y[period : 2 * period].mean()
    level = np.full(alpha.size, first)
    trend = np.full(alpha.size, (second - first) / period)
    season = np.repeat((y[:period] - first)[:, None], alpha.size, axis=1)
    sse = np.zeros(alpha.size)
    for t, value in enumerate(y):
        s = season[t % period]
        error = value - (level + trend + s)
        sse += error * error
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season[t % period] = gamma * (value - level) + (1 - gamma) * s
    best = int(np.argmin(sse))
    steps = np.arange(1, horizon + 1)
    seasonal = season[(len(y) + steps - 1) % period, best]
    return level[best] + steps * trend[best] + seasonal


def airline(y: np.ndarray, horizon: int, period: int = 7) -> np.ndarray:
    """Moving-average model of the doubly differenced series, with a constant."""
    theta, seasonal = (g.ravel() for g in np.meshgrid(MOVING, MOVING, indexing="ij"))
    w = np.diff(y)[period:] - np.diff(y)[:-period]
    drift = w.mean()
    past = np.zeros((period + 1, theta.size))  # past[k] is the error k + 1 steps ago
    sse = np.zeros(theta.size)
    for value in w:
        error = value - drift - theta * past[0] - seasonal * past[period - 1]
        error -= theta * seasonal * past[period]
        sse += error * error
        past = np.vstack([error[None, :], past[:-1]])
    best = int(np.argmin(sse))
    th, se, e = theta[best], seasonal[best], list(past[:, best])
    levels = list(y)
    for _ in range(horizon):
        change = drift + th * e[0] + se * e[period - 1] + th * se * e[period]
        levels.append(levels[-1] + levels[-period] - levels[-period - 1] + change)
        e = [0.0, *e[:-1]]
    return np.array(levels[-horizon:])


def level_only(y: np.ndarray, horizon: int) -> np.ndarray:
    """Simple exponential smoothing: the level alone, with the best smoothing of the grid."""
    alpha = np.linspace(0.05, 0.95, 19)
    level, sse = np.full(alpha.size, y[0]), np.zeros(alpha.size)
    for value in y[1:]:
        error = value - level
        sse += error * error
        level = level + alpha * error
    return np.repeat(level[int(np.argmin(sse))], horizon)


def fit_one(y: np.ndarray, model: str, horizon: int, rules: ForecastRules = RULES):
    """(forecast, fitted): a simpler model where a fit is not possible.

    Holt-Winters falls back to the level alone, and to the last value for
    series without demand or with values that are not finite.
    """
    usable = bool(np.isfinite(y).all() and (y > 0).any())
    if model != "ets_holt_winters":
        fallback = np.resize(y[-rules.seasonality :], horizon)
    elif usable:
        fallback = np.clip(level_only(y, horizon), 0.0, None)
    else:
        fallback = np.repeat(y[-1], horizon)
    if y.size < rules.min_train_points or not usable:
        return fallback, False
    forecast = (holt_winters if model == "ets_holt_winters" else airline)(
        y, horizon, rules.seasonality
    )
    if not np.isfinite(forecast).all():
        return fallback, False
    return np.clip(forecast, 0.0, None), True


def series_history(
    daily: DataFrame, clock: Clock, pairs: DataFrame | None = None, complete: bool = False
) -> DataFrame:
    """Full daily history of all series, or of those in `pairs`.

    A complete fact is taken as it is and series with missing days drop out;
    otherwise missing days are days without demand.
    """
    days = daily.filter(F.col("date_id").between(clock.observed_start, clock.observed_end))
    kept = days if pairs is None else pair_filter(days, pairs)
    if not complete:
        return densify_daily(kept, clock.observed_start, clock.observed_end)
    n = clock.observed_end - clock.observed_start + 1
    whole = kept.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n)
    return pair_filter(kept, whole)


def _cells(rows: DataFrame) -> DataFrame:
    """One row per series with its days in order; the calendar bounds a row."""
    cell = F.struct("date_id", F.col("units_sold").cast("double").alias("units"))
    return rows.groupBy(*SERIES).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))


def history_arrays(daily: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """(series, history): the units of every day from `first_day` to `last_day`.

    Only days with a row are shuffled. Each of them brings the zeros since the
    one before it; days must be unique in a series. A series without a row in the
    span has no history.
    """
    cells = _cells(daily.filter(F.col("date_id").between(first_day, last_day)))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def filled(cell, i):
        before = F.coalesce(F.get("_cells", i - 1)["date_id"], F.lit(first_day - 1))
        return F.concat(zeros(cell["date_id"] - before - 1), F.array(cell["units"]))

    tail = zeros(F.lit(last_day) - F.element_at("_cells", -1)["date_id"])
    dense = F.concat(F.flatten(F.transform("_cells", filled)), tail)
    return cells.select(*SERIES, dense.alias("history"))


def fit_arrays(
    histories: DataFrame,
    lengths: dict[str, int],
    horizon: int,
    models: tuple[str, ...] = STATISTICAL_MODELS,
) -> DataFrame:
    """Forecast arrays of the statistical models, for each named length of history.

    Every history travels once, as one array in one row, and is fitted for all
    lengths and models where it lies. Rows are dealt over all tasks first, since
    a fit takes far longer than its bytes suggest.
    """
    schema = (
        "product_surr_id int, store_surr_id int, span string, model string, model_order int,"
        " forecast array<double>, is_fitted boolean"
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for product, store, history in zip(batch[SERIES[0]], batch[SERIES[1]], batch["history"]):
                y = np.asarray(history, dtype="float64")
                for span, days in lengths.items():
                    for model in models:
                        forecast, fitted = fit_one(y[:days], model, horizon)
                        rows.append(
                            (product, store, span, model, MODEL_ORDER.index(model), forecast, fitted)
                        )
            yield pd.DataFrame(
                rows, columns=[*SERIES, "span", "model", "model_order", "forecast", "is_fitted"]
            )

    return spread(histories.select(*SERIES, "history"), SERIES).mapInPandas(fit, schema)


def fit_lengths(clock: Clock) -> dict[str, int]:
    """Days of the two fits: the training days, scored on the holdout, and all observed ones."""
    return {
        "holdout": clock.train_end - clock.observed_start + 1,
        "final": clock.observed_end - clock.observed_start + 1,
    }


def fit_both(daily: DataFrame, clock: Clock) -> DataFrame:
    """Fits of all series on the training days and on all days, made in one pass."""
    histories = history_arrays(daily, clock.observed_start, clock.observed_end)
    return fit_arrays(histories, fit_lengths(clock), clock.horizon)


def of_span(fits: DataFrame, span: str) -> DataFrame:
    return fits.filter(F.col("span") == span).drop("span")


def fit_statistical(
    history: DataFrame,
    last_day: int,
    horizon: int,
    models: tuple[str, ...] = STATISTICAL_MODELS,
) -> DataFrame:
    """Forecast arrays of the statistical models from daily rows up to `last_day`.

    The rows are taken as the history is; missing days are not filled.
    """
    cells = _cells(history.filter(F.col("date_id") <= last_day))
    arrays = cells.select(*SERIES, F.transform("_cells", lambda c: c["units"]).alias("history"))
    return fit_arrays(arrays, {"all": last_day}, horizon, models).drop("span")
