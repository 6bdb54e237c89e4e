"""Forecast baselines and error measures on day-ordered arrays of one series."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def add_up(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _tail(history: Column, n: Column) -> Column:
    return F.slice(history, F.size(history) - n + 1, n)


def naive(history: Column, horizon: int) -> Column:
    return F.array_repeat(F.element_at(history, -1), horizon)


def seasonal_naive(history: Column, horizon: int, period: int = 7) -> Column:
    """The last `period` values over and over; an error on a shorter history."""
    cycle = F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)),
        lambda i: F.element_at(history, F.size(history) - F.lit(period) + i % period + 1),
    )
    return F.when(F.size(history) >= period, cycle).otherwise(
        F.raise_error(F.lit("history shorter than the seasonal period")).cast("array<double>")
    )


def _window(history: Column, window: int) -> Column:
    return F.least(F.size(history), F.lit(window))


def moving_average(history: Column, horizon: int, window: int = 7) -> Column:
    n = _window(history, window)
    return F.array_repeat(add_up(_tail(history, n)) / n, horizon)


def weighted_ma(history: Column, horizon: int, window: int = 7) -> Column:
    """Mean with weights 1..n, the newest value weighing most."""
    n = _window(history, window)
    products = F.zip_with(
        _tail(history, n), F.sequence(F.lit(1), n), lambda value, weight: value * weight
    )
    return F.array_repeat(add_up(products) / (n * (n + 1) / F.lit(2.0)), horizon)


BASELINES = {
    "naive": naive,
    "seasonal_naive": seasonal_naive,
    "moving_average": moving_average,
    "weighted_ma": weighted_ma,
}


def error_metrics(forecast: Column, actual: Column, weight: Column | None = None) -> Column:
    """Struct of MAE, RMSE, WMAE, WRMSE, absolute error, bias and error deviation.

    One fold over the days gives all sums. The weight of a day is its actual
    unless given; a weight sum that is not positive divides by 1.
    """
    w = actual if weight is None else weight
    names = ("n", "size", "square", "signed", "weight", "w_size", "w_square")
    days = F.arrays_zip(forecast.alias("f"), actual.alias("a"), w.alias("w"))
    start = F.struct(*[F.lit(0.0).alias(name) for name in names])

    def add(acc: Column, d: Column) -> Column:
        e = d["f"] - d["a"]
        terms = (F.lit(1.0), F.abs(e), e * e, e, d["w"], d["w"] * F.abs(e), d["w"] * (e * e))
        return F.struct(*[(acc[name] + t).alias(name) for name, t in zip(names, terms)])

    def finish(s: Column) -> Column:
        divisor = F.when(s["weight"] > 0, s["weight"]).otherwise(1.0)
        spread = F.greatest(s["square"] - s["signed"] * s["signed"] / s["n"], F.lit(0.0))
        return F.struct(
            (s["size"] / s["n"]).alias("mae"),
            F.sqrt(s["square"] / s["n"]).alias("rmse"),
            (s["w_size"] / divisor).alias("wmae"),
            F.sqrt(s["w_square"] / divisor).alias("wrmse"),
            s["size"].alias("abs_error"),
            (s["signed"] / s["n"]).alias("bias"),
            F.when(s["n"] > 1, F.sqrt(spread / (s["n"] - 1))).alias("sigma"),
        )

    return F.aggregate(days, start, add, finish)
