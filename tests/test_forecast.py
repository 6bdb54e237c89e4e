from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.config import Clock
from demandspark.functions import arrays
from demandspark.operators import forecast, forecast_fit
from demandspark.operators.forecast_fit import MOVING, SMOOTHING


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_baselines(spark):
    assert value(spark, arrays.naive(doubles([3, 7, 2]), 4)) == [2, 2, 2, 2]
    week = doubles([10, 20, 30, 40, 50, 60, 70])
    assert value(spark, arrays.seasonal_naive(week, 10)) == [10, 20, 30, 40, 50, 60, 70, 10, 20, 30]
    assert value(spark, arrays.moving_average(doubles([2, 4, 6]), 2)) == [4, 4]
    assert value(spark, arrays.weighted_ma(doubles([1, 1, 1, 100]), 1, 4)) == pytest.approx([40.6])
    with pytest.raises(Exception, match="shorter"):
        value(spark, arrays.seasonal_naive(doubles([1, 2]), 3))


def test_error_metrics(spark):
    m = value(spark, arrays.error_metrics(doubles([3, 5, 2]), doubles([2, 8, 4])))
    assert m["mae"] == pytest.approx(2.0) and m["rmse"] == pytest.approx((14 / 3) ** 0.5)
    assert m["bias"] == pytest.approx(-4 / 3)
    assert m["sigma"] == pytest.approx(np.std([1, -3, -2], ddof=1))
    w = value(spark, arrays.error_metrics(doubles([2, 4, 6]), doubles([1, 3, 5])))
    assert w["wmae"] == pytest.approx(1) and w["wrmse"] == pytest.approx(1)
    zero = value(spark, arrays.error_metrics(doubles([1, 1]), doubles([0, 0])))
    assert zero["wmae"] == 0 and zero["sigma"] == 0


SCORED = "product_surr_id int, store_surr_id int, model string, model_order int, wmae double"


def scored(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], SCORED)


def test_selection(spark):
    pick = lambda *rows: forecast.select_for_series(scored(spark, *rows)).first()["model"]
    base = [("naive", 0, 2.0), ("seasonal_naive", 1, 1.0), ("moving_average", 2, 1.0), ("weighted_ma", 3, 3.0)]
    assert pick(*base) == "seasonal_naive"
    assert pick(*base, ("sarima", 5, 0.99)) == "sarima"  # margin met exactly
    assert pick(*base, ("sarima", 5, 0.995)) == "seasonal_naive"
    assert pick(*base, ("ets_holt_winters", 4, 0.9), ("sarima", 5, 0.8)) == "sarima"
    assert pick(("naive", 0, None), ("weighted_ma", 3, None)) == "naive"
    zero = [("naive", 0, 0.0), ("seasonal_naive", 1, 0.0), ("sarima", 5, 0.0)]
    assert pick(*zero) == "naive"


def test_champion_ties_follow_the_order(spark):
    df = spark.createDataFrame([("sarima",), ("naive",), ("sarima",), ("naive",)], "model string")
    assert forecast.champion_model(df).first()["model"] == "naive"


def test_weighted_aggregate(spark):
    rows = [(1, 1, "naive", 0, 1.0), (2, 1, "naive", 0, 3.0)]
    df = spark.createDataFrame(rows, SCORED)
    for m in ("wrmse", "mae", "rmse", "bias"):
        df = df.withColumn(m, F.col("wmae"))
    stats = spark.createDataFrame([(1, 1, 3), (2, 1, 1)], "product_surr_id int, store_surr_id int, total_units int")
    assert forecast.aggregate_metrics(df, stats).first()["wmae"] == pytest.approx(1.5)


def test_intervals(spark):
    chosen = spark.createDataFrame(
        [(1, 1, "naive", 2.0, [10.0]), (2, 1, "naive", None, [10.0]), (3, 1, "naive", 9.0, [10.0])],
        "product_surr_id int, store_surr_id int, model string, sigma double, point array<double>",
    )
    got = {r["product_surr_id"]: (r["lower_bound"], r["upper_bound"]) for r in forecast.final_forecast(chosen, Clock(observed_end=9)).collect()}
    assert got == {1: (6.08, 13.92), 2: (10.0, 10.0), 3: (0.0, 27.64)}


def test_row_local_choice_equals_the_joined_one(spark):
    rng = np.random.default_rng(1)
    clock = Clock(observed_end=100)
    rows = [
        (p, 1, d, int(u))
        for p in range(1, 9)
        for d, u in zip(range(1, 101), rng.poisson(p / 4, 100))
        if u or p == 8
    ]
    daily = spark.createDataFrame(rows, "product_surr_id int, store_surr_id int, date_id int, units_sold int")
    windows = forecast.trailing_window_arrays(daily, forecast.forecast_windows(clock))
    metrics = forecast.evaluate(windows)
    joined = forecast.chosen_forecast(windows, metrics, forecast.select_for_series(metrics), clock=clock)
    local = forecast.chosen_baseline(windows, clock)
    key = lambda r: r["product_surr_id"]
    assert sorted(joined.collect(), key=key) == sorted(local.collect(), key=key)
    series = daily.select("product_surr_id", "store_surr_id").distinct()
    pruned = forecast.trailing_window_arrays(daily, forecast.forecast_windows(clock), series)
    assert sorted(pruned.collect(), key=key) == sorted(windows.collect(), key=key)


def test_contract_and_split(spark):
    schema = "product_surr_id int, store_surr_id int, date_id int, units_sold double, demand_source string"
    good = [(1, 1, d, 1.0, "observed") for d in range(1, 6)]
    gap = [(2, 1, d, 1.0, "observed") for d in (1, 2, 4)]
    twice = [(3, 1, d, 1.0, "observed") for d in (1, 1, 2)]
    nan = [(4, 1, 1, float("nan"), "observed")]
    wrong = [(5, 1, 1, 1.0, "simulated")]
    df = spark.createDataFrame(good + gap + twice + nan + wrong, schema)
    got = {r["product_surr_id"]: r["is_valid"] for r in forecast.series_contract_check(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
    clock = Clock(observed_end=5, horizon=2)
    split = forecast.chronological_split(df.filter("product_surr_id = 1"), clock)
    r = forecast.split_check(split).first()
    assert (r["n_train"], r["n_valid"], r["is_contiguous"]) == (3, 2, True)


def plain_holt_winters(y, horizon, a, b, g):
    first, second = y[:7].mean(), y[7:14].mean()
    level, trend = first, (second - first) / 7
    season, sse = list(y[:7] - first), 0.0
    for t, v in enumerate(y):
        s = season[t % 7]
        e = v - (level + trend + s)
        sse += e * e
        old = level
        level = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        season[t % 7] = g * (v - level) + (1 - g) * s
    n = len(y)
    return sse, [level + h * trend + season[(n + h - 1) % 7] for h in range(1, horizon + 1)]


def plain_airline(y, horizon, th, se):
    w = [y[t] - y[t - 1] - y[t - 7] + y[t - 8] for t in range(8, len(y))]
    c, errors, sse = sum(w) / len(w), [], 0.0
    back = lambda k: errors[-k] if len(errors) >= k else 0.0
    for v in w:
        e = v - c - th * back(1) - se * back(7) - th * se * back(8)
        errors.append(e)
        sse += e * e
    out = list(y)
    for _ in range(horizon):
        step = c + th * back(1) + se * back(7) + th * se * back(8)
        out.append(out[-1] + out[-7] - out[-8] + step)
        errors.append(0.0)
    return sse, out[-horizon:]


def test_fits_match_a_plain_search(spark):
    rng = np.random.default_rng(5)
    y = np.round(20 + 5 * np.sin(np.arange(84) * 2 * np.pi / 7) + rng.normal(0, 2, 84))
    want = min((plain_holt_winters(y, 10, a, b, g) for a in SMOOTHING for b in SMOOTHING for g in SMOOTHING), key=lambda r: r[0])[1]
    assert forecast_fit.holt_winters(y, 10) == pytest.approx(want)
    want = min((plain_airline(y, 10, t, s) for t in MOVING for s in MOVING), key=lambda r: r[0])[1]
    assert forecast_fit.airline(y, 10) == pytest.approx(want)
    rows = [(1, 1, d + 1, int(v)) for d, v in enumerate(y)] + [(2, 1, d + 1, 0) for d in range(84)]
    df = spark.createDataFrame(rows, "product_surr_id int, store_surr_id int, date_id int, units_sold int")
    got = {
        (r["product_surr_id"], r["model"]): r
        for r in forecast_fit.fit_statistical(df.repartition(5), 84, 10).collect()
    }
    assert got[1, "ets_holt_winters"]["forecast"] == pytest.approx(forecast_fit.holt_winters(y, 10))
    assert got[1, "sarima"]["is_fitted"] and not got[2, "sarima"]["is_fitted"]
    assert got[2, "ets_holt_winters"]["forecast"] == [0.0] * 10
    assert forecast_fit.fit_one(y[:20], "sarima", 9)[0].tolist() == [*y[13:20], *y[13:15]]


def test_histories_are_filled_and_fitted_for_several_lengths(spark):
    schema = "product_surr_id int, store_surr_id int, date_id int, units_sold int"
    rng = np.random.default_rng(8)
    kept = {(1, 1): sorted(rng.choice(np.arange(3, 75), 30, replace=False).tolist()), (1, 2): [3, 74], (2, 1): [40]}
    rows = [(p, s, d, int(rng.integers(1, 9))) for (p, s), days in kept.items() for d in days]
    outside = [(1, 1, 2, 100), (1, 1, 75, 100), (9, 9, 80, 5)]
    df = spark.createDataFrame(rows + outside, schema).repartition(6)
    arrays = forecast_fit.history_arrays(df, 3, 74)
    got = {(r[0], r[1]): r.history for r in arrays.collect()}
    want = {k: [0.0] * 72 for k in kept}
    for p, s, d, units in rows:
        want[p, s][d - 3] = float(units)
    assert got == want
    assert forecast_fit.history_arrays(df.limit(0), 3, 74).count() == 0
    fits = forecast_fit.fit_arrays(arrays, {"short": 62, "long": 72}, 10).collect()
    assert len(fits) == len(kept) * 4
    for r in fits:
        y = np.array(want[r.product_surr_id, r.store_surr_id])[: 62 if r.span == "short" else 72]
        forecast, fitted = forecast_fit.fit_one(y, r.model, 10)
        assert r.forecast == pytest.approx(forecast.tolist()) and r.is_fitted == fitted
