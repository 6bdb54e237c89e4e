from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.operators import demand
from demandspark.operators.facts import densify_daily


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_growth_guard(spark):
    rows = [(120.0, 100.0), (50.0, 0.0), (50.0, 1e-12), (80.0, 100.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "r double, p double")
    got = df.select(*[c.alias(n) for n, c in demand.growth_guard(F.col("r"), F.col("p")).items()])
    rates = [r["demand_growth_rate"] for r in got.collect()]
    assert rates[0] == pytest.approx(0.2) and rates[3] == pytest.approx(-0.2)
    assert rates[1] is rates[2] is rates[4] is None
    flags = [(r["growth_is_defined"], r["growth_denominator_zero"]) for r in got.collect()]
    assert flags == [(True, False), (False, True), (False, True), (True, False), (False, False)]


def test_trend(spark):
    e = lambda s, n, m: demand.trend_effect(F.lit(s), F.lit(n), F.lit(m))
    r = one(
        spark, a=e(0.5, 365, 50.0), b=e(0.5, 10, 50.0), c=e(0.5, 365, 0.0),
        up=demand.trend_direction(e(0.5, 365, 50.0)), flat=demand.trend_direction(e(0.5, 10, 50.0)),
        down=demand.trend_direction(e(-0.5, 365, 50.0)),
    )
    assert r["a"] == pytest.approx(365.0) and r["b"] is None and r["c"] is None
    assert (r["up"], r["flat"], r["down"]) == ("increasing", "flat", "decreasing")


def test_segments(spark):
    volumes = [one(spark, v=demand.segment_volume(F.lit(x), F.lit(100), F.lit(200)))["v"] for x in (10, 150, 250)]
    assert volumes == ["Low", "Medium", "High"]
    cv = [one(spark, v=demand.segment_volatility(F.lit(x).cast("double")))["v"] for x in (0.2, 0.7, 1.5, None)]
    assert cv == ["Low", "Medium", "High", "High"]
    zero = [one(spark, v=demand.classify_demand(F.lit(x).cast("double")))["v"] for x in (0.2, 0.6, 0.85, 0.95, None)]
    assert zero == ["Smooth", "Erratic", "Lumpy", "Intermittent", "Intermittent"]
    r = one(spark, **demand.risk_matrix(F.lit("High"), F.lit("High")))
    assert (r["risk_cell"], r["risk_index"], r["risk_category"]) == ("High*High", 9, "Critical")


def _monthly(spark, means):
    rows = [(1, 1, m, float(v), 4) for m, v in means.items()]
    return spark.createDataFrame(
        rows, "product_surr_id int, store_surr_id int, month int, mean_weekly double, obs_weeks long"
    )


def test_seasonality(spark):
    peak = demand.monthly_seasonality(_monthly(spark, {**dict.fromkeys(range(1, 12), 50), 12: 100}))
    r = peak.filter("month = 12").first()
    assert r["has_meaningful_seasonality"] and r["peak_month"] == 12 and r["trough_month"] == 1
    short = demand.monthly_seasonality(_monthly(spark, {1: 5, 2: 9})).first()
    assert not short["has_meaningful_seasonality"]
    flat = demand.monthly_seasonality(_monthly(spark, dict.fromkeys(range(1, 13), 50))).first()
    assert flat["seasonality_strength"] == pytest.approx(0) and not flat["has_meaningful_seasonality"]
    assert demand.seasonality_fact(demand.monthly_seasonality(_monthly(spark, {1: 5}))).count() == 0


def test_dow_factors_from_means(spark):
    rows = [(d, 100.0 if d in (6, 7) else 50.0) for d in range(1, 8)]
    df = spark.createDataFrame(rows, "weekday int, mean_daily double").withColumn("k", F.lit(1))
    got = {r["weekday"]: r["dow_factor"] for r in demand.dow_factors_from_means(df, ["k"]).collect()}
    assert got[1] == pytest.approx(0.7778, abs=1e-4) and got[6] == pytest.approx(1.5556, abs=1e-4)


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(3)
    rows = [
        (p, 1, int(d), int(rng.integers(1, 60)), "observed")
        for p in (1, 2, 3)
        for d in sorted(rng.choice(np.arange(1, 201), 40 * p, replace=False))
    ]
    return rows, spark.createDataFrame(
        rows, "product_surr_id int, store_surr_id int, date_id int, units_sold int, demand_source string"
    )


def test_sparse_and_dense_stats_agree_with_numpy(sparse):
    rows, df = sparse
    a = {r["product_surr_id"]: r for r in demand.demand_stats(df, 1, 200).collect()}
    b = {r["product_surr_id"]: r for r in demand.demand_stats(densify_daily(df, 1, 200)).collect()}
    assert a == b
    for p in (1, 2, 3):
        y = np.zeros(200)
        for q, _, d, u, _ in rows:
            if q == p:
                y[d - 1] = u
        r = a[p]
        assert r["total_units"] == y.sum() and r["zero_demand_days"] == (y == 0).sum()
        assert r["std_daily_units"] == pytest.approx(y.std(ddof=1), abs=1e-4)
        assert r["trend_slope"] == pytest.approx(np.polyfit(np.arange(1, 201), y, 1)[0], abs=1e-7)
        # a true ratio, not one cut to a whole number
        assert r["demand_growth_rate"] == pytest.approx(
            y[-28:].sum() / y[-56:-28].sum() - 1, abs=1e-6
        )


def test_densify_fills_every_day(sparse):
    rows, df = sparse
    dense = densify_daily(df, 1, 200)
    assert dense.count() == 600
    assert dense.agg(F.sum("units_sold")).first()[0] == sum(r[3] for r in rows)
    assert dense.groupBy("product_surr_id", "date_id").count().filter("count > 1").count() == 0
