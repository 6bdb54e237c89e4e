"""Statistical winners carried through stock, scenarios and ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.config import BASELINE_MODELS, MODEL_ORDER, SERIES
from demandspark.operators.forecast_fit import fit_one
from demandspark.plans.retail import RetailTables

STATISTICAL = ("ets_holt_winters", "sarima")


def rows(df, *columns):
    return {(r[0], r[1]): tuple(r[2:]) for r in df.select(*SERIES, *columns).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    t = RetailTables(spark, "/root/testdata/sf0.001")
    return t, t.with_fits


def plain_choice(y, horizon=28):
    """Best baseline by holdout error weighted by the actual, unless a fit beats it by one percent."""
    train, actual = y[:-horizon], y[-horizon:]

    def forecast(past, model):
        last = past[-7:]
        weights = np.arange(1, 8)
        return {
            "naive": lambda: np.repeat(past[-1], horizon),
            "seasonal_naive": lambda: np.resize(last, horizon),
            "moving_average": lambda: np.repeat(last.mean(), horizon),
            "weighted_ma": lambda: np.repeat((last * weights).sum() / 28, horizon),
        }.get(model, lambda: fit_one(past, model, horizon)[0])()

    def score(model):
        error = np.abs(forecast(train, model) - actual)
        return round(float((actual * error).sum() / (actual.sum() if actual.sum() > 0 else 1)), 9)

    scores = {m: score(m) for m in MODEL_ORDER}
    best = min(BASELINE_MODELS, key=lambda m: (scores[m], MODEL_ORDER.index(m)))
    winners = [m for m in STATISTICAL if scores[best] > 0 and (scores[best] - scores[m]) / scores[best] >= 0.01]
    model = min(winners, key=lambda m: (scores[m], MODEL_ORDER.index(m))) if winners else best
    return model, forecast(y, model)


def test_chosen_models_equal_a_plain_search(tables):
    _, full = tables
    chosen = rows(full.chosen, "model", "point")
    days = full.clock.observed_end
    wanted = sorted(chosen)[::9]
    held = {k: np.zeros(days) for k in wanted}
    for r in full.daily.collect():
        if (r.product_surr_id, r.store_surr_id) in held:
            held[r.product_surr_id, r.store_surr_id][r.date_id - 1] = r.units_sold
    for key, y in held.items():
        model, point = plain_choice(y)
        assert chosen[key][0] == model
        assert np.allclose(chosen[key][1], point, atol=1e-9)


def test_stock_and_ranks_follow_the_full_choice(tables):
    base, full = tables
    model = {k: m for k, (m,) in rows(full.chosen, "model").items()}
    moved = {k for k, m in model.items() if m in STATISTICAL}
    assert 0 < len(moved) < len(model)
    vectors, before = rows(full.vectors, "forecast"), rows(base.vectors, "forecast")
    assert all(vectors[k] == before[k] for k in model if k not in moved)
    changed = {k for k in moved if vectors[k] != before[k]}
    assert len(changed) > len(moved) / 2
    demand, was = rows(full.baseline, "total_demand"), rows(base.baseline, "total_demand")
    assert {k for k in model if demand[k] != was[k]} <= changed
    for k, (total,) in demand.items():
        assert total == pytest.approx(sum(vectors[k][0]), abs=1e-6)
    ranks = [r.risk_rank for r in full.ranked.filter("risk_type = 'stockout'").collect()]
    assert sorted(ranks) == list(range(1, len(model) + 1))
    assert full.projection.count() == 28 * len(model)


def test_written_layers_fit_from_the_written_days(spark, tables, tmp_path):
    from demandspark.plans.layers import write_layers

    _, full = tables
    paths = write_layers(full, str(tmp_path))
    written = spark.read.parquet(paths["fact_forecast"]).withColumn("p", F.col("forecast_value").cast("double"))
    key = (*SERIES, "forecast_horizon", "model")
    lazy = {tuple(r[:4]): r[4] for r in full.final.select(*key, "forecast_value").collect()}
    got = {tuple(r[:4]): r[4] for r in written.select(*key, "p").collect()}
    assert got.keys() == lazy.keys() and any(k[3] in STATISTICAL for k in got)
    assert all(got[k] == pytest.approx(lazy[k], abs=1e-4) for k in got)
    scored = spark.read.parquet(paths["fact_forecast_evaluation"])
    assert {r.model for r in scored.select("model").distinct().collect()} == set(MODEL_ORDER)
