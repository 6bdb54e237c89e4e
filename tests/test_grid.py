"""What-if grids that are tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from demandspark.config import SCENARIOS, SERIES, PolicyRules
from demandspark.operators import replenish, scenario

PARAMETERS = ("demand_adjustment_pct", "lead_time_delta_days", "service_level_target", "reorder_qty_multiple", "max_order_qty_coverage_days")
KIND = "scenario_id int, scenario_name string, scenario_type string, " + ", ".join(f"{p} double" for p in PARAMETERS)


def grid(spark, rows):
    return spark.createDataFrame([(i, n, t, *(given.get(p) for p in PARAMETERS)) for i, n, t, given in rows], KIND)


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    moments, vectors = [], []
    for p in range(1, 8):
        for s in range(1, 7):
            mean = rnd.choice([0.0, 0.5, 3.25, 40.0])
            moments.append((p, s, rnd.randrange(5000), mean, rnd.random() * 5))
            vectors.append((p, s, [round(max(0.0, rnd.gauss(mean, 2)), 4) for _ in range(28)]))
    return (
        spark.createDataFrame(moments, "product_surr_id int, store_surr_id int, total_units bigint, mean_daily_units double, std_daily_units double"),
        spark.createDataFrame(vectors, "product_surr_id int, store_surr_id int, forecast array<double>"),
    )


def test_a_grid_equals_the_scenario_list_where_they_meet(spark, series):
    listed = [(i, s.name, s.scenario_type, {p: getattr(s, p) for p in PARAMETERS}) for i, s in enumerate(SCENARIOS, 1) if s.scenario_type in scenario.SIMULATION_TYPES]
    more = [(100 + k, f"shock {k}", "demand_shock", {"demand_adjustment_pct": k / 50 - 0.9}) for k in range(90)]
    table = grid(spark, listed + more)
    good, bad = scenario.split_grid(table)
    assert bad.count() == 0
    projected = scenario.projected_grid(*series, good, grid_rows=16, series_rows=8)
    got = scenario.simulated_results(projected)
    want = scenario.scenario_result(*series).filter(F.col("scenario_id").isin([r[0] for r in listed]))
    columns = sorted(want.columns)
    pick = lambda df: sorted(tuple(r) for r in df.filter("scenario_id < 100").select(columns).collect())
    rows = pick(got)
    assert rows == pick(want) and len(rows) == 42 * len(listed)
    assert got.count() == 42 * len(listed + more)
    no_shock = got.filter("scenario_name = 'shock 45'").agg(F.sum("total_demand")).first()[0]
    assert no_shock == pytest.approx(got.filter("scenario_type = 'baseline'").agg(F.sum("total_demand")).first()[0])


def test_no_task_holds_more_than_a_few_cells(spark, series):
    table = grid(spark, [(k, f"lead {k}", "lead_time_change", {"lead_time_delta_days": float(k % 9)}) for k in range(400)])
    runs = scenario.projected_grid(*series, table, grid_rows=20, series_rows=10).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in runs.groupBy("task").count().collect()]
    assert sum(sizes) == 400 * 42
    assert len(sizes) > 40 and max(sizes) <= 8 * 20 * 10


def test_rows_that_break_rules_are_split_off(spark):
    rows = [
        (1, "ok", "baseline", {}),
        (2, "low", "demand_shock", {"demand_adjustment_pct": -1.0}),
        (3, "twice", "baseline", {}),
        (3, "twice", "baseline", {}),
        (None, "a", "baseline", {}),
        (None, "b", "baseline", {}),
        (4, None, "baseline", {}),
        (5, "no type", None, {}),
        (6, "two", "reorder_policy", {"reorder_qty_multiple": 61.0, "max_order_qty_coverage_days": 60.0}),
        (7, "nan", "service_level_change", {"service_level_target": float("nan")}),
        (8, "strange", "stockout_risk_prioritization", {}),
    ]
    good, bad = scenario.split_grid(grid(spark, rows))
    assert [r.scenario_name for r in good.collect()] == ["ok"]
    found = {}
    for r in bad.collect():
        found.setdefault((r.scenario_id, r.scenario_name), set()).add(r.violation)
    assert found[3, "twice"] == {"scenario_id is not unique"}
    assert found[None, "a"] == found[None, "b"] == {"scenario_id is required"}
    assert found[4, None] == {"scenario_name is required"} and "scenario_type is required" in found[5, "no type"]
    assert found[6, "two"] == {"reorder_qty_multiple out of bounds", "cap below the multiple"}
    assert "service_level_target is required" in found[7, "nan"] and found[8, "strange"] == {"unknown scenario type"}


def test_an_empty_grid_gives_no_rows(spark, series):
    assert scenario.grid_result(*series, grid(spark, [])).count() == 0


def test_assumption_sets_equal_runs_with_their_own_rules(spark, series):
    moments, vectors = series
    own = {1: PolicyRules(), 2: PolicyRules(lead_time_days=3.0, service_level=0.9, reorder_qty_multiple=10.0, max_order_qty_coverage_days=9.0, starting_coverage_days=2.0, excess_coverage_days=14.0), 3: PolicyRules(lead_time_days=12.0)}
    names = list(scenario.ASSUMPTIONS)
    rows = [(1, *[None] * 6), (2, *[getattr(own[2], c) for c in names]), (3, 12.0, *[None] * 5)]
    sets = spark.createDataFrame(rows, "assumption_set_id int, " + ", ".join(f"{c} double" for c in names))
    keep = [*SERIES, "service_level_target", "reorder_point", "starting_inventory", "excess_coverage_days"]
    got = replenish.projection_summary(scenario.projected_sets(moments, vectors, sets), ["assumption_set_id", *keep])
    for k, rules in own.items():
        want = replenish.projection_summary(replenish.with_trace(replenish.inventory_policy(moments.join(vectors, SERIES), rules)), keep)
        mine = got.filter(F.col("assumption_set_id") == k).select(want.columns)
        assert sorted(map(tuple, mine.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    view = {r.assumption_set_id: r for r in scenario.sensitivity(moments, vectors, sets).collect()}
    assert set(view) == set(own) and all(r.n_series == 42 for r in view.values())
    assert scenario.sensitivity(moments, vectors, sets.select("assumption_set_id").limit(1)).first().n_series == 42


def test_a_trade_off_of_one_action(spark, series):
    population = scenario.population_aggregate(scenario.scenario_result(*series))
    one = scenario.action_tradeoff(population, 2.0, 3.0, days=10.0, target="service_level_99", baseline="lead_time_plus_2d").collect()
    held = {r.scenario_name: r for r in population.collect()}
    a, b = held["service_level_99"], held["lead_time_plus_2d"]
    assert len(one) == 1 and one[0].baseline_scenario == "lead_time_plus_2d"
    assert one[0].monetary.scenario_holding_cost == pytest.approx(20 * a.avg_inventory_position)
    assert one[0].monetary.delta_stockout_cost == pytest.approx(3 * (a.total_stockout_units - b.total_stockout_units))
    with pytest.raises(ValueError):
        scenario.action_tradeoff(population, 2.0, days=366.0)
