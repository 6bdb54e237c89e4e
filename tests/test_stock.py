from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from demandspark.config import Clock, SERIES, Scenario
from demandspark.functions.exprs import tier, z_service
from demandspark.config import RISK_TIERS
from demandspark.operators import replenish, risk, scenario
from demandspark.session import stage

Z95 = 1.6448536269514722


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_z_service(spark):
    assert value(spark, z_service(F.lit(0.95))) == Z95
    assert value(spark, z_service(F.lit(0.5))) == pytest.approx(0, abs=1e-9)
    assert value(spark, z_service(F.lit(0.975))) == pytest.approx(1.959964, abs=1e-6)
    assert value(spark, z_service(F.lit(0.01))) == pytest.approx(-2.326348, abs=1e-6)
    for bad in (0.0, 1.0):
        with pytest.raises(Exception, match="service level"):
            value(spark, z_service(F.lit(bad)))


def moments(spark, *rows):
    return spark.createDataFrame(
        [(i, 1, 1000, float(m), float(s)) for i, (m, s) in enumerate(rows, start=1)],
        "product_surr_id int, store_surr_id int, total_units long, mean_daily_units double, std_daily_units double",
    )


def test_policy(spark):
    r = replenish.inventory_policy(moments(spark, (10, 4))).first()
    assert r["safety_stock"] == pytest.approx(Z95 * 4 * math.sqrt(7), abs=1e-6)
    assert r["reorder_point"] == pytest.approx(70 + r["safety_stock"]) and r["reorder_qty"] == 70
    assert r["starting_inventory"] == 70
    zero = replenish.inventory_policy(moments(spark, (0, 0))).first()
    assert zero["reorder_qty"] == 0 and zero["safety_stock"] == 0
    capped = replenish.inventory_policy(moments(spark, (50, 1)), cap=F.lit(2.0)).first()
    assert capped["reorder_qty"] == 100
    assert replenish.policy_validation(replenish.inventory_policy(moments(spark, (10, 4)))).count() == 0


def brute_force(f, start, rop, q, lead):
    on_hand, on_order, backlog, pending, out = start, 0.0, 0.0, {}, []
    for i, demand in enumerate(f):
        begin = on_hand
        arrived = pending.pop(i, 0.0)
        on_hand, on_order = on_hand + arrived, on_order - arrived
        total = demand + backlog
        served = min(on_hand, total)
        on_hand, backlog = on_hand - served, total - served
        placed = q if on_hand + on_order - backlog <= rop and q > 0 else 0.0
        if placed:
            on_order += placed
            pending[i + lead] = placed
        out.append((begin, on_hand, on_order, backlog, on_hand + on_order - backlog, placed))
    return out


def trace(spark, f, start, rop, q, lead):
    column = replenish.projection_trace(
        F.array(*[F.lit(float(x)) for x in f]), F.lit(float(start)), F.lit(float(rop)), F.lit(float(q)), F.lit(lead)
    )
    return value(spark, column)


def test_arrival(spark):
    days = trace(spark, [6, 2], 10, 5, 50, 1)
    assert [d["on_hand"] for d in days] == [4, 52]
    assert [d["inventory_position"] for d in days] == [54, 52]
    assert sum(d["reorder_qty"] > 0 for d in days) == 1


def test_cycle(spark):
    days = trace(spark, [5] * 28, 3, 5, 50, 7)
    assert sum(d["unmet"] > 0 for d in days) == 19
    assert sum(d["reorder_qty"] > 0 for d in days) == 3
    assert days[-1]["on_hand"] == 13 and days[-1]["backlog"] == 0


def test_trace_matches_brute_force(spark):
    rng = random.Random(2)
    for lead in (1, 3, 7, 30):
        f = [rng.choice([0, 0, 1, 4, 9]) for _ in range(28)]
        args = (f, rng.randint(0, 20), rng.randint(0, 25), rng.randint(0, 15), lead)
        got = [
            (d["starting_inventory"], d["on_hand"], d["on_order"], d["backlog"], d["inventory_position"], d["reorder_qty"])
            for d in trace(spark, *args)
        ]
        assert got == brute_force(*args)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    m = moments(spark, *[(rng.uniform(0, 12), rng.uniform(0, 9)) for _ in range(30)])
    rows = [(i, 1, [round(rng.uniform(0, 15), 4) for _ in range(28)]) for i in range(1, 31)]
    return m, spark.createDataFrame(rows, "product_surr_id int, store_surr_id int, forecast array<double>")


def test_projection_identities_and_replay(case):
    m, v = case
    policy = replenish.inventory_policy(m)
    traced = replenish.with_trace(policy.join(v, SERIES))
    days = replenish.inventory_projection(traced, Clock(observed_end=2499))
    assert days.count() == 30 * 28
    check = replenish.trace_replay_check(days, policy)
    bad = [c for c in check.columns if c.startswith("bad_")]
    assert check.agg(*[F.sum(c).alias(c) for c in bad]).first().asDict() == dict.fromkeys(bad, 0)
    broken = days.withColumn("on_hand", F.when(F.col("day_id") == 2510, F.col("on_hand") + 1).otherwise(F.col("on_hand")))
    assert replenish.trace_replay_check(broken, policy).agg(F.sum("bad_on_hand")).first()[0] > 0
    long = days.groupBy(*SERIES).agg(
        F.count_if("projected_stockout").alias("n"), F.round(F.avg("on_hand"), 3).alias("oh")
    )
    summary = replenish.projection_summary(traced, SERIES)
    both = summary.join(long, SERIES).collect()
    assert all(r["stockout_days"] == r["n"] and r["avg_on_hand"] == pytest.approx(r["oh"], abs=1e-3) for r in both)


def test_scenarios(case):
    m, v = case
    rows = stage(scenario.scenario_result(m, v))
    assert rows.count() == 30 * 7
    by = {(r["scenario_name"], r["product_surr_id"]): r for r in rows.collect()}
    for i in range(1, 31):
        base, shock = by["baseline", i], by["demand_shock_p20", i]
        assert shock["reorder_point"] == base["reorder_point"]
        assert shock["total_demand"] == pytest.approx(base["total_demand"] * 1.2, abs=1e-2)
        assert by["lead_time_plus_2d", i]["safety_stock"] == pytest.approx(
            base["safety_stock"] * math.sqrt(9 / 7), abs=1e-3
        )
        assert by["service_level_99", i]["safety_stock"] >= base["safety_stock"]
        assert by["reorder_policy_alt", i]["reorder_qty"] == pytest.approx(base["reorder_qty"] * 2, abs=1e-3)
        assert by["excess_risk_rank", i]["stockout_units"] == base["stockout_units"]
    deltas = scenario.scenario_deltas(rows).filter("scenario_name = 'baseline'")
    assert deltas.filter("delta_stockout_days <> 0 or delta_fill_rate <> 0").count() == 0
    ranked = risk.risk_fact(rows)
    for kind in ("stockout", "excess"):
        got = ranked.filter(F.col("risk_type") == kind).orderBy("risk_rank").collect()
        assert [r["risk_rank"] for r in got] == list(range(1, 31))
        assert all(a["risk_score"] >= b["risk_score"] for a, b in zip(got, got[1:]))
        assert all(f'"dominant":"{r["dominant"]}"' in r["risk_components"] for r in got)


def test_demand_shock_never_negative(spark):
    f = F.array(F.lit(10.0), F.lit(10.0))
    assert value(spark, scenario.demand_shock(f, F.lit(0.1))) == pytest.approx([11, 11])
    assert value(spark, scenario.demand_shock(f, F.lit(-0.5))) == [5, 5]
    assert value(spark, scenario.demand_shock(f, F.lit(-1.5))) == [0, 0]


def test_parameter_rules(spark):
    schema = (
        "scenario_type string, demand_adjustment_pct double, lead_time_delta_days double,"
        " service_level_target double, reorder_qty_multiple double, max_order_qty_coverage_days double"
    )
    good = [
        ("demand_shock", 0.2, None, None, None, None), ("lead_time_change", None, -6.0, None, None, None),
        ("service_level_change", None, None, 0.99, None, None), ("reorder_policy", None, None, None, 14.0, 28.0),
    ]
    bad = [
        ("demand_shock", -0.999, None, None, None, None), ("demand_shock", None, None, None, None, None),
        ("demand_shock", 0.1, 2.0, None, None, None), ("lead_time_change", None, -6.5, None, None, None),
        ("service_level_change", None, None, 1.0, None, None), ("reorder_policy", None, None, None, 30.0, 20.0),
        ("magic", None, None, None, None, None),
    ]
    assert scenario.scenario_param_rules(spark.createDataFrame(good, schema)).count() == 0
    found = scenario.scenario_param_rules(spark.createDataFrame(bad, schema))
    assert found.count() == len(bad)
    weights = spark.createDataFrame([("a", 0.5), ("a", 0.4), ("b", 1.0)], "scenario_name string, weight double")
    assert [r["scenario_name"] for r in scenario.weight_rules(weights).collect()] == ["a"]
    costs = spark.createDataFrame(
        [(1.0, 2.0, 28.0), (-1.0, None, 400.0)],
        "unit_holding_cost double, stockout_penalty_per_unit double, holding_period_days double",
    )
    assert scenario.cost_rules(costs).count() == 2


def test_tiers(spark):
    labels = [value(spark, tier(F.lit(s), RISK_TIERS)) for s in (1.0, 0.7, 0.69, 0.45, 0.25, 0.05)]
    assert labels == ["Critical", "Critical", "High", "High", "Medium", "Low"]


def test_what_if_list_of_your_own(case):
    m, v = case
    mine = (Scenario("baseline", "baseline"), Scenario("drop", "demand_shock", demand_adjustment_pct=-0.5))
    got = scenario.scenario_result(m, v, mine)
    assert {r["scenario_name"] for r in got.select("scenario_name").distinct().collect()} == {"baseline", "drop"}
    population = scenario.population_aggregate(stage(got))
    r = scenario.action_tradeoff(population, holding_cost=0.1).first()
    assert r["stockout_impact"]["delta_total_stockout_units"] <= 0
    assert r["monetary"]["delta_holding_cost"] == pytest.approx(
        0.1 * 28 * (r["monetary"]["scenario_holding_cost"] - r["monetary"]["baseline_holding_cost"]) / 2.8, abs=1e-3
    )
    assert scenario.action_tradeoff(population).first()["monetary"] is None
