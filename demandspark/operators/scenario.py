"""What-if scenarios over all series in one job, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.config import SCENARIOS, SERIES, SIMULATED, Clock, PolicyRules, Scenario
from demandspark.functions.exprs import exact_mean, mean_of_scaled, ratio, scaled, unscaled
from demandspark.operators.replenish import inventory_policy, projection_summary, with_trace
from demandspark.session import spread, stage

RULES = PolicyRules()
SIMULATION_TYPES = (
    "baseline", "demand_shock", "lead_time_change", "service_level_change", "reorder_policy",
)
DELTAS = {
    "stockout_days": "delta_stockout_days",
    "stockout_units": "delta_stockout_units",
    "service_level_achieved": "delta_service_level",
    "fill_rate": "delta_fill_rate",
    "reorder_frequency": "delta_reorder_frequency",
    "total_reorder_units": "delta_total_reorder_units",
    "avg_inventory_position": "delta_avg_inventory_position",
    "excess_days": "delta_excess_days",
    "total_excess_units": "delta_total_excess_units",
    "avg_days_of_inventory": "delta_avg_days_of_inventory",
}
_PARAMETERS = (
    "demand_adjustment_pct", "lead_time_delta_days", "service_level_target",
    "reorder_qty_multiple", "max_order_qty_coverage_days",
)


def _broken_rules(rules: PolicyRules) -> Column:
    """Texts of the rules that a row of a what-if grid breaks."""
    p = {name: F.col(name) for name in _PARAMETERS}
    kind = F.col("scenario_type")
    needs = {
        "demand_shock": ["demand_adjustment_pct"],
        "lead_time_change": ["lead_time_delta_days"],
        "service_level_change": ["service_level_target"],
        "reorder_policy": ["reorder_qty_multiple", "max_order_qty_coverage_days"],
        "baseline": [],
    }
    tests: list[tuple[Column, str]] = [(~kind.isin(*needs), "unknown scenario type")]
    for name, own in needs.items():
        for param, column in p.items():
            if param in own:
                tests.append((
                    (kind == name) & (column.isNull() | F.isnan(column)), f"{param} is required"
                ))
                tests.append(((kind == name) & (F.abs(column) == float("inf")), f"{param} is not finite"))
            else:
                tests.append(((kind == name) & column.isNotNull(), f"{param} is not accepted"))

    def outside(name: str, test: Column, text: str) -> None:
        tests.append(((kind == name) & test, text))

    pct, delta = p["demand_adjustment_pct"], p["lead_time_delta_days"]
    level = p["service_level_target"]
    multiple, cap = p["reorder_qty_multiple"], p["max_order_qty_coverage_days"]
    outside("demand_shock", (pct <= -0.999) | (pct > 10), "demand_adjustment_pct out of bounds")
    outside("lead_time_change", delta + rules.lead_time_days < 1, "lead time below one day")
    outside("service_level_change", (level <= 0) | (level >= 1), "service_level_target out of bounds")
    outside("reorder_policy", (multiple <= 0) | (multiple > 60), "reorder_qty_multiple out of bounds")
    outside("reorder_policy", (cap <= 0) | (cap > 120), "max_order_qty_coverage_days out of bounds")
    outside("reorder_policy", cap < multiple, "cap below the multiple")
    return F.array_compact(F.array(*[F.when(t, F.lit(text)) for t, text in tests]))


def scenario_param_rules(grid: DataFrame, rules: PolicyRules = RULES) -> DataFrame:
    """Rows of a what-if grid with the rules they break, one row per violation.

    Columns: `scenario_type` and one nullable column per parameter. A type
    accepts only its own parameters, and needs them.
    """
    return grid.withColumn("violation", F.explode(_broken_rules(rules)))


def split_grid(grid: DataFrame, rules: PolicyRules = RULES) -> tuple[DataFrame, DataFrame]:
    """The rows of a grid that can be run, and (scenario_id, scenario_name, violation) of the others.

    Columns: `scenario_id`, `scenario_name`, `scenario_type` and the
    parameters. A row also needs a type, an id and a name, and an id of its own.
    """
    # The `isin` of a null type is null, so such a row breaks no rule of the types.
    more = [
        (F.col("scenario_id").isNull(), "scenario_id is required"),
        (F.col("scenario_name").isNull(), "scenario_name is required"),
        (F.col("scenario_type").isNull(), "scenario_type is required"),
        (F.col("_rows") > 1, "scenario_id is not unique"),
    ]
    own = F.array_compact(F.array(*[F.when(t, F.lit(text)) for t, text in more]))
    rows = grid.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_rows"))
    seen = rows.select(F.col("scenario_id").alias("_id"), F.when(F.col("scenario_id").isNotNull(), F.col("_rows")).otherwise(1).alias("_rows"))
    judged = grid.join(seen, grid["scenario_id"].eqNullSafe(seen["_id"])).withColumn("_broken", F.concat(own, _broken_rules(rules)))
    good = judged.filter(F.size("_broken") == 0).select(*grid.columns)
    bad = judged.select("scenario_id", "scenario_name", F.explode("_broken").alias("violation"))
    return good, bad


def weight_rules(weights: DataFrame) -> DataFrame:
    """Violations of ranking weights: each in [0, 1], all together 1."""
    w = F.col("weight")
    single = weights.filter(w.isNull() | (w < 0) | (w > 1)).select(
        "scenario_name", F.lit("weight out of bounds").alias("violation")
    )
    total = (
        weights.groupBy("scenario_name")
        .agg(F.sum("weight").alias("_sum"))
        .filter(F.abs(F.col("_sum") - 1) > 1e-6)
        .select("scenario_name", F.lit("weights do not sum to 1").alias("violation"))
    )
    return single.unionByName(total)


def cost_rules(costs: DataFrame) -> DataFrame:
    """Violations of trade-off costs: costs 0 to 1e12, period 1 to 365 days."""
    h, s, d = (
        F.col(c) for c in ("unit_holding_cost", "stockout_penalty_per_unit", "holding_period_days")
    )
    tests = [
        ((h < 0) | (h > 1e12), "unit_holding_cost out of bounds"),
        ((s < 0) | (s > 1e12), "stockout_penalty_per_unit out of bounds"),
        ((d < 1) | (d > 365), "holding_period_days out of bounds"),
    ]
    broken = F.array_compact(F.array(*[F.when(t, F.lit(text)) for t, text in tests]))
    return costs.withColumn("violation", F.explode(broken))


def _scenario_array(scenarios: tuple[Scenario, ...]) -> Column:
    def number(v: float | None) -> Column:
        return F.lit(v).cast("double")

    return F.array(
        *[
            F.struct(
                F.lit(i).alias("scenario_id"),
                F.lit(s.name).alias("scenario_name"),
                F.lit(s.scenario_type).alias("scenario_type"),
                *[number(getattr(s, name)).alias(f"_{name}") for name in _PARAMETERS],
            )
            for i, s in enumerate(scenarios, start=1)
            if s.scenario_type in SIMULATION_TYPES
        ]
    )


def demand_shock(forecast: Column, pct: Column) -> Column:
    """Forecast times (1 + pct), never below 0; the policy stays as planned."""
    return F.transform(forecast, lambda v: F.greatest(v * (1 + pct), F.lit(0.0)))


def projected_scenarios(
    moments: DataFrame,
    vectors: DataFrame,
    scenarios: tuple[Scenario, ...] = SCENARIOS,
    rules: PolicyRules = RULES,
) -> DataFrame:
    """Every series under every simulated scenario, with policy and trace.

    The scenario list is a literal array exploded per series, so all
    scenarios are sized and projected in one pass without a join to them. The
    series are spread over the tasks before the fold.
    """
    series = spread(moments.join(vectors, SERIES), SERIES)
    return _projected(series.select(series.columns + [F.inline(_scenario_array(scenarios))]), rules)


def in_cells(
    series: DataFrame, rows: DataFrame, key: str, grid_rows: int = 64, series_rows: int = 2048
) -> DataFrame:
    """Every series with the columns of every row of a table of runs, whose `key` is its own.

    All pairs are the result, so they are made in cells: a block of about
    `grid_rows` runs, packed into one row, meets about `series_rows` series.
    Blocks are copied once for each group of series and series once for each
    block; no task holds more than a few cells, whatever the sizes of both
    sides.
    """
    runs = stage(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_run")))
    series = stage(series)
    blocks = max(1, -(-runs.count() // grid_rows))
    groups = max(1, -(-series.count() // series_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = (
        runs.groupBy(F.pmod(F.xxhash64(f"_run.{key}"), F.lit(blocks)).cast("int").alias("_block"))
        .agg(F.collect_list("_run").alias("_runs"))
        .withColumn("_group", every(groups))
    )
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * groups)
    cells = (
        series.withColumn("_group", F.pmod(F.xxhash64(*SERIES), F.lit(groups)).cast("int"))
        .withColumn("_block", every(blocks))
        .repartition(tasks, "_block", "_group")
    )
    # Merged where the cells lie: a broadcast of a small side would gather the folds in few tasks.
    met = cells.hint("merge").join(packed, ["_block", "_group"])
    return met.select(*series.columns, F.inline("_runs"))


def projected_grid(
    moments: DataFrame,
    vectors: DataFrame,
    grid: DataFrame,
    rules: PolicyRules = RULES,
    grid_rows: int = 64,
    series_rows: int = 2048,
) -> DataFrame:
    """Every series under every row of a grid that is a table, with policy and trace; the rows must be sound, see `split_grid`."""
    rows = grid.select(
        "scenario_id", "scenario_name", "scenario_type",
        *[F.col(name).cast("double").alias(f"_{name}") for name in _PARAMETERS],
    )
    return _projected(in_cells(moments.join(vectors, SERIES), rows, "scenario_id", grid_rows, series_rows), rules)


#: Columns of a table of assumption sets, beside `assumption_set_id`.
ASSUMPTIONS = {
    "lead_time_days": "lead_time", "service_level": "service_level", "reorder_qty_multiple": "multiple",
    "max_order_qty_coverage_days": "cap", "starting_coverage_days": "starting_cover", "excess_coverage_days": "excess_cover",
}


def projected_sets(moments: DataFrame, vectors: DataFrame, sets: DataFrame, rules: PolicyRules = RULES) -> DataFrame:
    """Policy and trace of every series under every assumption set, all sets in one pass.

    `sets` has an `assumption_set_id` of its own in each row and any of the
    columns in `ASSUMPTIONS`; a column that is missing, or a null, is the value
    of `rules`.
    """
    given = [c for c in ASSUMPTIONS if c in sets.columns]
    rows = sets.select("assumption_set_id", *[F.coalesce(F.col(c).cast("double"), F.lit(float(getattr(rules, c)))).alias(f"_{c}") for c in given])
    runs = in_cells(moments.join(vectors, SERIES), rows, "assumption_set_id")
    policy = inventory_policy(runs, rules, **{ASSUMPTIONS[c]: F.col(f"_{c}") for c in given})
    return with_trace(policy.drop(*[f"_{c}" for c in given]))


def sensitivity(moments: DataFrame, vectors: DataFrame, sets: DataFrame, rules: PolicyRules = RULES) -> DataFrame:
    """Portfolio outcome of every assumption set."""
    projected = projected_sets(moments, vectors, sets, rules)
    outcome = projection_summary(projected, ["assumption_set_id", *SERIES, "service_level_target"])
    return population_aggregate(outcome, ("assumption_set_id",))


def grid_result(moments: DataFrame, vectors: DataFrame, grid: DataFrame, rules: PolicyRules = RULES) -> DataFrame:
    """One row per series and sound row of a grid, as `scenario_result` gives them."""
    return simulated_results(projected_grid(moments, vectors, split_grid(grid, rules)[0], rules))


def _projected(runs: DataFrame, rules: PolicyRules) -> DataFrame:
    """Sizes and projects rows of a series with the parameters of a scenario."""
    policy = inventory_policy(
        runs,
        rules,
        lead_time=F.round(
            F.lit(rules.lead_time_days) + F.coalesce("_lead_time_delta_days", F.lit(0.0)), 2
        ),
        service_level=F.coalesce("_service_level_target", F.lit(rules.service_level)),
        multiple=F.coalesce("_reorder_qty_multiple", F.lit(rules.reorder_qty_multiple)),
        cap=F.coalesce(
            "_max_order_qty_coverage_days", F.lit(rules.max_order_qty_coverage_days)
        ),
    )
    shocked = policy.withColumn(
        "forecast",
        F.when(
            F.col("_demand_adjustment_pct").isNotNull(),
            demand_shock(F.col("forecast"), F.col("_demand_adjustment_pct")),
        ).otherwise(F.col("forecast")),
    )
    return with_trace(shocked.drop(*[f"_{name}" for name in _PARAMETERS]))


_SNAPSHOT = {
    "expected_daily_demand": 4, "daily_sigma": 4, "cv": 4, "total_units_hist": 2,
    "safety_stock": 4, "reorder_point": 4, "reorder_qty": 4, "starting_inventory": 4,
    "lead_time_days": 2, "service_level_target": 6,
}


def simulated_results(projected: DataFrame) -> DataFrame:
    """Policy snapshot and outcome of each series and simulated scenario."""
    mean, sigma = F.col("mean_daily_units"), F.col("std_daily_units")
    ready = projected.withColumns(
        {
            "cv": F.when(mean > 0, F.coalesce(ratio(sigma, mean), F.lit(0.0))).otherwise(0.0),
            "total_units_hist": F.col("total_units").cast("double"),
        }
    )
    ids = ["scenario_id", "scenario_name", "scenario_type", *SERIES]
    kept = projection_summary(ready, [*ids, *_SNAPSHOT])
    return kept.select(
        *[
            F.round(c, _SNAPSHOT[c]).alias(c) if c in _SNAPSHOT else F.col(c)
            for c in kept.columns
        ],
        F.lit(SIMULATED).alias("data_provenance"),
    )


def scenario_result(
    moments: DataFrame,
    vectors: DataFrame,
    scenarios: tuple[Scenario, ...] = SCENARIOS,
    rules: PolicyRules = RULES,
) -> DataFrame:
    """One row per series and scenario; ranking scenarios repeat the baseline.

    The baseline row turns into itself and one row per ranking scenario, so
    the baseline is projected once.
    """
    simulated = simulated_results(projected_scenarios(moments, vectors, scenarios, rules))
    same = F.struct("scenario_id", "scenario_name", "scenario_type")
    rankings = [
        F.struct(
            F.lit(i).alias("scenario_id"),
            F.lit(s.name).alias("scenario_name"),
            F.lit(s.scenario_type).alias("scenario_type"),
        )
        for i, s in enumerate(scenarios, start=1)
        if s.scenario_type not in SIMULATION_TYPES
    ]
    names = F.when(F.col("scenario_type") == "baseline", F.array(same, *rankings)).otherwise(
        F.array(same)
    )
    rest = [c for c in simulated.columns if not c.startswith("scenario_")]
    return simulated.select(*rest, F.inline(names)).select(
        "scenario_id", "scenario_name", "scenario_type", *rest
    )


def scenario_deltas(results: DataFrame) -> DataFrame:
    """Scenario minus baseline per series for the compared metrics."""
    base = results.filter(F.col("scenario_type") == "baseline").select(
        *SERIES, *[F.col(c).alias(f"_b_{c}") for c in DELTAS]
    )
    return results.join(base, SERIES).select(
        *results.columns,
        *[F.round(F.col(c) - F.col(f"_b_{c}"), 6).alias(out) for c, out in DELTAS.items()],
    )


# -- portfolio --------------------------------------------------------------------------------


def population_aggregate(results: DataFrame, by: tuple[str, ...] = ("scenario_name", "scenario_type")) -> DataFrame:
    """Portfolio totals and means per scenario."""
    total = lambda c: unscaled(F.sum(scaled(F.col(c))))
    mean = lambda c, p=4: mean_of_scaled(F.sum(scaled(F.col(c), p)), F.count(F.lit(1)), p)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_series"),
        mean("avg_inventory_position").alias("avg_inventory_position"),
        mean("avg_on_hand").alias("avg_on_hand"),
        total("total_reorder_units").alias("total_reorder_units"),
        F.sum("reorder_frequency").alias("total_reorder_frequency"),
        mean("service_level_achieved", 6).alias("mean_service_level"),
        F.count_if(F.col("service_level_achieved") < F.col("service_level_target")).alias(
            "series_below_target"
        ),
        F.sum("stockout_days").alias("total_stockout_days"),
        total("stockout_units").alias("total_stockout_units"),
        F.count_if(F.col("stockout_days") > 0).alias("series_with_stockout"),
        F.sum("excess_days").alias("total_excess_days"),
        total("total_excess_units").alias("total_excess_units"),
        F.count_if(F.col("total_excess_units") > 0).alias("series_with_excess"),
        mean("avg_days_of_inventory").alias("mean_avg_days_of_inventory"),
    )


def tradeoff_monetary(
    avg_position: dict[str, Column],
    stockout_units: dict[str, Column],
    holding_cost: float | None,
    penalty: float | None,
    days: float = 28.0,
) -> dict[str, Column]:
    """Cost columns, only for the cost assumptions that are given."""
    out: dict[str, Column] = {}
    if holding_cost is not None:
        cost = lambda c: F.round(F.lit(holding_cost) * c * F.lit(days), 6)
        out["baseline_holding_cost"] = cost(avg_position["baseline"])
        out["scenario_holding_cost"] = cost(avg_position["scenario"])
        out["delta_holding_cost"] = cost(avg_position["scenario"] - avg_position["baseline"])
    if penalty is not None:
        cost = lambda c: F.round(F.lit(penalty) * c, 6)
        out["baseline_stockout_cost"] = cost(stockout_units["baseline"])
        out["scenario_stockout_cost"] = cost(stockout_units["scenario"])
        out["delta_stockout_cost"] = cost(stockout_units["scenario"] - stockout_units["baseline"])
    return out


_BLOCKS = {
    "inventory_exposure": (
        "avg_inventory_position", "total_reorder_units", "total_reorder_frequency",
    ),
    "service_level_effect": ("mean_service_level", "series_below_target"),
    "stockout_impact": ("total_stockout_days", "total_stockout_units", "series_with_stockout"),
    "excess_impact": ("total_excess_days", "total_excess_units", "series_with_excess"),
}


def action_tradeoff(
    population: DataFrame,
    holding_cost: float | None = None,
    penalty: float | None = None,
    days: float = 28.0,
    target: str | None = None,
    baseline: str | None = None,
) -> DataFrame:
    """Baseline, scenario and difference of each measure, in blocks.

    `population` has one row per scenario; the row compared with is read as a
    scalar. That is the scenario named `baseline`, or the one of that type;
    `target` names the only one compared, all others without it. `days` is the
    period that stock is held for, 1 to 365.
    """
    if not 1 <= days <= 365:
        raise ValueError("a holding period is 1 to 365 days")
    measures = [m for block in _BLOCKS.values() for m in block]
    is_base = F.col("scenario_type") == "baseline" if baseline is None else F.col("scenario_name") == baseline
    base = population.filter(is_base).agg(F.max(F.struct(*measures))).scalar()
    others = population.filter(~is_base if target is None else F.col("scenario_name") == target).withColumn("_b", base)

    def block(names: tuple[str, ...]) -> Column:
        fields = []
        for m in names:
            fields += [
                F.col(f"_b.{m}").alias(f"baseline_{m}"),
                F.col(m).alias(f"scenario_{m}"),
                F.round(F.col(m) - F.col(f"_b.{m}"), 6).alias(f"delta_{m}"),
            ]
        return F.struct(*fields)

    money = tradeoff_monetary(
        {"baseline": F.col("_b.avg_inventory_position"), "scenario": F.col("avg_inventory_position")},
        {"baseline": F.col("_b.total_stockout_units"), "scenario": F.col("total_stockout_units")},
        holding_cost,
        penalty,
        days,
    )
    monetary = (
        F.struct(*[c.alias(n) for n, c in money.items()])
        if money
        else F.lit(None).cast("struct<delta_holding_cost:double>")
    )
    return others.select(
        "scenario_name",
        F.lit(baseline or "baseline").alias("baseline_scenario"),
        "n_series",
        *[block(names).alias(name) for name, names in _BLOCKS.items()],
        monetary.alias("monetary"),
        F.lit(SIMULATED).alias("data_provenance"),
    )


def scenario_delta_means(deltas: DataFrame) -> DataFrame:
    """Mean deltas of each scenario but the baseline."""
    names = (
        "delta_stockout_days", "delta_service_level", "delta_fill_rate",
        "delta_reorder_frequency", "delta_avg_inventory_position", "delta_excess_days",
        "delta_avg_days_of_inventory",
    )
    return (
        deltas.filter(F.col("scenario_type") != "baseline")
        .groupBy("scenario_id", "scenario_name", "scenario_type")
        .agg(
            *[
                exact_mean(F.col(c), 6).alias(c)
                for c in names
            ],
            F.count(F.lit(1)).alias("series_count"),
        )
    )


def scenario_runs(results: DataFrame, set_id: int = 1) -> DataFrame:
    """Run listing with the rows each scenario produced and its final status."""
    return (
        results.groupBy("scenario_id", "scenario_name", "scenario_type")
        .agg(F.count(F.lit(1)).alias("records_processed"))
        .withColumns(
            {
                "assumption_set_id": F.lit(set_id),
                "status": F.when(F.col("records_processed") > 0, "success").otherwise("failed"),
                "data_provenance": F.lit(SIMULATED),
            }
        )
        .orderBy("scenario_id")
    )


def reproducibility_record(
    results: DataFrame,
    clock: Clock,
    scenarios: tuple[Scenario, ...] = SCENARIOS,
    rules: PolicyRules = RULES,
) -> DataFrame:
    """One JSON record per scenario: definition, effective values, rows, horizon."""
    effective = results.groupBy("scenario_name", "scenario_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("lead_time_days").alias("lead_time_days"),
        F.max("service_level_target").alias("service_level_target"),
    )
    multiple, shock = F.lit(rules.reorder_qty_multiple), F.lit(0.0)
    for s in scenarios:
        here = F.col("scenario_name") == s.name
        if s.reorder_qty_multiple is not None:
            multiple = F.when(here, s.reorder_qty_multiple).otherwise(multiple)
        if s.demand_adjustment_pct is not None:
            shock = F.when(here, s.demand_adjustment_pct).otherwise(shock)
    record = effective.withColumns(
        {
            "reorder_qty_multiple": multiple,
            "demand_adjustment_pct": shock,
            "horizon_start": F.lit(clock.forecast_start),
            "horizon_end": F.lit(clock.forecast_end),
        }
    )
    return record.withColumn("record", F.to_json(F.struct(*record.columns)))


def best_scenario(results: DataFrame, metric: str, lower_is_better: bool) -> DataFrame:
    """Best and second alternative by the total change of a metric.

    One row per scenario is ranked.
    """
    totals = (
        results.filter(F.col("scenario_type").isin(*SIMULATION_TYPES[1:]))
        .groupBy("scenario_name")
        .agg((F.sum(F.round(F.col(metric) * 1e6).cast("long")) / 1e6).alias("total_delta"))
    )
    order = F.asc("total_delta") if lower_is_better else F.desc("total_delta")
    w = W.orderBy(order, F.asc("scenario_name"))
    return totals.withColumn("place", F.row_number().over(w)).filter("place <= 2").select(
        F.lit(metric).alias("metric"), "place", "scenario_name", "total_delta"
    )
