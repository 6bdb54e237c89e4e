"""Writes every layer once, each read from the written layer below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.config import (
    DERIVED,
    OBSERVED,
    SERIES,
    SIMULATED,
    assumption_set_row,
    demand_rule_rows,
    forecast_rule_rows,
    rules_table,
    scenario_definitions,
    scenario_rule_rows,
)
from demandspark.operators import (
    demand,
    dims,
    facts,
    forecast,
    forecast_fit,
    replenish,
    risk,
    scenario,
    weekly,
)
from demandspark.plans.retail import RetailTables
from demandspark.session import stage

DAYS_PER_SLICE = 364

# Declared precision of the stored columns.
TYPES = {
    "sell_price": "decimal(10,2)",
    "mean_daily_units": "decimal(12,4)",
    "std_daily_units": "decimal(12,4)",
    "cv": "decimal(12,4)",
    "trend_slope": "decimal(16,8)",
    "forecast_value": "decimal(14,4)",
    "lower_bound": "decimal(14,4)",
    "upper_bound": "decimal(14,4)",
    "risk_score": "decimal(8,6)",
}


def write_layers(tables: RetailTables, out: str, run_id: int = 1) -> dict[str, str]:
    """Build all tables under `out`; returns the path of each layer.

    Daily sales are sliced by a coarse day bucket, so that reads of the last
    weeks skip the rest. Facts of series are clustered by them, so that a read
    of one series skips the others. Later layers read the written ones, so the source is
    scanned once and a failed layer can be re-run alone.
    """
    spark, clock = tables.spark, tables.clock
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame, provenance: str, slice_by: list[str] | None = None) -> DataFrame:
        paths[name] = f"{out}/{name}"
        by_series = name.startswith("fact_") and set(SERIES) <= set(df.columns)
        facts.write_fact(
            df, paths[name], {c: t for c, t in TYPES.items() if c in df.columns}, provenance,
            run_id, slice_by, SERIES if by_series else None,
        )
        return spark.read.parquet(paths[name]).drop("data_provenance", "etl_run_id")

    def numbers(df: DataFrame) -> DataFrame:
        """Stored decimals back as doubles, for computing."""
        return df.withColumns({c: F.col(c).cast("double") for c in TYPES if c in df.columns})

    save("dim_date", tables.dates, OBSERVED)
    save("dim_week", dims.dim_week(tables.dates), DERIVED)
    for name in ("product", "store", "department", "category"):
        save(f"dim_{name}", getattr(tables, name), OBSERVED)
    rules = demand_rule_rows() + forecast_rule_rows(clock) + scenario_rule_rows(clock)
    save("business_rules", rules_table(spark, rules), DERIVED)
    save("assumption_set", assumption_set_row(spark), SIMULATED)
    save("scenario_definition", scenario_definitions(spark), SIMULATED)
    slice_of = F.floor((F.col("date_id") - 1) / DAYS_PER_SLICE).cast("int").alias("day_slice")
    daily = save(
        "fact_daily_sales", tables.daily.select("*", slice_of), OBSERVED, ["day_slice"]
    ).drop("day_slice")
    price = save("fact_weekly_price", tables.price, OBSERVED)
    anchor = save(
        "weekly_sales",
        weekly.weekly_sales(daily, tables.dates, price, tables.weeks),
        DERIVED,
    )
    stats = demand.demand_stats(daily, clock.observed_start, clock.observed_end)
    save("fact_dow_factor", demand.dow_factors(tables.dow_fine), DERIVED)
    seasonal = demand.monthly_seasonality(demand.monthly_means(anchor, tables.dates))
    save("fact_demand_seasonality", demand.seasonality_fact(seasonal), DERIVED)
    analysis = numbers(
        save(
            "fact_demand_analysis",
            demand.demand_analysis(stats, demand.weekly_growth(anchor), seasonal),
            DERIVED,
        )
    )
    windows = forecast.trailing_window_arrays(
        daily, forecast.forecast_windows(clock), analysis
    )
    if tables.fits:
        fits = stage(forecast_fit.fit_both(daily, clock))
        scored = forecast.evaluate(windows, forecast_fit.of_span(fits, "holdout"))
        chosen = forecast.chosen_forecast(
            windows, scored, forecast.select_for_series(scored), clock,
            forecast_fit.of_span(fits, "final"),
        )
    else:
        scored, chosen = forecast.evaluate(windows), forecast.chosen_baseline(windows, clock)
    save("fact_forecast_evaluation", forecast.evaluation_fact(scored, clock), DERIVED)
    final = numbers(save("fact_forecast", forecast.final_forecast(chosen, clock), DERIVED))
    vectors = forecast.final_vectors(final)
    policy = replenish.inventory_policy(analysis)
    save(
        "fact_inventory_projection",
        replenish.inventory_projection(
            replenish.with_trace(policy.join(vectors, SERIES)), clock
        ),
        SIMULATED,
        ["assumption_set_id"],
    )
    results = save(
        "fact_scenario_result",
        scenario.scenario_result(analysis, vectors),
        SIMULATED,
        ["scenario_name"],
    ).withColumn("data_provenance", F.lit(SIMULATED))
    save("scenario_run", scenario.scenario_runs(results), SIMULATED)
    save("scenario_comparison", scenario.scenario_deltas(results), SIMULATED, ["scenario_name"])
    save("fact_risk", risk.risk_fact(results), SIMULATED, ["risk_type"])
    return paths
