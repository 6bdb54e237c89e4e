"""The registered queries: one function from `RetailTables` to a DataFrame each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from demandspark.plans.retail import RetailTables

QUERIES: dict[str, Callable[[RetailTables], DataFrame]] = {}
ONE_PASS: set[str] = set()


def query(name: str, one_pass: bool = False):
    """Register a query; `one_pass` ones read the daily totals once, so these
    are not written first."""

    def register(fn: Callable[[RetailTables], DataFrame]):
        QUERIES[name] = fn
        if one_pass:
            ONE_PASS.add(name)
        return fn

    return register


# Whole-number columns that can be NULL; shown as doubles by both engines.
_OFFSET = ["first_stockout_offset"]
NULLABLE = {
    "C06_v_growth_wow": ["units"],
    "C13_all_level_contributions": ["dept_surr_id", "category_surr_id", "store_surr_id"],
    "C17_rollup_product_hierarchy": ["units"],
    "C18_rollup_store_hierarchy": ["units"],
    "D14_demand_analysis": ["n_active_months", "peak_month", "trough_month"],
    "D15_demand_rows": ["peak_month", "trough_month"],
    "D17_seasonality_lookup": ["month", "obs_weeks", "peak_month", "trough_month"],
    "F12_projection_summary": _OFFSET,
    "G03_s_baseline": _OFFSET,
    "G04_s_demand_shock": _OFFSET,
    "G05_s_lead_time": _OFFSET,
    "G06_s_service_level": _OFFSET,
    "G07_s_reorder_policy": _OFFSET,
    "G08_scenario_result": _OFFSET,
}


def plain(df: DataFrame, doubles: list[str]) -> DataFrame:
    """Decimals as doubles and dates as text, the types both engines print alike."""

    def cast(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType) or field.name in doubles:
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            return c.cast("string").alias(field.name)
        return c

    return df.select(*[cast(f) for f in df.schema.fields])


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from demandspark.plans import (  # noqa: F401  (registration)
        catalog_demand,
        catalog_load,
        catalog_measures,
        catalog_quality,
        catalog_stock,
        catalog_weekly,
    )

    def bind(name, fn):
        staged = name not in ONE_PASS
        return lambda spark, path: plain(
            fn(RetailTables(spark, path, staged=staged)), NULLABLE.get(name, [])
        )

    return {name: bind(name, fn) for name, fn in sorted(QUERIES.items())}
