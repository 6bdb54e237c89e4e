"""Star-schema dimensions from staged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Region of each state.
REGION_OF_STATE = {
    "CA": "West", "TX": "Central", "WI": "East",
    "AFRICA": "West", "AMERICA": "Central", "ASIA": "East", "EUROPE": "West",
}


def assign_surrogate_keys(dim: DataFrame, natural: str, key: str) -> DataFrame:
    """Numbers 1..n in the order of the natural key.

    Dimensions are small against facts, but they are still numbered in range
    buckets, so no task sees a whole dimension.
    """
    from demandspark.functions.ordering import running_totals

    return running_totals(dim, [F.col(natural)], {}, row_number=key).withColumn(
        key, F.col(key).cast("int")
    )


def region_of(state: Column) -> Column:
    expr = None
    for value, region in REGION_OF_STATE.items():
        expr = (F.when(state == value, region) if expr is None
                else expr.when(state == value, region))
    return expr.otherwise("Unknown")


def dim_category(meta: DataFrame) -> DataFrame:
    return meta.select(
        F.col("cat_id").alias("category_id"), F.col("cat_id").alias("category_name")
    ).distinct()


def dim_department(meta: DataFrame, category: DataFrame) -> DataFrame:
    dept = meta.select("dept_id", F.col("cat_id").alias("category_id")).distinct()
    keys = category.select("category_id", "category_surr_id")
    return dept.join(keys, "category_id").select(
        "dept_id", F.col("dept_id").alias("dept_name"), "category_id", "category_surr_id"
    )


def dim_store(meta: DataFrame) -> DataFrame:
    return meta.select("store_id", "state_id").distinct().select(
        "store_id",
        "state_id",
        region_of(F.col("state_id")).alias("region_id"),
        F.col("store_id").alias("store_name"),
    )


def dim_product(meta: DataFrame, department: DataFrame, category: DataFrame) -> DataFrame:
    items = meta.select("item_id", "dept_id", F.col("cat_id").alias("category_id")).distinct()
    return (
        items.join(department.select("dept_id", "dept_surr_id"), "dept_id")
        .join(category.select("category_id", "category_surr_id"), "category_id")
        .select(
            F.col("item_id").alias("product_id"),
            "item_id",
            "dept_id",
            "dept_surr_id",
            "category_id",
            "category_surr_id",
            F.col("item_id").alias("product_label"),
        )
    )


def dim_date(calendar: DataFrame, last_observed: int | Column) -> DataFrame:
    """Day rows with week ordinal, month, quarter, events and SNAP flags.

    The windows run over one row per week or day of a calendar, which time
    bounds and data does not.
    """
    week = (
        calendar.groupBy("wm_yr_wk")
        .agg(F.min("date").alias("_first"))
        .select(
            "wm_yr_wk",
            F.row_number().over(W.orderBy("_first")).alias("week_id"),
        )
    )
    last = last_observed if isinstance(last_observed, Column) else F.lit(last_observed)
    day = F.regexp_replace("d", "^d_", "").cast("int")
    return calendar.join(week, "wm_yr_wk").select(
        day.alias("date_id"),
        F.col("date").alias("calendar_date"),
        day.alias("day_index"),
        "wm_yr_wk",
        "week_id",
        F.col("wday").alias("weekday_num"),
        F.col("weekday").alias("weekday_name"),
        F.lower("weekday").isin("saturday", "sunday").alias("is_weekend"),
        "month",
        F.date_format("date", "MMMM").alias("month_name"),
        F.quarter("date").alias("quarter"),
        "year",
        F.col("event_name_1").isNotNull().alias("is_event_day"),
        "event_name_1",
        "event_type_1",
        "event_name_2",
        "event_type_2",
        (F.col("snap_CA") == 1).alias("snap_ca"),
        (F.col("snap_TX") == 1).alias("snap_tx"),
        (F.col("snap_WI") == 1).alias("snap_wi"),
        (day <= last).alias("is_observed"),
    )


def dim_event(calendar: DataFrame) -> DataFrame:
    """One row per event of a day, first and second events unpivoted."""
    pairs = F.array(
        *[
            F.struct(
                F.col(f"event_name_{i}").alias("event_name"),
                F.col(f"event_type_{i}").alias("event_type"),
                F.lit(i).alias("event_ordinal"),
            )
            for i in (1, 2)
        ]
    )
    return (
        calendar.select(
            F.col("date").alias("event_date"),
            F.regexp_replace("d", "^d_", "").cast("int").alias("date_id"),
            F.inline(pairs),
        )
        .filter(F.col("event_name").isNotNull())
        .dropDuplicates(["event_date", "event_name", "event_ordinal"])
    )


def dim_week(dates: DataFrame) -> DataFrame:
    """Week rows; a week carries the attributes of its first day."""
    return dates.groupBy("wm_yr_wk").agg(
        F.min("week_id").alias("week_id"),
        *[F.min_by(c, "date_id").alias(c) for c in ("year", "quarter", "month", "month_name")],
    )


def week_months(dates: DataFrame) -> DataFrame:
    """Every (week, month) pair: a week over a month end counts in both."""
    return dates.select("wm_yr_wk", "month").distinct()


def dimension_values(department: DataFrame, category: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct filter values of the small dimensions."""
    def values(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("dimension"), F.col(column).alias("value")).distinct()

    return (
        values(department, "departments", "dept_name")
        .unionByName(values(category, "categories", "category_name"))
        .unionByName(values(store, "stores", "store_id"))
        .unionByName(values(store, "states", "state_id"))
        .unionByName(values(store, "regions", "region_id"))
        .orderBy("dimension", "value")
    )
