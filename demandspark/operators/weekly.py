"""The weekly revenue table and the KPI views read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.config import OBSERVED, SERIES
from demandspark.functions.exprs import pct_change, ratio
from demandspark.operators.dims import dim_week
from demandspark.operators.facts import densify_series


def weekly_units(
    daily: DataFrame, dates: DataFrame, dense_weeks: tuple[int, int] | None = None
) -> DataFrame:
    """Units per product, store and week; absent weeks become 0 if asked for.

    Filling happens after the weekly sum, on a seventh of the rows a daily
    grid would have.
    """
    weeks = daily.join(F.broadcast(dates.select("date_id", "wm_yr_wk", "week_id")), "date_id")
    totals = weeks.groupBy(*SERIES, "week_id", "wm_yr_wk").agg(
        F.sum("units_sold").cast("long").alias("units")
    )
    if dense_weeks is None:
        return totals
    filled = densify_series(
        totals.drop("wm_yr_wk"), "week_id", *dense_weeks, {"units": F.lit(0).cast("long")}
    )
    names = dates.select("week_id", "wm_yr_wk").distinct()
    return filled.join(F.broadcast(names), "week_id")


def weekly_sales(
    daily: DataFrame,
    dates: DataFrame,
    price: DataFrame,
    dense_weeks: tuple[int, int] | None = None,
) -> DataFrame:
    """Weekly anchor: units, price of the week and revenue.

    Days are summed to weeks before the price join, so the join sees one row
    per series and week. A week without a price keeps its units and has NULL
    price and revenue.
    """
    units = weekly_units(daily, dates, dense_weeks)
    prices = price.groupBy(*SERIES, "wm_yr_wk").agg(F.max("sell_price").alias("sell_price"))
    return units.join(prices, [*SERIES, "wm_yr_wk"], "left").select(
        *SERIES,
        "wm_yr_wk",
        "week_id",
        "units",
        "sell_price",
        (F.col("units").cast("decimal(18,0)") * F.col("sell_price"))
        .cast("decimal(28,2)")
        .alias("revenue"),
    )


def v_weekly(weekly: DataFrame, product: DataFrame, store: DataFrame, dates: DataFrame) -> DataFrame:
    """Anchor with dimension keys and the attributes of the week's first day."""
    attributes = dim_week(dates).select("wm_yr_wk", "year", "quarter", "month", "month_name")
    return (
        weekly.join(
            product.select("product_surr_id", "product_id", "category_surr_id", "dept_surr_id"),
            "product_surr_id",
        )
        .join(store.select("store_surr_id", "store_id", "state_id", "region_id"), "store_surr_id")
        .join(F.broadcast(attributes), "wm_yr_wk")
    )


def v_units(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("demand_source") == OBSERVED).select(
        "date_id", *SERIES, "units_sold"
    )


def v_revenue(weekly: DataFrame) -> DataFrame:
    unpriced = F.col("revenue").isNull()
    return weekly.groupBy("wm_yr_wk").agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.count_if(~unpriced).alias("priced_weeks"),
        F.count_if(unpriced).alias("unpriced_weeks"),
        F.count_if(unpriced & (F.col("units") > 0)).alias("unpriced_units_weeks"),
    )


def v_price_weekly(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("wm_yr_wk").agg(
        ratio(F.sum("sell_price"), F.count("sell_price")).alias("avg_sell_price"),
        ratio(F.sum("revenue"), F.sum("units")).alias("weighted_price"),
    )


def week_totals(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("wm_yr_wk").agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue")
    )


def _growth(totals: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Percent change against the row before; one row per period, so few rows."""
    w = W.orderBy(*order)
    return totals.withColumns(
        {
            f"{prefix}_units_pct": pct_change(F.col("units"), F.lag("units").over(w)),
            f"{prefix}_revenue_pct": pct_change(F.col("revenue"), F.lag("revenue").over(w)),
        }
    )


def v_growth_wow(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    """Week over week; calendar weeks without sales are kept."""
    weeks = dim_week(dates).select("wm_yr_wk", "week_id")
    totals = weeks.join(week_totals(weekly), "wm_yr_wk", "left")
    return _growth(totals, ["week_id"], "wow")


def period_totals(weekly: DataFrame, dates: DataFrame, period: list[str]) -> DataFrame:
    """Totals per period; a week belongs to the period of its first day."""
    weeks = dim_week(dates).select("wm_yr_wk", *period)
    return (
        week_totals(weekly)
        .join(F.broadcast(weeks), "wm_yr_wk")
        .groupBy(*period)
        .agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    )


def v_growth_qoq(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    return _growth(
        period_totals(weekly, dates, ["year", "quarter"]), ["year", "quarter"], "qoq"
    )


def v_growth_yoy(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    return _growth(period_totals(weekly, dates, ["year"]), ["year"], "yoy")


def rollup_daily(daily: DataFrame, dates: DataFrame) -> DataFrame:
    days = dates.select("date_id", "calendar_date", "wm_yr_wk")
    return v_units(daily).join(F.broadcast(days), "date_id").select(
        "date_id", "calendar_date", "wm_yr_wk", *SERIES, "units_sold"
    )


def rollup_weekly(weekly: DataFrame) -> DataFrame:
    return week_totals(weekly)


def rollup_monthly(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    return period_totals(weekly, dates, ["year", "month"])


def _rollup_kept(dim: DataFrame, weekly: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sums per dimension member; members without sales stay with NULL sums."""
    sums = weekly.groupBy(key).agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue")
    )
    return dim.select(*columns).join(sums, key, "left")


def rollup_product_hierarchy(product: DataFrame, weekly: DataFrame) -> DataFrame:
    return _rollup_kept(
        product,
        weekly,
        "product_surr_id",
        ["product_surr_id", "product_id", "dept_surr_id", "category_surr_id"],
    )


def rollup_store_hierarchy(store: DataFrame, weekly: DataFrame) -> DataFrame:
    return _rollup_kept(
        store, weekly, "store_surr_id", ["store_surr_id", "store_id", "state_id", "region_id"]
    )


# -- headline ------------------------------------------------------------------


def headline_kpis(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    """One row: totals, weighted price and the latest period changes.

    All inputs are week, quarter or year totals. Each change compares the
    period of the latest week with the one before it that has sales.
    """
    weeks = week_totals(weekly).join(
        F.broadcast(dim_week(dates).select("wm_yr_wk", "year", "quarter")), "wm_yr_wk"
    )
    totals = weeks.agg(
        F.round(F.sum("units")).cast("long").alias("total_units"),
        F.round(F.sum("revenue")).cast("double").alias("total_revenue"),
    )

    def latest_two(df: DataFrame, order: Column) -> DataFrame:
        two = df.orderBy(order).limit(2)
        w = W.orderBy(order)
        return two.withColumn("_rank", F.row_number().over(w))

    def change(df: DataFrame, order: Column, measure: str) -> Column:
        at = lambda r: F.max(F.when(F.col("_rank") == r, F.col(measure)))
        return latest_two(df, order).agg(pct_change(at(1), at(2))).scalar()

    quarters = weeks.groupBy("year", "quarter").agg(F.sum("revenue").alias("revenue"))
    years = weeks.groupBy("year").agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue")
    )
    by_week, by_year = F.desc("wm_yr_wk"), F.desc("year")
    by_quarter = (F.col("year") * 4 + F.col("quarter")).desc()
    return totals.select(
        "total_revenue",
        "total_units",
        F.round(ratio(F.col("total_revenue"), F.col("total_units")), 2).alias("weighted_price"),
        change(weeks, by_week, "revenue").alias("revenue_wow_pct"),
        change(weeks, by_week, "units").alias("units_wow_pct"),
        change(quarters, by_quarter, "revenue").alias("revenue_qoq_pct"),
        change(years, by_year, "revenue").alias("revenue_yoy_pct"),
        change(years, by_year, "units").alias("units_yoy_pct"),
    )


def revenue_trend(weekly: DataFrame, weeks: int = 12) -> DataFrame:
    return week_totals(weekly).orderBy(F.desc("wm_yr_wk")).limit(weeks).orderBy("wm_yr_wk")
