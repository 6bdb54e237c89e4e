"""Binds order-line tables (lineitem, part, supplier, nation, region) to the
retail shapes: staged sales, weekly prices, calendar and dimension attributes.

A product is a part brand, a store is the nation of a supplier, a day is the
ship date counted from the Monday of the first one.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demandspark.config import OBSERVED, Clock
from demandspark.session import stage

WEEK_BASE = 10000


def product_key(brand: Column) -> Column:
    return F.substring(brand, 7, 10).cast("int")


def _dept_no(product: Column) -> Column:
    return product % 7


def day_index(ts: Column, origin: date) -> Column:
    return F.date_diff(ts.cast("date"), F.lit(origin)) + 1


def _whole_units(quantity: Column) -> Column:
    """Units are whole: a fraction is an error, not cut off."""
    return F.when(quantity != F.floor(quantity), F.raise_error(F.lit("fractional units"))).otherwise(
        quantity.cast("long")
    )


def week_of(day: Column) -> Column:
    return (F.floor((day - 1) / 7) + 1).cast("int")


@dataclass
class OrderTables:
    """Lazy retail views over one folder of order tables."""

    spark: SparkSession
    path: str
    given: Clock | None = None
    staged: bool = True

    @cached_property
    def clock(self) -> Clock:
        """The clock given, or else the span of the ship dates: one pass over one column.

        Without order lines the history is one empty day.
        """
        if self.given:
            return self.given
        day = F.col("l_shipdate").cast("date")
        first, last = self.table("lineitem").agg(F.min(day), F.max(day)).first()
        if first is None:
            return Clock(1)
        origin = first - timedelta(days=first.weekday())
        return Clock((last - origin).days + 1, origin)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- dimension attributes -------------------------------------------------
    def products(self) -> DataFrame:
        """Natural product rows (item, department, category)."""
        brand = self.table("part").select(F.col("p_brand").alias("item_id")).distinct()
        dept = _dept_no(product_key(F.col("item_id")))
        return brand.select(
            "item_id",
            F.concat(F.lit("D"), dept.cast("string")).alias("dept_id"),
            F.concat(F.lit("C"), (dept % 3).cast("string")).alias("cat_id"),
        )

    def stores(self) -> DataFrame:
        """Natural store rows (store, state) with the number of the store."""
        nation = self.table("nation")
        region = self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            (F.col("n_nationkey") + 1).alias("store_surr_id"),
            F.col("n_name").alias("store_id"),
            F.col("r_name").alias("state_id"),
        )

    # -- calendar ---------------------------------------------------------------
    def calendar(self) -> DataFrame:
        """Calendar rows for the observed days and the forecast horizon."""
        days = self.spark.range(
            self.clock.observed_start, self.clock.forecast_end + 1, numPartitions=1
        ).select(F.col("id").cast("int").alias("n"))
        date = F.date_add(F.lit(self.clock.origin), F.col("n") - 1)
        monthday = F.date_format("date", "MM-dd")
        return (
            days.withColumn("date", date)
            .withColumn("_md", monthday)
            .select(
                "date",
                (week_of(F.col("n")) + WEEK_BASE).alias("wm_yr_wk"),
                F.date_format("date", "EEEE").alias("weekday"),
                ((F.col("n") - 1) % 7 + 1).cast("int").alias("wday"),
                F.month("date").alias("month"),
                F.year("date").alias("year"),
                F.concat(F.lit("d_"), F.col("n").cast("string")).alias("d"),
                F.when(F.col("_md") == "12-25", "Christmas")
                .when(F.col("_md") == "01-01", "NewYear")
                .when(F.col("_md") == "07-04", "IndependenceDay")
                .alias("event_name_1"),
                F.when(F.col("_md").isin("12-25", "01-01", "07-04"), "National").alias(
                    "event_type_1"
                ),
                F.when(F.col("_md") == "12-25", "WinterFeast").alias("event_name_2"),
                F.when(F.col("_md") == "12-25", "Cultural").alias("event_type_2"),
                (F.dayofmonth("date") <= 10).cast("int").alias("snap_CA"),
                (F.dayofmonth("date") % 2).cast("int").alias("snap_TX"),
                (F.dayofmonth("date") % 3 == 0).cast("int").alias("snap_WI"),
            )
        )

    # -- sales ------------------------------------------------------------------
    def _lines(self) -> DataFrame:
        """Order lines with product and store number.

        Part and supplier grow with the data, so no broadcast is asked for:
        the optimizer picks it from their measured size and splits skewed keys
        of the shuffle join otherwise.
        """
        line = self.table("lineitem").select(
            "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"
        )
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"),
            product_key(F.col("p_brand")).alias("product_surr_id"),
        )
        supplier = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"),
            (F.col("s_nationkey") + 1).alias("store_surr_id"),
        )
        return line.join(part, "l_partkey").join(supplier, "l_suppkey")

    @cached_property
    def daily_totals(self) -> DataFrame:
        """Units and money in cents per product, store and day with sales.

        The order lines are scanned and joined once; all later tables read
        the staged result, which has at most one row per series and day. A
        caller that reads it once can do without (`staged=False`).
        """
        totals = (
            self._lines()
            .groupBy(
                "product_surr_id",
                "store_surr_id",
                day_index(F.col("l_shipdate"), self.clock.origin).alias("date_id"),
            )
            .agg(
                F.sum(_whole_units(F.col("l_quantity"))).alias("units_sold"),
                F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
            )
        )
        return stage(totals) if self.staged else totals

    def daily_sales(self) -> DataFrame:
        """Days with sales only; a missing day means no sale."""
        return self.daily_totals.select(
            "product_surr_id",
            "store_surr_id",
            "date_id",
            F.col("units_sold").cast("int").alias("units_sold"),
            F.lit(OBSERVED).alias("demand_source"),
        )

    def weekly_price(self) -> DataFrame:
        """Average price, half-up to the cent, of each product, store and week sold."""
        cents = F.expr("(2 * cents + units) div (2 * units)")
        return (
            self.daily_totals.groupBy("product_surr_id", "store_surr_id", week_of(F.col("date_id")).alias("week_id"))
            .agg(F.sum("units_sold").alias("units"), F.sum("cents").alias("cents"))
            .filter("units > 0")
            .select(
                "product_surr_id",
                "store_surr_id",
                (F.col("week_id") + WEEK_BASE).alias("wm_yr_wk"),
                "week_id",
                (cents.cast("decimal(12,0)") / 100).cast("decimal(10,2)").alias("sell_price"),
            )
        )

    # -- staged files -------------------------------------------------------------
    def staged_sales(self) -> DataFrame:
        """Natural-key sales as the raw long file has them (days with sales)."""
        return self._lines_natural().select(
            F.concat_ws("_", "item_id", "store_id").alias("id"),
            "item_id",
            "store_id",
            "day_index",
            "units",
        )

    def _lines_natural(self) -> DataFrame:
        daily = self.daily_totals
        stores = self.stores().select("store_surr_id", "store_id")
        return daily.join(stores, "store_surr_id").select(
            F.concat(F.lit("Brand#"), F.col("product_surr_id").cast("string")).alias("item_id"),
            "store_id",
            F.col("date_id").alias("day_index"),
            F.col("units_sold").cast("int").alias("units"),
        )

    def staged_prices(self) -> DataFrame:
        stores = self.stores().select("store_surr_id", "store_id")
        return self.weekly_price().join(stores, "store_surr_id").select(
            "store_id",
            F.concat(F.lit("Brand#"), F.col("product_surr_id").cast("string")).alias("item_id"),
            "wm_yr_wk",
            "sell_price",
        )

    def sales_meta(self) -> DataFrame:
        """One row per series of the staged sales with its hierarchy ids."""
        pairs = self.staged_sales().select("id", "item_id", "store_id").distinct()
        return (
            pairs.join(self.products(), "item_id")
            .join(self.stores().select("store_id", "state_id"), "store_id")
            .select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
        )
