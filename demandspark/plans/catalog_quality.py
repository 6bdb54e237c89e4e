"""Checks, profiles and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.config import SERIES
from demandspark.operators import contribution, forecast, quality, weekly
from demandspark.plans.catalog import query
from demandspark.plans.retail import RetailTables
from demandspark.session import new_stage_path
from demandspark.sources import raw_files


def _raw(t: RetailTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.source.calendar(), t.source.staged_sales(), t.source.staged_prices()


@query("B01_check_schema")
def b01(t: RetailTables) -> DataFrame:
    calendar, _, prices = _raw(t)
    return quality.union_all(
        [
            quality.check_schema(calendar, quality.CALENDAR_COLUMNS, "calendar"),
            quality.check_schema(t.source.sales_meta(), quality.SALES_COLUMNS, "sales"),
            quality.check_schema(prices, quality.PRICE_COLUMNS, "sell_prices"),
        ]
    )


@query("B02_check_numeric_types", one_pass=True)
def b02(t: RetailTables) -> DataFrame:
    return quality.check_numeric_types(t.source.staged_sales(), ["day_index", "units"], "sales")


def _sales_files(t: RetailTables) -> dict[str, DataFrame]:
    """The last eight weeks as wide files, read as text: a sound one, one without a day, one with a word as a day's units."""
    last = t.clock.observed_end
    first = last - 2 * t.clock.horizon + 1
    wide = (
        forecast.trailing_window_arrays(t.daily, {"days": (first, last)})
        .join(t.product, "product_surr_id")
        .join(t.store, "store_surr_id")
        .select(
            F.concat_ws("_", "product_id", "store_id").alias("id"),
            F.col("product_id").alias("item_id"), "dept_id", F.col("category_id").alias("cat_id"), "store_id", "state_id",
            *[F.col("days")[i].cast("int").cast("string").alias(f"d_{first + i}") for i in range(last - first + 1)],
        )
    )
    word = F.when(F.col("store_id") == F.col("item_id"), F.col(f"d_{last}")).otherwise("none")
    kinds = {"sound": wide, "gap": wide.drop(f"d_{t.clock.train_end}"), "word": wide.withColumn(f"d_{last}", word)}
    out = {}
    for name, df in kinds.items():
        path = new_stage_path(t.spark, f"sales-{name}")
        df.write.option("header", True).csv(path)
        out[name] = raw_files.read_as_text(t.spark, path)
    return out


@query("B01_check_schema_files")
def b01_files(t: RetailTables) -> DataFrame:
    return quality.union_all([
        quality.check_file_columns(raw, quality.SALES_COLUMNS, f"sales_{name}", days=True) for name, raw in _sales_files(t).items()
    ])


@query("B02_check_numeric_files")
def b02_files(t: RetailTables) -> DataFrame:
    return quality.union_all([
        quality.check_file_numbers(raw, raw_files.day_columns(raw.columns), f"sales_{name}") for name, raw in _sales_files(t).items()
    ])


@query("B03_check_duplicates")
def b03(t: RetailTables) -> DataFrame:
    """Two keys that hold, and one of the order lines that does not."""
    calendar, sales, prices = _raw(t)
    lines = t.source.table("lineitem")
    return quality.union_all(
        [
            quality.check_duplicates(calendar, ["d"], "calendar_d"),
            quality.check_duplicates(sales, ["id", "day_index"], "sales_id_day"),
            quality.check_duplicates(prices, ["item_id", "store_id", "wm_yr_wk"], "sell_prices_key"),
            quality.check_duplicates(lines, ["l_partkey", "l_suppkey"], "line_part_supplier"),
        ]
    )


@query("B04_check_nulls")
def b04(t: RetailTables) -> DataFrame:
    calendar, sales, prices = _raw(t)
    return quality.union_all(
        [
            quality.check_nulls(calendar, ["d", "date"], "calendar"),
            quality.check_nulls(calendar, ["event_name_1", "event_name_2"], "calendar_events"),
            quality.check_nulls(prices, list(quality.PRICE_COLUMNS), "sell_prices"),
            quality.check_nulls(sales, ["id", "item_id", "store_id"], "sales"),
        ]
    )


@query("B05_check_date_continuity")
def b05(t: RetailTables) -> DataFrame:
    return quality.check_date_continuity(t.source.calendar())


@query("B06_check_negative")
def b06(t: RetailTables) -> DataFrame:
    balances = t.source.table("supplier").select(F.col("s_acctbal").alias("balance"))
    return quality.check_negative(t.source.staged_sales(), "units", "units").unionByName(
        quality.check_negative(balances, "balance", "supplier_balance")
    )


@query("B07_check_price_range", one_pass=True)
def b07(t: RetailTables) -> DataFrame:
    return quality.check_price_range(t.source.staged_prices())


@query("B08_check_referential")
def b08(t: RetailTables) -> DataFrame:
    return quality.check_referential(t.source.staged_prices(), t.source.staged_sales())


@query("B09_check_hierarchy")
def b09(t: RetailTables) -> DataFrame:
    return quality.check_hierarchy(t.source.sales_meta(), 25, 25)


@query("B10_check_orphans")
def b10(t: RetailTables) -> DataFrame:
    """Against all dimensions, and against those of one region only."""
    west = t.store.filter("region_id = 'West'")
    return quality.check_orphans(t.daily, t.product, t.store, t.dates).unionByName(
        quality.check_orphans(t.daily, t.product, west, t.dates)
    )


@query("B11_check_fact_keys_unique")
def b11(t: RetailTables) -> DataFrame:
    return quality.check_fact_keys_unique(t.daily, t.price)


@query("B12_reconcile_totals")
def b12(t: RetailTables) -> DataFrame:
    return quality.reconcile_totals(
        t.source.staged_sales(),
        t.daily,
        t.price,
        {
            "category": t.category,
            "department": t.department,
            "product": t.product,
            "store": t.store,
            "date": t.dates,
        },
    )


@query("B13_check_value_domains")
def b13(t: RetailTables) -> DataFrame:
    return quality.check_value_domains(
        t.daily, t.price, t.store, t.category, t.dates, t.ranked, ("AFRICA", "AMERICA", "ASIA", "EUROPE")
    )


@query("B14_profile_sales", one_pass=True)
def b14(t: RetailTables) -> DataFrame:
    return quality.profile_sales(t.source.staged_sales(), t.clock.observed_end)


@query("B15_profile_calendar")
def b15(t: RetailTables) -> DataFrame:
    return quality.profile_calendar(t.source.calendar())


@query("B16_profile_prices", one_pass=True)
def b16(t: RetailTables) -> DataFrame:
    return quality.profile_prices(t.source.staged_prices())


def _all_checks(t: RetailTables) -> DataFrame:
    return quality.union_all(
        [b01(t), b02(t), b03(t), b04(t), b05(t), b06(t), b07(t), b08(t), b09(t), b10(t), b11(t)]
    )


@query("B17_quality_summary")
def b17(t: RetailTables) -> DataFrame:
    return quality.quality_summary(_all_checks(t))


@query("B18_zero_fraction_per_series", one_pass=True)
def b18(t: RetailTables) -> DataFrame:
    return quality.zero_fraction_per_series(t.daily, t.clock.observed_end)


@query("B18_daily_totals", one_pass=True)
def b18_daily(t: RetailTables) -> DataFrame:
    return quality.daily_totals(t.daily)


@query("B18_histograms")
def b18_histograms(t: RetailTables) -> DataFrame:
    """Positive demand, zero share of series and prices in equal-width bins."""
    zero = quality.zero_fraction_per_series(t.daily, t.clock.observed_end)
    parts = [
        ("demand", quality.histogram(t.daily.filter("units_sold > 0"), "units_sold", 60)),
        ("zero_fraction", quality.histogram(zero, "zero_fraction", 40)),
        ("price", quality.histogram(t.price, "sell_price", 60)),
    ]
    return quality.union_all([h.select(F.lit(n).alias("view"), "bin", "n") for n, h in parts])


@query("B19_reconcile_layers")
def b19(t: RetailTables) -> DataFrame:
    return quality.reconcile_layers(
        t.daily,
        t.weekly,
        weekly.rollup_monthly(t.sold_weeks, t.dates),
        t.stats,
        weekly.rollup_product_hierarchy(t.product, t.sold_weeks),
        contribution.level_contribution(t.sold_wide, contribution.LEVELS["store"]),
    )
