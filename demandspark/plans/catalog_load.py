"""Sources, dimensions, facts and writes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from demandspark.config import DERIVED, SERIES
from demandspark.operators import dims, facts
from demandspark.operators.sliced import SlicedTable
from demandspark.plans.catalog import query
from demandspark.plans.retail import RetailTables
from demandspark.session import new_stage_path
from demandspark.sources import raw_files


def _calendar_file(t: RetailTables) -> str:
    path = new_stage_path(t.spark, "calendar")
    t.source.calendar().write.option("header", True).csv(path)
    return path


def _wide_file(t: RetailTables) -> str:
    """Wide sales as text lines, one column per day, written by Spark tasks."""
    path = new_stage_path(t.spark, "sales")
    arrays = t.daily_dense.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("date_id", "units_sold"))).alias("_days")
    )
    line = F.array_join(
        F.transform("_days", lambda d: d["units_sold"].cast("string")), ","
    )
    (
        arrays.join(t.product, "product_surr_id")
        .join(t.store, "store_surr_id")
        .select(
            F.concat_ws(
                ",",
                F.concat_ws("_", "product_id", "store_id"),
                "product_id",
                "dept_id",
                "category_id",
                "store_id",
                "state_id",
                line,
            ).alias("value")
        )
        .write.text(path)
    )
    return path


@query("A01_read_calendar")
def a01(t: RetailTables) -> DataFrame:
    return raw_files.read_calendar(t.spark, _calendar_file(t))


@query("A02_read_sell_prices", one_pass=True)
def a02(t: RetailTables) -> DataFrame:
    path = new_stage_path(t.spark, "prices")
    t.source.staged_prices().write.option("header", True).csv(path)
    return raw_files.read_sell_prices(t.spark, path)


@query("A03_read_sales_meta")
def a03(t: RetailTables) -> DataFrame:
    return raw_files.read_sales_meta(
        t.spark, _wide_file(t), t.clock.observed_end, header=False
    )


@query("A04_read_sales_wide")
def a04(t: RetailTables) -> DataFrame:
    """The wide rows, with their day columns summed up per series."""
    wide = raw_files.read_sales_wide(
        t.spark, _wide_file(t), t.clock.observed_end, header=False
    )
    days = F.expr(f"array({', '.join(c for c in wide.columns if c.startswith('d_'))})")
    return wide.select(
        *raw_files.SALES_IDS,
        F.size(days).alias("n_days"),
        F.aggregate(days, F.lit(0).cast("long"), lambda a, x: a + x).alias("units"),
        F.col("d_1").alias("first_day_units"),
        F.col(f"d_{t.clock.observed_end}").alias("last_day_units"),
    )


@query("A05_melt_sales_long")
def a05(t: RetailTables) -> DataFrame:
    wide = raw_files.read_sales_wide(
        t.spark, _wide_file(t), t.clock.observed_end, header=False
    )
    return raw_files.melt_sales_long(wide)


def _meta(t: RetailTables) -> DataFrame:
    return t.source.products().select("item_id", "dept_id", "cat_id")


@query("A06_dim_category")
def a06(t: RetailTables) -> DataFrame:
    return dims.dim_category(_meta(t))


@query("A07_dim_department")
def a07(t: RetailTables) -> DataFrame:
    return dims.dim_department(_meta(t), t.category)


@query("A08_dim_store")
def a08(t: RetailTables) -> DataFrame:
    return dims.dim_store(t.source.stores())


@query("A09_dim_product")
def a09(t: RetailTables) -> DataFrame:
    return dims.dim_product(_meta(t), t.department, t.category)


@query("A10_assign_surrogate_keys")
def a10(t: RetailTables) -> DataFrame:
    """Numbers for every part name and type in the order of the natural key."""
    natural = t.source.table("part").select(
        F.concat_ws("|", "p_name", "p_type", F.col("p_partkey").cast("string")).alias("natural_key")
    )
    return dims.assign_surrogate_keys(natural, "natural_key", "surrogate_key")


@query("A11_dim_date")
def a11(t: RetailTables) -> DataFrame:
    return t.dates


@query("A12_dim_event")
def a12(t: RetailTables) -> DataFrame:
    return dims.dim_event(t.source.calendar())


@query("A13_load_daily_sales", one_pass=True)
def a13(t: RetailTables) -> DataFrame:
    return facts.load_daily_sales(t.source.staged_sales(), t.product, t.store)


@query("A14_load_weekly_price", one_pass=True)
def a14(t: RetailTables) -> DataFrame:
    return facts.load_weekly_price(t.source.staged_prices(), t.product, t.store, t.dates)


def _loaded_and_new(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """First-half totals of the odd stores as loaded, totals of all other rows as incoming."""
    keys = [*SERIES]
    total = F.sum("units_sold").alias("units")
    half = t.clock.observed_end // 2
    loaded = (F.col("store_surr_id") % 2 == 1) & (F.col("date_id") <= half)
    existing, incoming = t.daily.filter(loaded), t.daily.filter(~loaded)
    return existing.groupBy(*keys).agg(total), incoming.groupBy(*keys).agg(total)


@query("A15_insert_if_absent")
def a15(t: RetailTables) -> DataFrame:
    return facts.insert_if_absent(*_loaded_and_new(t), SERIES)


@query("A16_upsert_by_key")
def a16(t: RetailTables) -> DataFrame:
    return facts.upsert_by_key(*_loaded_and_new(t), SERIES)


@query("A16_upsert_written_table")
def a16_written(t: RetailTables) -> DataFrame:
    """Lifetime units of every series in slices by store, then totals without the last year merged in for a third of the stores."""
    table = SlicedTable(t.spark, new_stage_path(t.spark, "totals"), ["store_surr_id"])
    table.replace(t.daily.groupBy(*SERIES).agg(F.sum("units_sold").alias("units")))
    before = t.daily.filter((F.col("store_surr_id") % 3 == 0) & (F.col("date_id") <= t.clock.observed_end - 365))
    table.upsert(before.groupBy(*SERIES).agg(F.sum("units_sold").alias("units")), SERIES)
    return table.read().select(*SERIES, "units")


@query("A17_replace_slice")
def a17(t: RetailTables) -> DataFrame:
    """Writes all years of daily sales, then replaces the middle year by doubled units read from the table itself."""
    table = SlicedTable(t.spark, new_stage_path(t.spark, "slices"), ["year"])
    years = t.dates.select("date_id", "year")
    table.replace(t.daily.join(F.broadcast(years), "date_id"))
    middle = (t.clock.origin + timedelta(days=t.clock.observed_end // 2 - 1)).year
    again = table.read().filter(F.col("year") == middle).withColumn("units_sold", F.col("units_sold") * 2)
    table.replace(again, [(middle,)])
    return table.read().select(*SERIES, "date_id", "year", "units_sold")


@query("A18_write_fact_parquet", one_pass=True)
def a18(t: RetailTables) -> DataFrame:
    path = new_stage_path(t.spark, "fact")
    means = t.daily.groupBy(*SERIES).agg(
        F.sum("units_sold").alias("total_units"),
        (F.sum("units_sold") / F.lit(t.clock.observed_end)).alias("mean_daily_units"),
    )
    facts.write_fact(
        means,
        path,
        {"total_units": "decimal(14,4)", "mean_daily_units": "decimal(12,4)"},
        DERIVED,
        run_id=1,
    )
    return t.spark.read.parquet(path)


@query("A21_densify_series", one_pass=True)
def a21(t: RetailTables) -> DataFrame:
    return t.daily_dense.select(*SERIES, "date_id", "units_sold")


@query("A22_dim_week")
def a22(t: RetailTables) -> DataFrame:
    return dims.dim_week(t.dates)


@query("A23_dimension_values")
def a23(t: RetailTables) -> DataFrame:
    return dims.dimension_values(t.department, t.category, t.store)
