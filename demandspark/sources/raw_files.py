"""Readers for the raw retail files: calendar, prices and wide daily sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SALES_IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]

# Column order of the calendar file.
CALENDAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("wday", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("d", T.StringType()),
        T.StructField("event_name_1", T.StringType()),
        T.StructField("event_type_1", T.StringType()),
        T.StructField("event_name_2", T.StringType()),
        T.StructField("event_type_2", T.StringType()),
        T.StructField("snap_CA", T.IntegerType()),
        T.StructField("snap_TX", T.IntegerType()),
        T.StructField("snap_WI", T.IntegerType()),
    ]
)

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("store_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("sell_price", T.DecimalType(10, 2)),
    ]
)


def sales_schema(n_days: int) -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in SALES_IDS]
        + [T.StructField(f"d_{i}", T.IntegerType()) for i in range(1, n_days + 1)]
    )


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """A wrong field fails the read; a header must name the columns of the schema in their order."""
    reader = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
    return reader.option("enforceSchema", not header).csv(path)


def read_calendar(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return _read_csv(spark, path, CALENDAR_SCHEMA, header)


def read_sell_prices(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return _read_csv(spark, path, PRICE_SCHEMA, header)


def read_sales_wide(
    spark: SparkSession, path: str, n_days: int, header: bool = True
) -> DataFrame:
    return _read_csv(spark, path, sales_schema(n_days), header)


def read_sales_meta(
    spark: SparkSession, path: str, n_days: int, header: bool = True
) -> DataFrame:
    """The six id columns only; the parser skips the day columns."""
    return read_sales_wide(spark, path, n_days, header).select(*SALES_IDS)


def melt_sales_long(wide: DataFrame) -> DataFrame:
    """One row per series and day from one column per day.

    The day columns are packed into one array and exploded by position, so
    the plan has one generator over one input row and no shuffle.
    """
    days = [c for c in wide.columns if c.startswith("d_")]
    first = int(days[0][2:])
    return wide.select(
        "id",
        "item_id",
        "store_id",
        F.posexplode(F.expr(f"array({', '.join(days)})")).alias("_pos", "units"),
    ).select(
        "id",
        "item_id",
        "store_id",
        (F.col("_pos") + first).cast("int").alias("day_index"),
        "units",
    )


def read_as_text(spark: SparkSession, path: str) -> DataFrame:
    """A file under the names of its own header, every column as text: nothing is forced on it before it is checked."""
    return spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


def day_columns(columns: list[str]) -> list[str]:
    """Columns `d_<number>`, in the order of the numbers."""
    found = [c for c in columns if c.startswith("d_") and c[2:].isdigit()]
    return sorted(found, key=lambda c: int(c[2:]))
