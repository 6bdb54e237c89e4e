"""Daily and weekly facts: key lookup, gap filling, typed and sliced writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.config import OBSERVED, SERIES


def load_daily_sales(staged: DataFrame, product: DataFrame, store: DataFrame) -> DataFrame:
    """Natural to surrogate keys for staged daily sales."""
    return (
        staged.join(
            product.select(F.col("product_id").alias("item_id"), "product_surr_id"), "item_id"
        )
        .join(store.select("store_id", "store_surr_id"), "store_id")
        .select(
            "product_surr_id",
            "store_surr_id",
            F.col("day_index").alias("date_id"),
            F.col("units").alias("units_sold"),
            F.lit(OBSERVED).alias("demand_source"),
        )
    )


def load_weekly_price(
    staged: DataFrame, product: DataFrame, store: DataFrame, dates: DataFrame
) -> DataFrame:
    weeks = dates.select("wm_yr_wk", "week_id").distinct()
    return (
        staged.join(
            product.select(F.col("product_id").alias("item_id"), "product_surr_id"), "item_id"
        )
        .join(store.select("store_id", "store_surr_id"), "store_id")
        .join(weeks, "wm_yr_wk")
        .select(
            "product_surr_id",
            "store_surr_id",
            "wm_yr_wk",
            "week_id",
            "sell_price",
            F.lit(OBSERVED).alias("data_provenance"),
        )
    )


def densify_series(
    df: DataFrame,
    axis: str,
    lo: int,
    hi: int,
    fill: dict[str, Column],
    keys: list[str] = SERIES,
) -> DataFrame:
    """Give every series a row for each step of [lo, hi]; `fill` values new rows.

    Each present row fills the gap up to the next present one, so the input
    is read once and nothing is joined to a grid. `axis` must be unique in a
    series, which bounds the window of one series by the calendar.
    """
    w = W.partitionBy(*keys).orderBy(axis)
    start = F.when(F.lag(axis).over(w).isNull(), F.lit(lo)).otherwise(F.col(axis))
    end = F.coalesce(F.lead(axis).over(w) - 1, F.lit(hi))
    spread = (
        df.filter(F.col(axis).between(lo, hi))
        .withColumn("_start", start)
        .withColumn("_end", end)
        .withColumn("_step", F.explode(F.sequence("_start", "_end")))
    )
    present = F.col("_step") == F.col(axis)
    return spread.select(
        *[
            F.col("_step").cast("int").alias(axis)
            if c == axis
            else F.when(present, F.col(c)).otherwise(fill[c]).alias(c)
            if c in fill
            else F.col(c)
            for c in df.columns
        ]
    )


def densify_daily(daily: DataFrame, lo: int, hi: int) -> DataFrame:
    return densify_series(daily, "date_id", lo, hi, {"units_sold": F.lit(0)})


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus the incoming rows whose key is new.

    Of incoming rows that share a key the first in the order of all columns stays.
    """
    new = one_per_key(incoming, key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new)


def one_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the first in the order of the other columns."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key.

    Of incoming rows that share a key the first in the order of all columns counts.
    """
    new = one_per_key(incoming, key)
    return existing.join(new.select(*key), key, "left_anti").unionByName(new)


#: Bytes of a row group of a layer that is read by series: what a point read decodes at most in each file.
GROUP_BYTES = 8 << 20


def write_fact(
    df: DataFrame,
    path: str,
    types: dict[str, str],
    provenance: str,
    run_id: int,
    slice_by: list[str] | None = None,
    cluster_by: list[str] | None = None,
    group_bytes: int = GROUP_BYTES,
) -> None:
    """Cast to the declared precision, stamp provenance and run, and write.

    `cluster_by` deals the rows out by ranges of these keys and sorts them, in
    small row groups, so that the statistics of the files let a read of one key
    skip all groups but those that hold it.
    """
    typed = df.select(
        *[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    ).withColumns({"data_provenance": F.lit(provenance), "etl_run_id": F.lit(run_id)})
    if cluster_by:
        order = [*(slice_by or []), *cluster_by]
        typed = typed.repartitionByRange(*order).sortWithinPartitions(*order)
    elif slice_by:  # each slice is written by the tasks that hold it, not by all
        typed = typed.repartition(*slice_by, *[c for c in SERIES if c in typed.columns])
    writer = typed.write.mode("overwrite")
    if cluster_by:
        writer = writer.option("parquet.block.size", group_bytes)
    if slice_by:
        writer = writer.partitionBy(*slice_by)
    writer.parquet(path)


def read_series(layer: DataFrame, product_surr_id: int, store_surr_id: int) -> DataFrame:
    """Rows of one series of a written layer; the ids reach the scan as literals, which row groups are skipped by."""
    return layer.filter((F.col("product_surr_id") == product_surr_id) & (F.col("store_surr_id") == store_surr_id))


def pair_filter(fact: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the fact whose series is in `pairs`."""
    return fact.join(pairs.select(*SERIES).distinct(), SERIES, "left_semi")
