"""Filtered and paged reads of the demand tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demandspark.config import SERIES
from demandspark.functions.ordering import page
from demandspark.operators.contribution import filter_by_dimensions

_COLUMN_FILTERS = {
    "risk_category": "risk_category",
    "volatility_class": "segment_volatility",
    "volume_class": "segment_volume",
    "trend_direction": "trend_direction",
    "window": "analysis_window",
}


def filter_series(
    analysis: DataFrame, product: DataFrame, store: DataFrame, filters: dict | None
) -> DataFrame:
    filters = filters or {}
    for name, column in _COLUMN_FILTERS.items():
        if filters.get(name) is not None:
            analysis = analysis.filter(F.col(column) == filters[name])
    return filter_by_dimensions(analysis, product, store, filters)


def _order(sort: str | None) -> list[Column]:
    """A sort token as an ordering; ids at the end make pages repeatable."""
    by_id = [F.asc("product_id"), F.asc("store_id")]
    orders = {
        "mean_daily_units": [F.asc("mean_daily_units")],
        "cv": [F.asc_nulls_last("cv")],
        "cv_desc": [F.desc_nulls_first("cv")],
        "risk": [F.desc("risk_category"), F.desc("segment_volatility")],
    }
    return orders.get(sort or "", []) + by_id


def demand_rows(
    analysis: DataFrame,
    product: DataFrame,
    store: DataFrame,
    filters: dict | None = None,
    sort: str | None = None,
    number: int = 1,
    size: int = 25,
) -> DataFrame:
    """One page of series with the number of all matching ones."""
    kept = filter_series(analysis, product, store, filters)
    total = kept.agg(F.count(F.lit(1))).scalar()
    labelled = kept.join(product.select("product_surr_id", "product_id"), "product_surr_id").join(
        store.select("store_surr_id", "store_id"), "store_surr_id"
    )
    return page(labelled, _order(sort), number, size).select(
        "product_id",
        "store_id",
        "mean_daily_units",
        "cv",
        "segment_volatility",
        "demand_growth_rate",
        "growth_is_defined",
        "trend_direction",
        "trend_effect_pct",
        "seasonality_strength",
        "peak_month",
        "trough_month",
        "segment_volume",
        "segment_demand",
        "risk_cell",
        "risk_category",
        "data_provenance",
        total.alias("total_rows"),
    )


def demand_segments(
    analysis: DataFrame, product: DataFrame, store: DataFrame, filters: dict | None = None
) -> DataFrame:
    """Counts per volume and volatility class and per risk category."""
    kept = filter_series(analysis, product, store, filters)
    matrix = kept.groupBy("segment_volume", "segment_volatility").agg(
        F.count(F.lit(1)).alias("n")
    )
    breaks = kept.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    return matrix.select(
        "segment_volume", "segment_volatility", none.alias("risk_category"), "n"
    ).unionByName(
        breaks.select(
            none.alias("segment_volume"), none.alias("segment_volatility"), "risk_category", "n"
        )
    )


def series_of(token: str, product: DataFrame, store: DataFrame) -> tuple[Column, Column]:
    """Key columns of a `product:store` token, given by ids or by numbers."""
    left, _, right = token.partition(":")
    left, right = left.strip(), right.strip()
    if left.isdigit() and right.isdigit():
        return F.lit(int(left)), F.lit(int(right))
    p = product.filter(F.col("product_id") == left).agg(F.max("product_surr_id")).scalar()
    s = store.filter(F.col("store_id") == right).agg(F.max("store_surr_id")).scalar()
    return p, s


def one_series(df: DataFrame, token: str, product: DataFrame, store: DataFrame) -> DataFrame:
    p, s = series_of(token, product, store)
    return df.filter((F.col("product_surr_id") == p) & (F.col("store_surr_id") == s))


def seasonality_lookup(
    analysis: DataFrame, seasonality: DataFrame, product: DataFrame, store: DataFrame, token: str
) -> DataFrame:
    head = one_series(analysis, token, product, store).select(
        *SERIES,
        "seasonality_strength",
        "has_meaningful_seasonality",
        "peak_month",
        "trough_month",
    )
    months = one_series(seasonality, token, product, store).select(
        *SERIES, "month", "seasonality_index", "obs_weeks"
    )
    return head.join(months, SERIES, "left").orderBy("month")


def dow_lookup(factors: DataFrame, scope_type: str) -> DataFrame:
    return factors.filter(F.col("scope_type") == scope_type).orderBy(
        F.asc_nulls_first("scope_key"), "weekday_num"
    )
