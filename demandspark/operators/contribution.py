"""Revenue contribution: Pareto table, shares per level, filtered top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.functions.exprs import ratio, share_pct
from demandspark.functions.ordering import running_totals, top_n

LEVELS = {
    "department": ["dept_surr_id", "category_surr_id"],
    "category": ["category_surr_id"],
    "store": ["store_surr_id", "store_id", "state_id", "region_id"],
    "state": ["state_id"],
}


def _sums(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.groupBy(*keys).agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue")
    )


def product_contribution(wide: DataFrame) -> DataFrame:
    """Share, running share and rank of each product by revenue, ids breaking ties."""
    base = _sums(wide, ["product_surr_id", "product_id"])
    revenue = F.col("revenue").cast("decimal(38,2)")
    # Unpriced products come last, as they add nothing to the running sum.
    order = [F.col("revenue").isNull(), -revenue, F.col("product_surr_id")]
    ranked = running_totals(
        base, order, {"_running": revenue}, row_number="rank", grand={"_total": revenue}
    )
    return ranked.select(
        "product_surr_id",
        "product_id",
        "units",
        "revenue",
        share_pct(F.col("revenue"), F.col("_total")).alias("revenue_share_pct"),
        share_pct(F.col("_running"), F.col("_total")).alias("cumulative_share_pct"),
        F.col("rank").cast("int").alias("rank"),
    )


def level_contribution(wide: DataFrame, keys: list[str]) -> DataFrame:
    base = _sums(wide, keys)
    total = wide.agg(F.sum("revenue")).scalar()
    return base.withColumn("revenue_share_pct", share_pct(F.col("revenue"), total))


def all_level_contributions(wide: DataFrame) -> DataFrame:
    """The four level tables from one pass with grouping sets."""
    sets = [[F.col(c) for c in keys] for keys in LEVELS.values()]
    columns = ["dept_surr_id", "category_surr_id", "store_surr_id", "store_id", "state_id", "region_id"]
    levels = wide.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.grouping_id().alias("_gid"),
    )
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    label = None
    for name, keys in LEVELS.items():
        gid = sum(v for c, v in bit.items() if c not in keys)
        hit = F.col("_gid") == gid
        label = F.when(hit, name) if label is None else label.when(hit, name)
    total = wide.agg(F.sum("revenue")).scalar()
    return levels.select(
        label.alias("level"),
        *columns,
        "units",
        "revenue",
        share_pct(F.col("revenue"), total).alias("revenue_share_pct"),
    )


def cumulative_share_range(wide: DataFrame) -> DataFrame:
    """Share, and the share of all products that earn at least as much.

    Products with equal revenue get the same cumulative share.
    """
    base = _sums(wide, ["product_surr_id", "product_id"]).filter(F.col("revenue").isNotNull())
    by_value = base.groupBy("revenue").agg(F.sum("revenue").alias("_sum"))
    curve = running_totals(
        by_value,
        [-F.col("revenue")],
        {"_running": F.col("_sum")},
        grand={"_total": F.col("_sum")},
    ).select(
        "revenue",
        share_pct(F.col("revenue"), F.col("_total")).alias("product_share_pct"),
        share_pct(F.col("_running"), F.col("_total")).alias("cumulative_share_pct"),
    )
    return base.join(curve, "revenue").select(
        "product_surr_id",
        "product_id",
        "revenue",
        "product_share_pct",
        "cumulative_share_pct",
    )


_FILTERS = {
    "department": ("product", "dept_id"),
    "category": ("product", "category_id"),
    "product": ("product", "product_id"),
    "store": ("store", "store_id"),
    "state": ("store", "state_id"),
    "region": ("store", "region_id"),
}


def filter_by_dimensions(
    fact: DataFrame, product: DataFrame, store: DataFrame, filters: dict[str, str | None]
) -> DataFrame:
    """Keep fact rows whose product and store match; a semi join cannot fan out."""
    for side, dim, key in (
        ("product", product, "product_surr_id"),
        ("store", store, "store_surr_id"),
    ):
        tests = [
            F.col(column) == filters[name]
            for name, (where, column) in _FILTERS.items()
            if where == side and filters.get(name) not in (None, "")
        ]
        for test in tests:
            dim = dim.filter(test)
        if tests:
            fact = fact.join(dim.select(key), key, "left_semi")
    return fact


def contributions_topn(
    weekly: DataFrame,
    product: DataFrame,
    store: DataFrame,
    filters: dict[str, str | None] | None = None,
    n: int = 10,
) -> DataFrame:
    """Top products, departments and states of the filtered revenue."""
    if n < 1:
        raise ValueError("n must be at least 1")
    kept = filter_by_dimensions(weekly, product, store, filters or {})
    wide = kept.groupBy("product_surr_id", "store_surr_id").agg(F.sum("revenue").alias("revenue"))
    wide = wide.join(product.select("product_surr_id", "product_id", "dept_id"), "product_surr_id")
    wide = wide.join(store.select("store_surr_id", "state_id"), "store_surr_id")
    total = wide.agg(F.sum("revenue")).scalar()

    def best(level: str, column: str) -> DataFrame:
        sums = wide.groupBy(F.col(column).alias("entity")).agg(
            F.sum("revenue").alias("revenue")
        )
        ranked = top_n(sums, [F.desc_nulls_last("revenue"), F.asc("entity")], n, "rank")
        return ranked.select(
            F.lit(level).alias("level"),
            "entity",
            "revenue",
            F.round(ratio(F.col("revenue"), total) * 100, 4).alias("share_pct"),
            "rank",
        )

    return (
        best("product", "product_id")
        .unionByName(best("department", "dept_id"))
        .unionByName(best("state", "state_id"))
    )

