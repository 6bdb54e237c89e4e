"""Dashboard measures: one aggregate each, over the rows of a filter context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.config import AT_RISK_TIERS, SERIES
from demandspark.functions.exprs import (
    exact_mean,
    pct_change_positive_base,
    ratio,
    share_pct,
)
from demandspark.operators.dims import dim_week
from demandspark.operators.weekly import week_totals

# -- revenue, units, price, growth ------------------------------------------------


def totals(weekly: DataFrame, context: list[str]) -> DataFrame:
    revenue = F.sum(F.col("units").cast("decimal(18,0)") * F.col("sell_price"))
    return weekly.groupBy(*context).agg(
        revenue.alias("total_revenue"),
        F.sum("units").alias("total_units"),
        F.round(ratio(revenue, F.sum("units")), 4).alias("weighted_price"),
    )


def _previous(periods: DataFrame, ordinal: Column, out: dict[str, str]) -> DataFrame:
    """Change of each measure against the period before in the calendar; few rows, one per period.

    `ordinal` counts periods without gaps, so a period that has no rows is
    missing from the range and not replaced by an earlier one.
    """
    before = W.orderBy("_ordinal").rangeBetween(-1, -1)
    numbered = periods.withColumn("_ordinal", ordinal.cast("long"))
    return numbered.withColumns(
        {name: pct_change_positive_base(F.col(c), F.max(c).over(before)) for c, name in out.items()}
    )


def growth(weekly: DataFrame, dates: DataFrame) -> DataFrame:
    """Week, quarter and year changes; blank when the period before has no rows or no positive base.

    The period before is that of the calendar: the week before, the quarter
    before (the fourth one of the year before for a first one), the year before.
    """
    weeks = week_totals(weekly).join(
        F.broadcast(dim_week(dates).select("wm_yr_wk", "week_id", "year", "quarter")), "wm_yr_wk"
    )
    sums = [F.sum("units").alias("units"), F.sum("revenue").alias("revenue")]
    both = {"revenue": "revenue_pct", "units": "units_pct"}

    def rows(name: str, totals: DataFrame, ordinal: Column, key: Column, out: dict[str, str]) -> DataFrame:
        changes = _previous(totals, ordinal, out)
        none = F.lit(None).cast("double")
        return changes.select(
            F.lit(name).alias("period"),
            key.alias("period_key"),
            *[(F.col(c) if c in changes.columns else none).alias(c) for c in both.values()],
        )

    year, quarter = F.col("year"), F.col("quarter")
    per_quarter = weeks.groupBy("year", "quarter").agg(*sums)
    return (
        rows("week", weeks, F.col("week_id"), F.col("wm_yr_wk"), both)
        .unionByName(rows("quarter", per_quarter, year * 4 + quarter, year * 10 + quarter, {"revenue": "revenue_pct"}))
        .unionByName(rows("year", weeks.groupBy("year").agg(*sums), year, year, both))
    )


def entity_share(wide: DataFrame, scope: list[str], entity: list[str]) -> DataFrame:
    """Revenue share of each entity in its scope; `entity` includes the scope."""
    sums = wide.groupBy(*entity).agg(F.sum("revenue").alias("revenue"))
    scopes = sums.groupBy(*scope).agg(F.sum("revenue").alias("_scope"))
    return sums.join(scopes, scope).select(
        *entity, "revenue", share_pct(F.col("revenue"), F.col("_scope")).alias("entity_share_pct")
    )


# -- scenario and inventory measures ------------------------------------------------


def _exact(c: str) -> Column:
    """Sum of stored values with four places, independent of row order."""
    return F.sum(F.round(F.col(c) * 10000).cast("long")) / F.lit(10000.0)


def _weighted(value: Column, weight: Column) -> Column:
    return F.round(ratio(F.sum(value * weight), F.sum(weight)), 6)


def inventory_totals(results: DataFrame, context: list[str]) -> DataFrame:
    """The six additive totals."""
    return results.groupBy(*context).agg(
        F.sum("stockout_days").alias("total_stockout_days"),
        _exact("stockout_units").alias("total_stockout_units"),
        F.sum("excess_days").alias("total_excess_days"),
        _exact("total_excess_units").alias("total_excess_units"),
        _exact("total_demand").alias("total_demand"),
        _exact("replenishment_units").alias("replenishment_units"),
    )


def avg_service_level(results: DataFrame, context: list[str]) -> DataFrame:
    return results.groupBy(*context).agg(
        _weighted(F.col("service_level_achieved"), F.col("total_demand")).alias("avg_service_level")
    )


def fill_rates(results: DataFrame, context: list[str]) -> DataFrame:
    """Both fill rates: from stockout units, which count a backlog every day it
    stays open, and from the backlog left at the end, which is exact."""
    demand = _exact("total_demand")
    return results.groupBy(*context).agg(
        F.when(demand > 0, F.round(1 - ratio(_exact("stockout_units"), demand), 6)).alias(
            "fill_rate_units"
        ),
        F.when(demand > 0, F.round(1 - ratio(_exact("final_backorder"), demand), 6)).alias(
            "fill_rate"
        ),
    )


def inventory_means(results: DataFrame, context: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return results.groupBy(*context).agg(
        exact_mean(F.col("avg_days_of_inventory")).alias("avg_days_of_inventory"),
        exact_mean(F.col("avg_inventory_position")).alias("avg_inventory_position"),
        n.alias("series_count"),
    )


def risk_measures(ranked: DataFrame, context: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return ranked.groupBy(*context).agg(
        F.count_if(F.col("risk_tier").isin(*AT_RISK_TIERS)).alias("series_at_risk"),
        exact_mean(F.col("risk_score"), 6).alias("avg_risk_score"),
        n.alias("series_count"),
    )


def service_gap(results: DataFrame, context: list[str]) -> DataFrame:
    gap = F.greatest(F.col("service_level_target") - F.col("service_level_achieved"), F.lit(0.0))
    return results.groupBy(*context).agg(
        _weighted(gap, F.col("total_demand")).alias("service_gap")
    )


def scenario_measure_deltas(results: DataFrame) -> DataFrame:
    """Five measures of each scenario minus those of the baseline."""
    names = {
        "total_stockout_units": "delta_stockout_units",
        "avg_service_level": "delta_service_level",
        "total_excess_days": "delta_excess_days",
        "fill_rate_units": "delta_fill_rate",
        "avg_inventory_position": "delta_avg_inventory_position",
    }
    key = ["scenario_name", "scenario_type"]
    per_scenario = (
        inventory_totals(results, key)
        .join(avg_service_level(results, key), key)
        .join(fill_rates(results, key), key)
        .join(inventory_means(results, key), key)
        .select(*key, *names)
    )
    base = (
        per_scenario.filter("scenario_type = 'baseline'").agg(F.max(F.struct(*names))).scalar()
    )
    return per_scenario.withColumn("_b", base).select(
        *key, *[F.round(F.col(c) - F.col(f"_b.{c}"), 6).alias(o) for c, o in names.items()]
    )


# -- forecast measures ----------------------------------------------------------------


def forecast_accuracy(evaluation: DataFrame, stats: DataFrame, context: list[str]) -> DataFrame:
    """Plain means, and means weighted by the total units of the series."""
    joined = evaluation.join(stats.select(*SERIES, "total_units"), SERIES)
    w = F.col("total_units")
    return joined.groupBy(*context).agg(
        *[exact_mean(F.col(m), 6).alias(f"forecast_{m}") for m in ("mae", "rmse", "bias")],
        *[
            F.round(ratio(F.sum(F.col(m) * w), F.sum(w)), 6).alias(f"forecast_{m}")
            for m in ("wmae", "wrmse")
        ],
    )


def common_series(evaluation: DataFrame, n_models: int | None = None) -> DataFrame:
    """Evaluation rows of the series that every model was scored on."""
    models = (
        F.lit(n_models)
        if n_models is not None
        else evaluation.select("model").distinct().agg(F.count(F.lit(1))).scalar()
    )
    scored = evaluation.select(*SERIES, "model").distinct().groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return evaluation.join(scored.filter(F.col("_n") == models), SERIES, "left_semi")


def accuracy_by_hierarchy(
    evaluation: DataFrame, stats: DataFrame, product: DataFrame, store: DataFrame
) -> DataFrame:
    """Weighted error by department, store and model family, bias by both.

    One pass with grouping sets over (department, store, model family).
    """
    from demandspark.operators.forecast import model_family

    rows = (
        evaluation.join(stats.select(*SERIES, "total_units"), SERIES)
        .join(product.select("product_surr_id", "dept_id"), "product_surr_id")
        .join(store.select("store_surr_id", "store_id"), "store_surr_id")
        .withColumn("family", model_family(F.col("model")))
    )
    columns = ["dept_id", "store_id", "family"]
    sets = [["dept_id"], ["store_id"], ["family"], ["dept_id", "store_id"]]
    w = F.col("total_units")
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(
        F.round(ratio(F.sum(F.col("wmae") * w), F.sum(w)), 6).alias("wmae"),
        exact_mean(F.col("bias"), 6).alias("bias"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def provenance_label(df: DataFrame, context: list[str], otherwise: str | None = None) -> DataFrame:
    """The provenance if all rows share one, else blank or a given word."""
    same = F.min("data_provenance") == F.max("data_provenance")
    return df.groupBy(*context).agg(
        F.when(same, F.min("data_provenance")).otherwise(F.lit(otherwise).cast("string")).alias(
            "provenance_label"
        )
    )


# -- dashboard pages --------------------------------------------------------------------


def segment_histograms(analysis: DataFrame, product: DataFrame, bins: int = 12) -> DataFrame:
    """Counts per class and CV bin, means per category, as (view, label, value)."""
    from demandspark.operators.quality import histogram

    n = F.count(F.lit(1)).cast("double")

    def counts(view: str, label: Column, df: DataFrame = analysis) -> DataFrame:
        return df.groupBy(label.cast("string").alias("label")).agg(n.alias("value")).select(
            F.lit(view).alias("view"), "label", "value"
        )

    by_category = analysis.join(product.select("product_surr_id", "category_id"), "product_surr_id")
    meaningful = F.when(F.col("has_meaningful_seasonality"), F.col("seasonality_strength"))
    means = by_category.groupBy("category_id").agg(
        F.round(F.avg("demand_growth_rate"), 6).alias("mean_growth"),
        F.round(F.avg("trend_effect_pct"), 4).alias("mean_trend_effect"),
        F.round(F.avg(meaningful), 6).alias("mean_seasonality_strength"),
    ).unpivot(
        ["category_id"],
        ["mean_growth", "mean_trend_effect", "mean_seasonality_strength"],
        "view",
        "value",
    ).select("view", F.col("category_id").alias("label"), "value")
    growth = F.when(F.col("growth_is_defined"), "defined").when(
        F.col("growth_denominator_zero"), "zero_base"
    ).otherwise("missing")
    cv = histogram(analysis, "cv", bins).select(
        F.lit("cv_histogram").alias("view"),
        F.col("bin").cast("string").alias("label"),
        F.col("n").cast("double").alias("value"),
    )
    parts = [
        counts("trend", F.col("trend_direction")),
        counts("pattern", F.col("segment_demand")),
        counts("volatility", F.col("segment_volatility")),
        counts("risk_matrix", F.col("risk_cell")),
        counts("growth_defined", growth),
        counts("peak_month", F.col("peak_month")),
        counts("trough_month", F.col("trough_month")),
        means,
        cv,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def seasonality_by_month(seasonality: DataFrame) -> DataFrame:
    return seasonality.groupBy("month").agg(
        F.round(F.avg("seasonality_index"), 6).alias("mean_index")
    )


def inventory_by_day(projection: DataFrame) -> DataFrame:
    """Mean service level and position of each horizon day."""
    return projection.groupBy("day_id").agg(
        exact_mean(F.col("service_level_achieved"), 6).alias("mean_service_level"),
        exact_mean(F.col("inventory_position")).alias("mean_position"),
    )


def inventory_breakdowns(
    results: DataFrame, product: DataFrame, store: DataFrame, bins: int = 10
) -> DataFrame:
    """Cover by department, service gap by store, service-level histogram."""
    from demandspark.operators.quality import histogram

    dept = results.join(product.select("product_surr_id", "dept_id"), "product_surr_id")
    shop = results.join(store.select("store_surr_id", "store_id"), "store_surr_id")
    return (
        inventory_means(dept, ["dept_id"])
        .select(
            F.lit("cover_by_department").alias("view"),
            F.col("dept_id").alias("label"),
            F.col("avg_days_of_inventory").alias("value"),
        )
        .unionByName(
            service_gap(shop, ["store_id"]).select(
                F.lit("gap_by_store").alias("view"),
                F.col("store_id").alias("label"),
                F.col("service_gap").alias("value"),
            )
        )
        .unionByName(
            histogram(results, "service_level_achieved", bins).select(
                F.lit("service_histogram").alias("view"),
                F.col("bin").cast("string").alias("label"),
                F.col("n").cast("double").alias("value"),
            )
        )
    )
