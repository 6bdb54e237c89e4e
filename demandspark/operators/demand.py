"""Per-series demand statistics, growth, trend, seasonality and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.config import DERIVED, SERIES, DemandRules
from demandspark.functions.exprs import exact_day_slope, exact_variance, ratio
from demandspark.functions.ordering import exact_quantiles

RULES = DemandRules()


def demand_stats(
    daily: DataFrame, first_day: int | None = None, last_day: int | None = None
) -> DataFrame:
    """Span, volume, mean, deviation, zero days, growth and slope per series.

    With `first_day` and `last_day` a missing day in that window is a day
    without demand: such days add nothing to the sums of units, squares and
    products, so the window is never filled up. Without them the rows are
    taken as complete and each series spans its own first to last day. Either
    way one aggregation of whole-number sums does it, whose result does not
    depend on the order of rows.
    """
    day, units = F.col("date_id"), F.col("units_sold")
    if last_day is None:
        w = W.partitionBy(*SERIES)
        daily = daily.withColumn("_last", F.max("date_id").over(w))
        start, end = F.min("date_id"), F.max("date_id")
    else:
        daily = daily.filter(day.between(first_day, last_day)).withColumn("_last", F.lit(last_day))
        start, end = F.lit(first_day), F.lit(last_day)
    age = F.col("_last") - day
    x = day.cast("long")
    sums = daily.groupBy(*SERIES).agg(
        start.alias("series_start"),
        end.alias("series_end"),
        F.sum(units).cast("long").alias("total_units"),
        F.sum(units.cast("decimal(19,0)") * units.cast("decimal(19,0)")).alias("_yy"),
        F.sum(x * units).alias("_xy"),
        F.count_if(units != 0).alias("_sold"),
        F.sum(F.when(age < 28, units)).alias("_recent"),
        F.sum(F.when(age.between(28, 55), units)).alias("_prior"),
    )
    if last_day is not None:
        sums = sums.fillna(0, ["_recent", "_prior"])
    n = (F.col("series_end") - F.col("series_start") + 1).cast("double")
    total = F.col("total_units").cast("double")
    variance = exact_variance(n, F.col("total_units"), F.col("_yy"))
    slope = exact_day_slope(F.col("series_start"), F.col("series_end"), F.col("total_units"), F.col("_xy"))
    out = sums.select(
        "*",
        ratio(total, n).alias("_mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("_std"),
        slope.alias("_slope"),
    )
    return out.select(
        *SERIES,
        "series_start",
        "series_end",
        "total_units",
        F.round("_mean", 4).alias("mean_daily_units"),
        F.round("_std", 4).alias("std_daily_units"),
        F.round(ratio(F.col("_std"), F.col("_mean")), 4).alias("cv"),
        (n.cast("long") - F.col("_sold")).alias("zero_demand_days"),
        F.round(ratio(F.col("_recent"), F.col("_prior")) - 1, 6).alias("demand_growth_rate"),
        F.round("_slope", 8).alias("trend_slope"),
    )


def recent_prior_growth(
    daily: DataFrame, first_day: int | None = None, last_day: int | None = None
) -> DataFrame:
    return demand_stats(daily, first_day, last_day).select(*SERIES, "demand_growth_rate")


def volume_quantiles(stats: DataFrame, rules: DemandRules = RULES) -> DataFrame:
    """The two volume cuts, interpolated, over all series."""
    return exact_quantiles(
        stats,
        "total_units",
        {"low_q": rules.volume_quantile_low, "high_q": rules.volume_quantile_high},
    )


#: Items per level of a quantile sketch; see `sketch_rank_error`.
SKETCH_ITEMS = 4096


def sketch_rank_error(items: int = SKETCH_ITEMS) -> float:
    """Share of all rows by which the rank of a sketched quantile is off, with 99 % confidence: 0.13 % by default.

    The published fit for one-sided rank errors of this kind of sketch.
    """
    return 2.296 / items**0.9021


def volume_sketches(stats: DataFrame, by: list[str], items: int = SKETCH_ITEMS) -> DataFrame:
    """A quantile sketch of the lifetime units of each group.

    Sketches of a few kilobytes can be written, kept by slice and merged
    later, so a new slice needs no second look at the others. Null units are
    left out.
    """
    sketch = F.kll_sketch_agg_bigint(F.col("total_units").cast("bigint"), items)
    return stats.groupBy(*by).agg(sketch.alias("sketch"), F.count("total_units").alias("n_series"))


def sketched_volume_quantiles(sketches: DataFrame, rules: DemandRules = RULES, items: int = SKETCH_ITEMS) -> DataFrame:
    """The two volume cuts from merged sketches: values that occur, not interpolated.

    Within `sketch_rank_error` of the asked rank; exact while all sketches
    together hold fewer than `items` rows. `volume_quantiles` is the exact form
    and the one that the segments use. No rows give nulls.
    """
    kept = sketches.filter(F.col("n_series") > 0)
    merged = kept.agg(F.kll_merge_agg_bigint("sketch", items).alias("sketch"), F.coalesce(F.sum("n_series"), F.lit(0)).alias("n_series"))

    def at(share: float) -> Column:
        return F.when(F.col("n_series") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(share)))

    return merged.select(at(rules.volume_quantile_low).alias("low_q"), at(rules.volume_quantile_high).alias("high_q"), "n_series")


def volume_cuts(stats: DataFrame, rules: DemandRules = RULES) -> tuple[Column, Column]:
    """The two cuts as scalars, each rounded so that equal data give equal cuts."""
    cuts = volume_quantiles(stats, rules)
    both = cuts.select(
        F.struct(F.round("low_q", 6).alias("low"), F.round("high_q", 6).alias("high"))
    ).scalar()
    return both["low"], both["high"]


def weekly_growth(weekly: DataFrame) -> DataFrame:
    """Mean weekly units over all weeks, the last four and the four before."""
    w = W.partitionBy(*SERIES).orderBy(F.desc("week_id"))
    ranked = weekly.select(*SERIES, "units", F.row_number().over(w).alias("_rank"))

    def mean(lo: int, hi: int) -> Column:
        return F.avg(F.when(F.col("_rank").between(lo, hi), F.col("units")))

    return ranked.groupBy(*SERIES).agg(
        F.avg("units").alias("avg_week_units"),
        mean(1, 4).alias("recent_4wk_mean"),
        mean(5, 8).alias("prior_4wk_mean"),
    )


def growth_guard(recent: Column, prior: Column, rules: DemandRules = RULES) -> dict[str, Column]:
    """Growth with flags that tell an undefined base from missing weeks."""
    both = recent.isNotNull() & prior.isNotNull()
    based = prior > rules.growth_epsilon
    return {
        "demand_growth_rate": F.when(both & based, F.try_divide(recent, prior) - 1),
        "growth_is_defined": both & F.coalesce(based, F.lit(False)),
        "growth_denominator_zero": both & F.coalesce(~based, F.lit(False)),
    }


def trend_effect(
    slope: Column, span: Column, mean: Column, rules: DemandRules = RULES
) -> Column:
    defined = (
        (span >= rules.trend_min_span) & (F.abs(mean) >= rules.trend_min_mean) & slope.isNotNull()
    )
    return F.when(defined, F.try_divide(slope * span, F.abs(mean)) * F.lit(100.0))


def trend_direction(effect: Column, rules: DemandRules = RULES) -> Column:
    return (
        F.when(effect >= rules.trend_up_pct, "increasing")
        .when(effect <= rules.trend_down_pct, "decreasing")
        .otherwise("flat")
    )


def monthly_means(
    weekly: DataFrame, dates: DataFrame, attribution: str = "every_month"
) -> DataFrame:
    """Mean weekly units per series and month.

    A week over a month end counts in both months, or, with
    `attribution="first_day"`, in the month of its first day.
    """
    if attribution == "first_day":
        months = dates.groupBy("wm_yr_wk").agg(F.min_by("month", "date_id").alias("month"))
    else:
        months = dates.select("wm_yr_wk", "month").distinct()
    return (
        weekly.select(*SERIES, "wm_yr_wk", "units")
        .join(F.broadcast(months), "wm_yr_wk")
        .groupBy(*SERIES, "month")
        .agg(
            F.avg("units").alias("mean_weekly"),
            F.count_if(F.col("units") > 0).alias("obs_weeks"),
        )
    )


def monthly_seasonality(monthly: DataFrame, rules: DemandRules = RULES) -> DataFrame:
    """Seasonal index of each active month with the strength of its series.

    Windows hold the at most twelve months of one series. Equal peaks or
    troughs take the lowest month.
    """
    series = W.partitionBy(*SERIES)
    index = F.col("seasonality_index")
    indexed = (
        monthly.filter("mean_weekly > 0")
        .withColumn("seasonality_index", F.col("mean_weekly") / F.avg("mean_weekly").over(series))
        .withColumn("n_active_months", F.count(F.lit(1)).over(series))
        .withColumn("_mean", F.avg(index).over(series))
        .withColumn("_std", F.stddev_pop(index).over(series))
        .withColumn("_rounded", F.round(index, 9))
    )
    return indexed.select(
        *SERIES,
        "month",
        "seasonality_index",
        "obs_weeks",
        "n_active_months",
        (F.col("_std") / F.abs(F.col("_mean"))).alias("seasonality_strength"),
        F.max_by(F.col("month"), F.struct(F.col("_rounded"), -F.col("month")))
        .over(series)
        .alias("peak_month"),
        F.min_by(F.col("month"), F.struct(F.col("_rounded"), F.col("month")))
        .over(series)
        .alias("trough_month"),
    ).withColumn(
        "has_meaningful_seasonality",
        (F.col("n_active_months") >= rules.season_min_active_months)
        & (F.col("seasonality_strength") > rules.season_min_std),
    )


def seasonality_fact(seasonal: DataFrame) -> DataFrame:
    """Index rows of the series whose seasonality is meaningful."""
    return seasonal.filter("has_meaningful_seasonality").select(
        *SERIES,
        F.lit("observed_full").alias("analysis_window"),
        "month",
        "seasonality_index",
        "obs_weeks",
        F.lit(True).alias("is_meaningful"),
        F.lit(DERIVED).alias("data_provenance"),
    )


def series_seasonality(seasonal: DataFrame) -> DataFrame:
    """One row per series: strength, peak, trough, months, flag."""
    first = lambda c: F.max(c).alias(c)  # noqa: E731  (constant in a series)
    return seasonal.groupBy(*SERIES).agg(
        first("seasonality_strength"),
        first("peak_month"),
        first("trough_month"),
        first("n_active_months"),
        first("has_meaningful_seasonality"),
    )


DOW_SCOPES = {
    "all": [],
    "store": ["store_id"],
    "state": ["state_id"],
    "category": ["category_id"],
    "dept": ["dept_id"],
}


def dow_fine(
    daily: DataFrame,
    dates: DataFrame,
    product: DataFrame,
    store: DataFrame,
    first_day: int | None = None,
    last_day: int | None = None,
) -> DataFrame:
    """Units and series-days per store, product group and weekday in one scan.

    With a day window, every series counts each of its days, sold or not; the
    day counts then come from the number of series and the calendar.
    """
    days = dates.filter("is_observed").select("date_id", "weekday_num", "weekday_name")
    dims = ["store_surr_id", "category_id", "dept_id", "weekday_num", "weekday_name"]
    products = product.select("product_surr_id", "category_id", "dept_id")
    labelled = daily.join(F.broadcast(days), "date_id").join(products, "product_surr_id")
    sums = labelled.groupBy(*dims).agg(
        F.sum("units_sold").alias("units"), F.count(F.lit(1)).alias("days")
    )
    if last_day is not None:
        per_weekday = (
            days.filter(F.col("date_id").between(first_day, last_day))
            .groupBy("weekday_num", "weekday_name")
            .agg(F.count(F.lit(1)).alias("_calendar_days"))
        )
        weekdays = per_weekday.agg(
            F.collect_list(F.struct("weekday_num", "weekday_name", "_calendar_days"))
        ).scalar()  # seven entries
        series = (
            daily.select(*SERIES)
            .distinct()
            .join(products, "product_surr_id")
            .groupBy("store_surr_id", "category_id", "dept_id")
            .agg(F.count(F.lit(1)).alias("_series"))
        )
        grid = series.withColumn("_w", F.explode(weekdays)).select(
            "store_surr_id",
            "category_id",
            "dept_id",
            "_w.weekday_num",
            "_w.weekday_name",
            (F.col("_series") * F.col("_w._calendar_days")).alias("days"),
        )
        sums = grid.join(sums.drop("days"), dims, "left").fillna(0, ["units"])
    return sums.join(store.select("store_surr_id", "store_id", "state_id"), "store_surr_id")


def dow_factors(fine: DataFrame) -> DataFrame:
    """Weekday index per scope: weekday mean over scope mean, all from one pass."""
    columns = ["store_id", "state_id", "category_id", "dept_id"]
    weekday = ["weekday_num", "weekday_name"]
    sets = [[*map(F.col, keys), *map(F.col, weekday)] for keys in DOW_SCOPES.values()]
    sums = fine.groupingSets(sets, *map(F.col, columns + weekday)).agg(
        F.sum("units").alias("units"),
        F.sum("days").alias("days"),
        *[F.grouping(c).alias(f"_no_{c}") for c in columns],
    )
    scope_type = F.lit("all")
    scope_key = F.lit(None).cast("string")
    for name, keys in DOW_SCOPES.items():
        for key in keys:
            hit = F.col(f"_no_{key}") == 0
            scope_type = F.when(hit, name).otherwise(scope_type)
            scope_key = F.when(hit, F.col(key)).otherwise(scope_key)
    scoped = sums.withColumns({"scope_type": scope_type, "scope_key": scope_key})
    scope = W.partitionBy("scope_type", "scope_key")  # seven weekdays each
    return (
        scoped.withColumn("_units", F.sum("units").over(scope))
        .withColumn("_days", F.sum("days").over(scope))
        .filter((F.col("_units") != 0) & (F.col("_days") != 0))
        .select(
            "scope_type",
            "scope_key",
            F.coalesce("scope_key", F.lit("all")).alias("scope_value"),
            *weekday,
            ratio(
                ratio(F.col("units"), F.col("days")), ratio(F.col("_units"), F.col("_days"))
            ).alias("dow_index"),
            F.col("days").alias("obs_days"),
        )
    )


def dow_factors_from_means(means: DataFrame, keys: list[str]) -> DataFrame:
    """Weekday mean over the simple mean of the positive weekday means."""
    w = W.partitionBy(*keys)
    return means.filter("mean_daily > 0").withColumn(
        "dow_factor", F.col("mean_daily") / F.avg("mean_daily").over(w)
    )


# -- segments ------------------------------------------------------------------------


def segment_volume(total: Column, low: Column, high: Column) -> Column:
    return F.when(total <= low, "Low").when(total <= high, "Medium").otherwise("High")


def segment_volatility(cv: Column, rules: DemandRules = RULES) -> Column:
    return F.when(cv < rules.cv_low, "Low").when(cv < rules.cv_high, "Medium").otherwise("High")


def classify_demand(zero_ratio: Column, rules: DemandRules = RULES) -> Column:
    return (
        F.when(zero_ratio < rules.zero_ratio_erratic, "Smooth")
        .when(zero_ratio < rules.zero_ratio_lumpy, "Erratic")
        .when(zero_ratio < rules.zero_ratio_intermittent, "Lumpy")
        .otherwise("Intermittent")
    )


def _level(label: Column) -> Column:
    return F.when(label == "Low", 1).when(label == "Medium", 2).otherwise(3)


def risk_matrix(volume: Column, volatility: Column, rules: DemandRules = RULES) -> dict[str, Column]:
    index = _level(volume) * _level(volatility)
    return {
        "risk_cell": F.concat_ws("*", volume, volatility),
        "risk_index": index,
        "risk_category": F.when(index >= rules.risk_critical, "Critical")
        .when(index >= rules.risk_high, "High")
        .when(index >= rules.risk_moderate, "Moderate")
        .otherwise("Low"),
    }


def with_segments(
    stats: DataFrame, low: Column, high: Column, rules: DemandRules = RULES
) -> DataFrame:
    """Zero ratio, volume, volatility, pattern and risk of each series."""
    span = F.col("series_end") - F.col("series_start") + 1
    staged = stats.withColumn(
        "zero_demand_ratio", ratio(F.col("zero_demand_days"), span)
    ).withColumns(
        {
            "segment_volume": segment_volume(F.col("total_units"), low, high),
            "segment_volatility": segment_volatility(F.col("cv"), rules),
            "segment_demand": classify_demand(F.col("zero_demand_ratio"), rules),
        }
    )
    return staged.withColumns(
        risk_matrix(F.col("segment_volume"), F.col("segment_volatility"), rules)
    )


def demand_analysis(
    stats: DataFrame, growth: DataFrame, seasonal: DataFrame, rules: DemandRules = RULES
) -> DataFrame:
    """Everything known about a series in one row."""
    low, high = volume_cuts(stats, rules)
    span = F.col("series_end") - F.col("series_start") + 1
    effect = trend_effect(F.col("trend_slope"), span, F.col("mean_daily_units"), rules)
    joined = (
        stats.drop("demand_growth_rate")
        .join(growth, SERIES, "left")
        .join(series_seasonality(seasonal), SERIES, "left")
    )
    measured = (
        with_segments(joined, low, high, rules)
        .withColumns(growth_guard(F.col("recent_4wk_mean"), F.col("prior_4wk_mean"), rules))
        .withColumn("trend_effect_pct", effect)
        .withColumn("trend_direction", trend_direction(F.col("trend_effect_pct"), rules))
        .withColumn(
            "has_meaningful_seasonality",
            F.coalesce("has_meaningful_seasonality", F.lit(False)),
        )
    )
    return measured.select(
        *SERIES,
        F.lit("observed_full").alias("analysis_window"),
        "series_start",
        "series_end",
        "total_units",
        "mean_daily_units",
        "std_daily_units",
        "cv",
        "zero_demand_days",
        "zero_demand_ratio",
        "avg_week_units",
        "recent_4wk_mean",
        "prior_4wk_mean",
        "demand_growth_rate",
        "growth_is_defined",
        "growth_denominator_zero",
        "trend_slope",
        "trend_effect_pct",
        "trend_direction",
        "seasonality_strength",
        "has_meaningful_seasonality",
        "peak_month",
        "trough_month",
        F.when(F.col("has_meaningful_seasonality"), F.col("n_active_months")).alias(
            "n_active_months"
        ),
        "segment_volume",
        "segment_volatility",
        "segment_demand",
        "risk_cell",
        "risk_category",
        F.lit(DERIVED).alias("data_provenance"),
    )
