"""Data checks, profiles and reconciliation, one result row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from demandspark.config import PROVENANCES, SERIES
from demandspark.functions.exprs import ratio
from demandspark.sources.raw_files import day_columns

# Required columns of the raw files.
CALENDAR_COLUMNS = (
    "wm_yr_wk", "weekday", "wday", "month", "year", "d", "date", "event_name_1", "event_type_1",
    "event_name_2", "event_type_2", "snap_CA", "snap_TX", "snap_WI",
)
SALES_COLUMNS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
PRICE_COLUMNS = ("item_id", "store_id", "wm_yr_wk", "sell_price")
_SEVERITY = {"pass": "info", "warn": "warning", "fail": "error"}


def check_row(measured: DataFrame, category: str, check: str, status: Column, detail: Column) -> DataFrame:
    """Turn one row of measures into a result row."""
    severity = F.create_map(*[F.lit(x) for kv in _SEVERITY.items() for x in kv])
    return measured.select(
        F.lit(category).alias("category"),
        F.lit(check).alias("check"),
        status.alias("status"),
        detail.alias("detail"),
        severity[status].alias("severity"),
    )


def _pass_if(ok: Column) -> Column:
    return F.when(ok, "pass").otherwise("fail")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_schema(df: DataFrame, required: tuple[str, ...], label: str) -> DataFrame:
    """Required columns are there; the detail names the missing ones and counts rows."""
    missing = sorted(set(required) - set(df.columns))
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return check_row(
        counted,
        "structural",
        f"columns:{label}",
        F.lit("fail" if missing else "pass"),
        F.concat(F.lit(f"missing={','.join(missing)} rows="), F.col("n").cast("string")),
    )


def check_numeric_types(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    bad = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return check_row(
        counted,
        "structural",
        f"numeric:{label}",
        F.lit("fail" if bad else "pass"),
        F.concat(F.lit(f"not numeric={','.join(bad)} rows="), F.col("n").cast("string")),
    )


def check_file_columns(raw: DataFrame, required: tuple[str, ...], label: str, days: bool = False) -> DataFrame:
    """The header of a file (read as text) names the required columns; `days` asks for day columns without a gap.

    The detail names what is missing and counts rows. A file without any day
    column misses `d_*`.
    """
    missing = sorted(set(required) - set(raw.columns))
    if days:
        numbers = [int(c[2:]) for c in day_columns(raw.columns)]
        held = set(numbers)
        missing += [f"d_{n}" for n in range(min(held), max(held) + 1) if n not in held] if held else ["d_*"]
    return check_row(
        raw.agg(F.count(F.lit(1)).alias("n")),
        "structural",
        f"columns:{label}",
        F.lit("fail" if missing else "pass"),
        F.concat(F.lit(f"missing={','.join(missing)} rows="), F.col("n").cast("string")),
    )


def check_file_numbers(raw: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Every value that is there in these columns of a file (read as text) is a number.

    One pass over the text; only cells that are no number leave their row. The
    detail names the columns that hold one and counts rows. A column that the
    file lacks is not judged here.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in columns if c in raw.columns])
    if not any(c in raw.columns for c in columns):
        cells = F.array().cast("array<struct<c:string,v:string>>")
    wrong = F.transform(
        F.filter(cells, lambda x: x["v"].isNotNull() & x["v"].try_cast("double").isNull()), lambda x: x["c"]
    )
    judged = raw.select(wrong.alias("_wrong"))
    named = judged.select(F.explode("_wrong").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    bad = named.agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("names"))
    measured = judged.agg(F.count(F.lit(1)).alias("n")).select("n", bad.scalar().alias("names"))
    return check_row(
        measured,
        "structural",
        f"numeric:{label}",
        _pass_if(F.col("names") == ""),
        F.concat(F.lit("not numeric="), F.col("names"), F.lit(" rows="), F.col("n").cast("string")),
    )


def duplicate_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def check_duplicates(df: DataFrame, key: list[str], label: str) -> DataFrame:
    return check_row(
        duplicate_rows(df, key),
        "duplicates",
        f"dup_key:{label}",
        _pass_if(F.col("n") == 0),
        F.concat(F.col("n").cast("string"), F.lit(" duplicate key rows")),
    )


def check_nulls(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    detail = F.concat_ws(
        " ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns]
    )
    return check_row(counts, "nulls", f"null_critical:{label}", _pass_if(total == 0), detail)


def check_date_continuity(calendar: DataFrame) -> DataFrame:
    """No missing and no repeated dates, two result rows."""
    per_date = calendar.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    m = per_date.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("_rows").alias("rows"),
        (F.date_diff(F.max("date"), F.min("date")) + 1).alias("expected"),
    )
    text = lambda c: F.col(c).cast("string")
    continuity = check_row(
        m,
        "date",
        "calendar_date_continuity",
        _pass_if(F.col("days") == F.col("expected")),
        F.concat(F.lit("expected="), text("expected"), F.lit(" actual="), text("days")),
    )
    repeated = check_row(
        m,
        "date",
        "calendar_duplicate_dates",
        _pass_if(F.col("rows") == F.col("days")),
        F.concat((F.col("rows") - F.col("days")).cast("string"), F.lit(" duplicate dates")),
    )
    return continuity.unionByName(repeated)


def check_negative(df: DataFrame, column: str, label: str) -> DataFrame:
    m = df.agg(F.count_if(F.col(column) < 0).alias("n"))
    return check_row(
        m,
        "numeric",
        f"negative:{label}",
        _pass_if(F.col("n") == 0),
        F.concat(F.col("n").cast("string"), F.lit(" negative values")),
    )


def check_price_range(prices: DataFrame, ceiling: float = 100.0) -> DataFrame:
    """Negative prices fail; zero or very high prices warn; the worst one counts."""
    p = F.col("sell_price")
    m = prices.agg(
        F.min(p).cast("double").alias("lo"),
        F.max(p).cast("double").alias("hi"),
        F.count_if(p < 0).alias("neg"),
        F.count_if(p == 0).alias("zero"),
    )
    status = (
        F.when(F.col("neg") > 0, "fail")
        .when((F.col("zero") > 0) | (F.col("hi") > ceiling), "warn")
        .otherwise("pass")
    )
    detail = F.format_string(
        "min=%.2f max=%.2f negative=%d zero=%d", "lo", "hi", "neg", "zero"
    )
    return check_row(m, "numeric", "sell_price_range", status, detail)


def check_subset(child: DataFrame, parent: DataFrame, key: list[str], label: str) -> DataFrame:
    """Every key of the child occurs in the parent."""
    lost = child.select(*key).distinct().join(parent.select(*key).distinct(), key, "left_anti")
    return check_row(
        lost.agg(F.count(F.lit(1)).alias("n")),
        "referential",
        f"subset:{label}",
        _pass_if(F.col("n") == 0),
        F.concat(F.col("n").cast("string"), F.lit(" keys without parent")),
    )


def check_referential(prices: DataFrame, sales: DataFrame) -> DataFrame:
    return check_subset(prices, sales, ["item_id"], "price_items").unionByName(
        check_subset(prices, sales, ["store_id"], "price_stores")
    )


def check_hierarchy(meta: DataFrame, n_products: int, n_stores: int) -> DataFrame:
    """Each department in one category; the expected numbers of products and stores."""
    pairs = meta.select("dept_id", "cat_id").distinct()
    widest = pairs.groupBy("dept_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    unique = check_row(
        widest,
        "hierarchy",
        "dept_in_one_category",
        _pass_if(F.col("n") == 1),
        F.concat(F.lit("most categories of a department="), F.col("n").cast("string")),
    )
    extent = meta.agg(
        F.countDistinct("item_id").alias("p"), F.countDistinct("store_id").alias("s")
    )
    size = check_row(
        extent,
        "hierarchy",
        "hierarchy_extent",
        F.when((F.col("p") == n_products) & (F.col("s") == n_stores), "pass").otherwise("warn"),
        F.format_string("products=%d stores=%d", "p", "s"),
    )
    return unique.unionByName(size)


def check_orphans(
    daily: DataFrame, product: DataFrame, store: DataFrame, dates: DataFrame
) -> DataFrame:
    """Fact rows that miss their product, store or date."""
    known = (
        daily.select("product_surr_id", "store_surr_id", "date_id")
        .join(product.select("product_surr_id"), "product_surr_id", "left_semi")
        .join(store.select("store_surr_id"), "store_surr_id", "left_semi")
        .join(dates.select("date_id"), "date_id", "left_semi")
    )
    # A semi join keeps a row once, however often a dimension repeats its key.
    counts = [df.agg(F.count(F.lit(1)).alias("n")) for df in (daily, known)]
    return check_row(
        counts[0].agg((F.max("n") - counts[1].scalar()).alias("n")),
        "integrity",
        "orphan_sales_keys",
        _pass_if(F.col("n") == 0),
        F.concat(F.col("n").cast("string"), F.lit(" orphan rows")),
    )


def check_fact_keys_unique(daily: DataFrame, price: DataFrame) -> DataFrame:
    """Keys that occur more than once in the two facts."""

    def one(df: DataFrame, key: list[str], label: str) -> DataFrame:
        repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        return check_row(
            repeated.agg(F.count(F.lit(1)).alias("n")),
            "integrity",
            f"unique_keys:{label}",
            _pass_if(F.col("n") == 0),
            F.concat(F.col("n").cast("string"), F.lit(" repeated keys")),
        )

    return one(daily, [*SERIES, "date_id"], "daily_sales").unionByName(
        one(price, [*SERIES, "wm_yr_wk"], "weekly_price")
    )


def reconcile_totals(
    staged: DataFrame, daily: DataFrame, price: DataFrame, dimensions: dict[str, DataFrame]
) -> DataFrame:
    """Counts and sums of staged rows, facts and dimensions as (measure, value).

    Distinct keys are counted after a partial aggregation, so no set of all
    fact rows is built.
    """
    def values(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        row = df.agg(*[c.cast("double").alias(n) for n, c in aggs.items()])
        return row.unpivot([], list(aggs), "measure", "value")

    parts = [
        values(staged, {"staged_rows": F.count(F.lit(1)), "staged_units": F.sum("units")}),
        values(
            daily,
            {
                "fact_rows": F.count(F.lit(1)),
                "fact_units": F.sum("units_sold"),
            },
        ),
        values(
            price,
            {
                "price_rows": F.count(F.lit(1)),
                "price_min": F.min("sell_price"),
                "price_max": F.max("sell_price"),
            },
        ),
    ]
    for name, column in (
        ("n_products", "product_surr_id"), ("n_stores", "store_surr_id"), ("n_days", "date_id"),
    ):
        parts.append(values(daily.select(column).distinct(), {name: F.count(F.lit(1))}))
    for name, df in dimensions.items():
        parts.append(values(df, {f"rows_{name}": F.count(F.lit(1))}))
    return union_all(parts)


def value_domains(rules: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows that break each rule; rules over one table share one pass."""
    tables: list[tuple[DataFrame, dict[str, Column]]] = []
    for name, (df, ok) in rules.items():
        for known, group in tables:
            if known is df:
                group[name] = ok
                break
        else:
            tables.append((df, {name: ok}))
    parts = []
    for df, group in tables:
        broken = df.agg(
            *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(n) for n, ok in group.items()]
        )
        rows = broken.unpivot([], list(group), "rule", "n")
        severity = F.when(F.col("n") == 0, "info").otherwise("error")
        parts.append(
            rows.select(
                F.lit("domain").alias("category"),
                F.col("rule").alias("check"),
                _pass_if(F.col("n") == 0).alias("status"),
                F.concat(F.col("n").cast("string"), F.lit(" rows break the rule")).alias("detail"),
                severity.alias("severity"),
            )
        )
    return union_all(parts)


def check_value_domains(
    daily: DataFrame, price: DataFrame, store: DataFrame, category: DataFrame, dates: DataFrame,
    ranked: DataFrame | None = None, states: tuple[str, ...] | None = None,
    years: tuple[int, int] = (2000, 2030),
) -> DataFrame:
    rules: dict[str, tuple[DataFrame, Column]] = {
        "units_not_negative": (daily, F.col("units_sold") >= 0),
        "provenance_known": (daily, F.col("demand_source").isin(*PROVENANCES)),
        "price_not_negative": (price, F.col("sell_price") >= 0),
        "region_known": (store, F.col("region_id").isin("West", "Central", "East")),
        "category_upper": (category, F.col("category_id") == F.upper("category_id")),
        "month_range": (dates, F.col("month").between(1, 12)),
        "quarter_range": (dates, F.col("quarter").between(1, 4)),
        "year_range": (dates, F.col("year").between(*years)),
    }
    if states is not None:
        rules["state_known"] = (store, F.col("state_id").isin(*states))
    if ranked is not None:
        rules["tier_known"] = (
            ranked, F.col("risk_tier").isin("Critical", "High", "Medium", "Low")
        )
        rules["rank_positive"] = (ranked, F.col("risk_rank") >= 1)
    return value_domains(rules)


# -- profiles ------------------------------------------------------------------------------


def profile_sales(long: DataFrame, n_days: int) -> DataFrame:
    """One row over long sales; a missing day of a series counts as a zero cell."""
    u = F.col("units")
    per_series = long.groupBy("id", "item_id", "store_id").agg(
        F.sum(u).alias("_units"),
        F.count_if(u != 0).alias("_sold"),
        F.count_if(u < 0).alias("_neg"),
        F.count_if(u.isNull()).alias("_missing"),
        F.min("day_index").alias("_lo"),
        F.max("day_index").alias("_hi"),
    )
    n = F.count(F.lit(1))
    return per_series.agg(
        n.alias("series_rows"),
        F.countDistinct("item_id").alias("product_count"),
        F.countDistinct("store_id").alias("store_count"),
        F.sum("_units").alias("total_demand"),
        F.round(1 - ratio(F.sum("_sold"), n * n_days), 6).alias("zero_demand_fraction"),
        F.sum("_neg").alias("negative_value_count"),
        F.sum("_missing").alias("missing_cells"),
        (n - F.countDistinct("id")).alias("duplicate_ids"),
        F.min("_lo").alias("day_start"),
        F.max("_hi").alias("day_end"),
    )


def profile_calendar(calendar: DataFrame) -> DataFrame:
    day = F.regexp_replace("d", "^d_", "").cast("int")
    n = F.count(F.lit(1))
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in calendar.columns]
    return calendar.agg(
        n.alias("rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        (n - F.countDistinct("d")).alias("duplicate_d"),
        (n - F.countDistinct("date")).alias("duplicate_date"),
        (F.date_diff(F.max("date"), F.min("date")) + 1).alias("expected_days"),
        (F.date_diff(F.max("date"), F.min("date")) + 1 == F.countDistinct("date")).alias(
            "date_continuous"
        ),
        F.min(day).alias("day_id_min"),
        F.max(day).alias("day_id_max"),
        ((F.countDistinct("d") == n) & (F.min(day) == 1) & (F.max(day) == n)).alias(
            "day_id_continuous"
        ),
        *nulls,
    )


def profile_prices(prices: DataFrame) -> DataFrame:
    """Rows, duplicates, distinct keys, price range; equal keys are counted first."""
    p = F.col("sell_price")
    keyed = prices.groupBy("item_id", "store_id", "wm_yr_wk", "sell_price").agg(
        F.count(F.lit(1)).alias("_n")
    ).groupBy("item_id", "store_id", "wm_yr_wk").agg(
        F.sum("_n").alias("_rows"),
        F.count(F.lit(1)).alias("_prices"),
        F.min(p).alias("_lo"),
        F.max(p).alias("_hi"),
        F.sum(p * F.col("_n")).alias("_sum"),
        F.sum(F.when(p.isNull(), F.col("_n")).otherwise(0)).alias("_null"),
        F.sum(F.when(p < 0, F.col("_n")).otherwise(0)).alias("_neg"),
        F.sum(F.when(p == 0, F.col("_n")).otherwise(0)).alias("_zero"),
    )
    rows = F.sum("_rows")
    return keyed.agg(
        rows.alias("rows"),
        (rows - F.sum("_prices")).alias("duplicate_rows"),
        (rows - F.count(F.lit(1))).alias("duplicate_keys"),
        F.countDistinct("item_id").alias("item_count"),
        F.countDistinct("store_id").alias("store_count"),
        F.countDistinct("wm_yr_wk").alias("unique_weeks"),
        F.min("wm_yr_wk").alias("week_min"),
        F.max("wm_yr_wk").alias("week_max"),
        F.sum("_null").alias("sell_price_missing"),
        F.min("_lo").alias("sell_price_min"),
        F.max("_hi").alias("sell_price_max"),
        F.round(ratio(F.sum("_sum"), rows - F.sum("_null")), 4).alias("sell_price_mean"),
        F.sum("_neg").alias("sell_price_negative"),
        F.sum("_zero").alias("sell_price_zero"),
    )


def quality_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n_checks"))


def zero_fraction_per_series(daily: DataFrame, n_days: int) -> DataFrame:
    """Share of days without demand; missing days count as such."""
    return daily.groupBy(*SERIES).agg(
        F.round(1 - ratio(F.count_if(F.col("units_sold") != 0), F.lit(n_days)), 6).alias(
            "zero_fraction"
        )
    )


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date_id").agg(F.sum("units_sold").alias("units"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed."""
    c = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    place = F.floor(F.try_divide(c - F.col("_e.lo"), width))
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn("_e", ends)
        .groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reconcile_layers(
    daily: DataFrame,
    weekly: DataFrame,
    monthly: DataFrame,
    stats: DataFrame,
    product_rollup: DataFrame,
    shares: DataFrame,
) -> DataFrame:
    """Units of every layer against the daily fact, and shares against 100."""
    def units(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.agg(F.sum(column).cast("double").alias("value")).select(
            F.lit(name).alias("layer"), "value"
        )

    layers = union_all(
        [
            units("daily", daily, "units_sold"),
            units("weekly", weekly, "units"),
            units("monthly", monthly, "units"),
            units("demand", stats, "total_units"),
            units("hierarchy", product_rollup, "units"),
        ]
    )
    expected = daily.agg(F.sum("units_sold").cast("double")).scalar()
    share = shares.agg(F.round(F.sum("revenue_share_pct"), 1).alias("value")).select(
        F.lit("revenue_shares").alias("layer"), "value", F.lit(100.0).alias("expected")
    )
    return (
        layers.withColumn("expected", expected)
        .unionByName(share)
        .withColumn("agrees", F.abs(F.col("value") - F.col("expected")) <= 0.1)
    )
