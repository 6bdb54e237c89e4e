"""Raw files to star schema on a small generated data set, and writes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandspark.operators import contribution, dims, facts, quality, weekly
from demandspark.operators.sliced import SlicedTable
from demandspark.session import new_stage_path
from demandspark.sources import raw_files

N_DAYS = 70
FIRST = dt.date(2011, 11, 26)  # a Saturday; the weeks run over months and the year end
ITEMS = {"F1": ("FOODS_1", "FOODS"), "F2": ("FOODS_2", "FOODS"), "H1": ("HOBBIES_1", "HOBBIES"), "H2": ("HOBBIES_1", "HOBBIES")}
STORES = {"CA_1": "CA", "TX_1": "TX"}


def units(item, store, d):
    if item == "H2":
        return 0
    if item == "F2":
        return 5
    if item == "H1":
        return 0 if d <= 42 else d - 42
    return (d * (3 if store == "CA_1" else 7)) % 11


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    head = "date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI"
    lines = [head]
    for d in range(1, N_DAYS + 1):
        day = FIRST + dt.timedelta(days=d - 1)
        event = "Christmas,National,Feast,Cultural" if (day.month, day.day) == (12, 25) else ",,,"
        lines.append(
            f"{day},{11100 + (d - 1) // 7},{day:%A},{(d - 1) % 7 + 1},{day.month},{day.year},d_{d},{event},{d % 2},0,1"
        )
    (root / "calendar.csv").write_text("\n".join(lines))
    wide = [",".join(raw_files.SALES_IDS + [f"d_{d}" for d in range(1, N_DAYS + 1)])]
    prices = ["store_id,item_id,wm_yr_wk,sell_price"]
    for item, (dept, cat) in ITEMS.items():
        for store, state in STORES.items():
            values = ",".join(str(units(item, store, d)) for d in range(1, N_DAYS + 1))
            wide.append(f"{item}_{store},{item},{dept},{cat},{store},{state},{values}")
            prices += [
                f"{store},{item},{11100 + w},{2 + w / 4:.2f}"
                for w in range(N_DAYS // 7)
                if not (item == "F2" and w == 3)
            ]
    (root / "sales.csv").write_text("\n".join(wide))
    (root / "prices.csv").write_text("\n".join(prices))
    return root


@pytest.fixture(scope="module")
def star(spark, files):
    calendar = raw_files.read_calendar(spark, str(files / "calendar.csv"))
    prices = raw_files.read_sell_prices(spark, str(files / "prices.csv"))
    wide = raw_files.read_sales_wide(spark, str(files / "sales.csv"), N_DAYS)
    meta = raw_files.read_sales_meta(spark, str(files / "sales.csv"), N_DAYS)
    key = dims.assign_surrogate_keys
    category = key(dims.dim_category(meta), "category_id", "category_surr_id")
    department = key(dims.dim_department(meta, category), "dept_id", "dept_surr_id")
    store = key(dims.dim_store(meta), "store_id", "store_surr_id")
    product = key(dims.dim_product(meta, department, category), "product_id", "product_surr_id")
    dates = dims.dim_date(calendar, N_DAYS)
    long = raw_files.melt_sales_long(wide)
    daily = facts.load_daily_sales(long, product, store)
    price = facts.load_weekly_price(prices, product, store, dates)
    anchor = weekly.weekly_sales(daily, dates, price)
    return dict(
        calendar=calendar, prices=prices, meta=meta, category=category, department=department,
        store=store, product=product, dates=dates, long=long, daily=daily, price=price, weekly=anchor,
    )


def total():
    return sum(units(i, s, d) for i in ITEMS for s in STORES for d in range(1, N_DAYS + 1))


def test_melt_and_load(star):
    assert star["long"].count() == 8 * N_DAYS
    row = star["long"].filter("item_id = 'F1' and store_id = 'TX_1' and day_index = 9").first()
    assert row["units"] == units("F1", "TX_1", 9)
    assert star["daily"].agg(F.sum("units_sold")).first()[0] == total()
    assert star["price"].count() == 8 * 10 - 2


def test_dimensions(star):
    regions = {r["state_id"]: r["region_id"] for r in star["store"].collect()}
    assert regions == {"CA": "West", "TX": "Central"}
    assert [r["product_id"] for r in star["product"].orderBy("product_surr_id").collect()] == ["F1", "F2", "H1", "H2"]
    events = star["calendar"].transform(dims.dim_event).orderBy("event_ordinal").collect()
    assert [(e["event_name"], e["event_ordinal"]) for e in events] == [("Christmas", 1), ("Feast", 2)]
    day = star["dates"].filter("date_id = 30").first()
    assert (day["month_name"], day["quarter"], day["is_weekend"], day["is_event_day"]) == ("December", 4, True, True)  # a Sunday
    # A week over the year end carries the attributes of its first day, together.
    week = dims.dim_week(star["dates"]).filter("wm_yr_wk = 11105").first()
    assert (week["year"], week["quarter"], week["month"], week["month_name"]) == (2011, 4, 12, "December")


def test_weekly_anchor(star):
    anchor = star["weekly"]
    assert anchor.count() == 8 * 10
    unpriced = anchor.filter("sell_price is null").collect()
    assert len(unpriced) == 2 and all(r["units"] == 35 and r["revenue"] is None for r in unpriced)
    r = anchor.filter("wm_yr_wk = 11102 and product_surr_id = 2").first()
    assert (r["units"], float(r["sell_price"]), float(r["revenue"])) == (35, 2.5, 87.5)
    assert anchor.agg(F.sum("units")).first()[0] == total()


def test_growth_counts_each_week_once(star):
    wow = weekly.v_growth_wow(star["weekly"], star["dates"]).orderBy("week_id").collect()
    assert len(wow) == 10 and sum(r["units"] for r in wow) == total() and wow[0]["wow_units_pct"] is None
    for growth in (weekly.v_growth_qoq, weekly.v_growth_yoy):
        assert growth(star["weekly"], star["dates"]).agg(F.sum("units")).first()[0] == total()
    assert weekly.rollup_monthly(star["weekly"], star["dates"]).agg(F.sum("units")).first()[0] == total()


def test_contribution(star):
    wide = weekly.v_weekly(star["weekly"], star["product"], star["store"], star["dates"])
    rows = contribution.product_contribution(wide).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
    cumulative = [r["cumulative_share_pct"] for r in rows]
    assert cumulative == sorted(cumulative) and cumulative[-1] == pytest.approx(100)
    levels = contribution.all_level_contributions(wide).groupBy("level").agg(F.sum("revenue_share_pct").alias("s"))
    assert {r["level"] for r in levels.collect()} == set(contribution.LEVELS)
    assert all(r["s"] == pytest.approx(100, abs=0.01) for r in levels.collect())
    top = contribution.contributions_topn(
        star["weekly"], star["product"], star["store"], {"department": "FOODS_1"}, 500
    ).collect()
    assert {r["entity"] for r in top} == {"F1", "FOODS_1", "CA", "TX"}


def test_quality_statuses(spark, star):
    def status(df):
        return [r["status"] for r in df.collect()]

    assert status(quality.check_date_continuity(star["calendar"])) == ["pass", "pass"]
    assert status(quality.check_date_continuity(star["calendar"].filter("d <> 'd_9'"))) == ["fail", "pass"]
    assert status(quality.check_schema(star["meta"], quality.SALES_COLUMNS, "x")) == ["pass"]
    assert status(quality.check_schema(star["meta"].drop("cat_id"), quality.SALES_COLUMNS, "x")) == ["fail"]
    assert status(quality.check_numeric_types(star["long"], ["units", "id"], "x")) == ["fail"]
    assert status(quality.check_duplicates(star["long"].union(star["long"].limit(3)), ["id", "day_index"], "x")) == ["fail"]
    price = lambda *p: spark.createDataFrame([(float(x),) for x in p], "sell_price double")
    assert status(quality.check_price_range(price(1, 2))) == ["pass"]
    assert status(quality.check_price_range(price(1, 0, 200))) == ["warn"]
    assert status(quality.check_price_range(price(-1, 0, 200))) == ["fail"]  # the worst one counts
    assert status(quality.check_hierarchy(star["meta"], 4, 2)) == ["pass", "pass"]
    mixed = star["meta"].withColumn("cat_id", F.col("store_id"))
    assert status(quality.check_hierarchy(mixed, 5, 2)) == ["fail", "warn"]
    odd = dims.dim_store(star["meta"].withColumn("state_id", F.lit("NY")))
    checks = quality.check_value_domains(star["daily"], star["price"], odd, star["category"], star["dates"])
    assert {r["check"] for r in checks.filter("status = 'fail'").collect()} == {"region_known"}


def test_insert_upsert_and_slices(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(facts.insert_if_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(facts.upsert_by_key(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    table = SlicedTable(spark, new_stage_path(spark, "t"), ["w"])
    table.replace(spark.createDataFrame([(1, 10), (2, 20)], "w int, n int"))
    for _ in range(2):  # a re-run changes nothing
        table.replace(spark.createDataFrame([(2, 21)], "w int, n int"))
    assert sorted((r["w"], r["n"]) for r in table.read().collect()) == [(1, 10), (2, 21)]


def test_written_layers_agree_with_lazy_ones(spark, tmp_path):
    from demandspark.plans.layers import write_layers
    from demandspark.plans.retail import RetailTables

    t = RetailTables(spark, "/root/testdata/sf0.001")
    paths = write_layers(t, str(tmp_path))
    read = {name: spark.read.parquet(p) for name, p in paths.items()}
    columns = ["product_surr_id", "store_surr_id", "risk_type", "risk_rank"]
    assert sorted(map(tuple, read["fact_risk"].select(columns).collect())) == sorted(
        map(tuple, t.ranked.select(columns).collect())
    )
    assert read["fact_daily_sales"].filter("data_provenance = 'observed'").count() == t.daily.count()
    assert read["fact_inventory_projection"].count() == read["fact_forecast"].count()


def test_slices_named_for_replacement_are_cleared(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path / "t"), ["w"])
    table.replace(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "w int, n int"))
    table.replace(spark.createDataFrame([(2, 21)], "w int, n int"), [(1,), (2,)])
    assert sorted(map(tuple, table.read().select("w", "n").collect())) == [(2, 21), (3, 30)]
    with pytest.raises(ValueError):
        table.replace(spark.createDataFrame([(3, 1)], "w int, n int"), [(2,)])


def test_repeated_incoming_keys_give_one_row(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (1, "y"), (2, "q"), (2, "p")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(facts.upsert_by_key(old, new, ["k"])) == [(1, "y"), (2, "p")]
    assert rows(facts.insert_if_absent(old, new, ["k"])) == [(1, "a"), (2, "p")]


def test_later_days_move_the_clock(spark, tmp_path):
    """30 added days are in the daily rows, the weekly revenue, the statistics and the forecast."""
    import datetime
    import shutil

    from demandspark.plans.retail import RetailTables

    source = "/root/testdata/sf0.001"
    for name in ("part", "supplier", "nation", "region"):
        shutil.copy(f"{source}/{name}.parquet", tmp_path)
    line = spark.read.parquet(f"{source}/lineitem.parquet")
    last = line.agg(F.max("l_shipdate")).first()[0]
    later = line.filter(F.col("l_shipdate") > last - datetime.timedelta(days=30)).withColumn(
        "l_shipdate", F.col("l_shipdate") + F.expr("interval 30 days")
    )
    line.unionByName(later).write.parquet(str(tmp_path / "lineitem.parquet"))
    before, after = RetailTables(spark, source), RetailTables(spark, str(tmp_path))
    assert after.clock.observed_end == before.clock.observed_end + 30
    added = after.daily.agg(F.sum("units_sold")).first()[0] - before.daily.agg(F.sum("units_sold")).first()[0]
    assert added == later.agg(F.sum("l_quantity")).first()[0]
    total = lambda t: t.stats.agg(F.sum("total_units")).first()[0]
    assert total(after) - total(before) == added
    weeks = after.weekly_units.agg(F.max("week_id"), F.sum("units")).first()
    assert weeks[0] == (after.clock.observed_end - 1) // 7 + 1 and weeks[1] == total(after)
    assert after.final.agg(F.min("forecast_date")).first()[0] == after.clock.observed_end + 1
