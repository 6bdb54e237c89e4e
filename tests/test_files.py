"""Raw files inspected before they are parsed, and growth by calendar periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from demandspark.operators import dims, measures, quality
from demandspark.sources import raw_files

IDS = "id,item_id,dept_id,cat_id,store_id,state_id"


def file(tmp_path, name, header, *lines):
    path = tmp_path / f"{name}.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def judged(spark, path):
    raw = raw_files.read_as_text(spark, path)
    columns = quality.check_file_columns(raw, quality.SALES_COLUMNS, "sales", days=True).first()
    numbers = quality.check_file_numbers(raw, raw_files.day_columns(raw.columns), "sales").first()
    return (columns.status, columns.detail), (numbers.status, numbers.detail)


def test_sales_files_are_judged_by_their_own_header_and_cells(spark, tmp_path):
    rows = [f"a_{i},a,d,c,s,x" for i in range(3)]
    sound = file(tmp_path, "sound", IDS + ",d_10,d_9,d_11", *[r + ",1,,2.5" for r in rows])
    assert judged(spark, sound) == (("pass", "missing= rows=3"), ("pass", "not numeric= rows=3"))
    gap = file(tmp_path, "gap", IDS.replace("cat_id", "cat") + ",d_1,d_2,d_5", *[r + ",1,x,2 2" for r in rows])
    assert judged(spark, gap) == (("fail", "missing=cat_id,d_3,d_4 rows=3"), ("fail", "not numeric=d_2,d_5 rows=3"))
    none = file(tmp_path, "none", IDS + ",d_x,day_1", *[r + ",1,2" for r in rows])
    assert judged(spark, none) == (("fail", "missing=d_* rows=3"), ("pass", "not numeric= rows=3"))
    empty = file(tmp_path, "empty", IDS + ",d_1")
    assert judged(spark, empty) == (("pass", "missing= rows=0"), ("pass", "not numeric= rows=0"))


def test_other_files_need_their_columns(spark, tmp_path):
    prices = raw_files.read_as_text(spark, file(tmp_path, "p", "store_id,item_id,sell_price", "s,i,1"))
    assert quality.check_file_columns(prices, quality.PRICE_COLUMNS, "p").first().detail == "missing=wm_yr_wk rows=1"


def test_growth_is_against_the_period_before_in_the_calendar(spark):
    start = dt.date(2018, 1, 1)  # a Monday
    days = [(i + 1, start + dt.timedelta(days=i), i // 7 + 1, 11801 + i // 7 if i < 364 else 11901 + (i - 364) // 7) for i in range(3 * 364)]
    dates = spark.createDataFrame(days, "date_id int, calendar_date date, week_id int, wm_yr_wk int").withColumns(
        {"year": F.year("calendar_date"), "quarter": F.quarter("calendar_date"), "month": F.month("calendar_date"), "month_name": F.date_format("calendar_date", "MMMM")}
    )
    weeks = {r.wm_yr_wk: r for r in dims.dim_week(dates).collect()}
    # No sales in the second quarter of 2018 and in all of 2019.
    kept = [w for w, r in weeks.items() if r.year != 2019 and (r.year, r.quarter) != (2018, 2)]
    weekly = spark.createDataFrame([(1, 1, w, weeks[w].week_id) for w in kept], "product_surr_id int, store_surr_id int, wm_yr_wk int, week_id int").selectExpr("*", "wm_yr_wk * 1L as units", "cast(week_id as decimal(18,2)) as revenue")
    got = {(r.period, r.period_key): (r.revenue_pct, r.units_pct) for r in measures.growth(weekly, dates).collect()}
    assert got["quarter", 20181] == (None, None) and got["quarter", 20183] == (None, None)
    assert got["quarter", 20184][0] > 0 and got["year", 2020] == (None, None)
    by_id = {r.week_id: w for w, r in weeks.items()}
    for w in kept:
        before = by_id.get(weeks[w].week_id - 1)
        assert (got["week", w][0] is None) == (before not in kept)
