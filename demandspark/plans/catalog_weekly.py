"""Weekly anchor, KPI views, growth, contribution and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandspark.operators import contribution, weekly
from demandspark.plans.catalog import query
from demandspark.plans.retail import RetailTables


@query("C01_weekly_sales")
def c01(t: RetailTables) -> DataFrame:
    return t.weekly


@query("C02_v_weekly")
def c02(t: RetailTables) -> DataFrame:
    return t.wide


@query("C03_v_units", one_pass=True)
def c03(t: RetailTables) -> DataFrame:
    return weekly.v_units(t.daily)


@query("C04_v_revenue")
def c04(t: RetailTables) -> DataFrame:
    return weekly.v_revenue(t.weekly)


@query("C05_v_price_weekly")
def c05(t: RetailTables) -> DataFrame:
    prices = weekly.v_price_weekly(t.sold_weeks)
    return prices.select(
        "wm_yr_wk",
        F.round("avg_sell_price", 4).alias("avg_sell_price"),
        F.round("weighted_price", 4).alias("weighted_price"),
    )


@query("C06_v_growth_wow")
def c06(t: RetailTables) -> DataFrame:
    return weekly.v_growth_wow(t.sold_weeks, t.dates)


@query("C07_v_growth_qoq")
def c07(t: RetailTables) -> DataFrame:
    return weekly.v_growth_qoq(t.sold_weeks, t.dates)


@query("C08_v_growth_yoy")
def c08(t: RetailTables) -> DataFrame:
    return weekly.v_growth_yoy(t.sold_weeks, t.dates)


@query("C09_product_contribution")
def c09(t: RetailTables) -> DataFrame:
    return contribution.product_contribution(t.sold_wide)


@query("C10_department_contribution")
def c10(t: RetailTables) -> DataFrame:
    return contribution.level_contribution(t.sold_wide, contribution.LEVELS["department"])


@query("C11_category_contribution")
def c11(t: RetailTables) -> DataFrame:
    return contribution.level_contribution(t.sold_wide, contribution.LEVELS["category"])


@query("C12_store_contribution")
def c12(t: RetailTables) -> DataFrame:
    return contribution.level_contribution(t.sold_wide, contribution.LEVELS["store"])


@query("C13_state_contribution")
def c13(t: RetailTables) -> DataFrame:
    return contribution.level_contribution(t.sold_wide, contribution.LEVELS["state"])


@query("C13_all_level_contributions")
def c13_all(t: RetailTables) -> DataFrame:
    return contribution.all_level_contributions(t.sold_wide)


@query("C14_rollup_daily", one_pass=True)
def c14(t: RetailTables) -> DataFrame:
    return weekly.rollup_daily(t.daily, t.dates)


@query("C15_rollup_weekly")
def c15(t: RetailTables) -> DataFrame:
    return weekly.rollup_weekly(t.sold_weeks)


@query("C16_rollup_monthly")
def c16(t: RetailTables) -> DataFrame:
    return weekly.rollup_monthly(t.sold_weeks, t.dates)


@query("C17_rollup_product_hierarchy")
def c17(t: RetailTables) -> DataFrame:
    return weekly.rollup_product_hierarchy(t.product, t.sold_weeks)


@query("C18_rollup_store_hierarchy")
def c18(t: RetailTables) -> DataFrame:
    return weekly.rollup_store_hierarchy(t.store, t.sold_weeks)


@query("C19_headline_kpis")
def c19(t: RetailTables) -> DataFrame:
    return weekly.headline_kpis(t.sold_weeks, t.dates)


@query("C20_revenue_trend_12w")
def c20(t: RetailTables) -> DataFrame:
    return weekly.revenue_trend(t.sold_weeks)


@query("C21_contributions_topn")
def c21(t: RetailTables) -> DataFrame:
    return contribution.contributions_topn(
        t.sold_weeks, t.product, t.store, {"category": "C1", "region": "West"}, 10
    )


@query("C23_m_totals_and_price")
def c23(t: RetailTables) -> DataFrame:
    from demandspark.operators import measures

    return measures.totals(t.sold_wide, ["category_surr_id", "region_id"])


@query("C24_m_growth")
def c24(t: RetailTables) -> DataFrame:
    from demandspark.operators import measures

    return measures.growth(t.sold_weeks, t.dates)


@query("C25_m_shares")
def c25(t: RetailTables) -> DataFrame:
    return contribution.cumulative_share_range(t.sold_wide)


@query("C25_m_entity_share")
def c25_entity(t: RetailTables) -> DataFrame:
    from demandspark.operators import measures

    return measures.entity_share(t.sold_wide, ["state_id"], ["product_surr_id", "state_id"])
