"""Registered queries against DuckDB; all of them with ORACLE_ALL=1."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "A11_dim_date", "A17_replace_slice", "B03_check_duplicates", "B18_histograms", "C04_v_revenue",
    "C09_product_contribution", "C19_headline_kpis", "C25_m_shares", "D08_monthly_seasonality",
    "D09_dow_factors", "D14_demand_analysis", "E11_holdout_metrics", "E19_final_forecast",
    "F09_inventory_projection", "G02_scenario_param_rules", "G08_scenario_result",
    "G13_risk_score_rank", "G15_action_tradeoff",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_equals_duckdb(spark, con, name):
    note = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert note is None or note.startswith("equal")


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
