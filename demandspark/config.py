"""Business rules: clocks, thresholds, weights and the rule tables made from them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

OBSERVED = "observed"
DERIVED = "derived"
SIMULATED = "simulated"
PROVENANCES = (OBSERVED, DERIVED, SIMULATED)

SERIES = ["product_surr_id", "store_surr_id"]
#: Days forecast and projected.
HORIZON = 28


@dataclass(frozen=True)
class Clock:
    """Day-index windows: observed history, holdout and forecast horizon.

    Day 1 is `origin`, a Monday. The end of history comes from the data, see
    `OrderTables.clock`.
    """

    observed_end: int
    origin: date = date(1970, 1, 5)
    observed_start: int = 1
    horizon: int = HORIZON
    trailing_days: int = 14

    @property
    def train_end(self) -> int:
        return self.observed_end - self.horizon

    @property
    def holdout_start(self) -> int:
        return self.train_end + 1

    @property
    def holdout_end(self) -> int:
        return self.observed_end

    @property
    def forecast_start(self) -> int:
        return self.observed_end + 1

    @property
    def forecast_end(self) -> int:
        return self.observed_end + self.horizon

    @property
    def trailing_start(self) -> int:
        return self.train_end - self.trailing_days + 1


# Thresholds the results depend on.
@dataclass(frozen=True)
class DemandRules:
    volume_quantile_low: float = 1.0 / 3.0
    volume_quantile_high: float = 2.0 / 3.0
    cv_low: float = 0.50
    cv_high: float = 1.00
    zero_ratio_erratic: float = 0.50
    zero_ratio_lumpy: float = 0.75
    zero_ratio_intermittent: float = 0.90
    trend_up_pct: float = 10.0
    trend_down_pct: float = -10.0
    trend_min_mean: float = 1e-6
    trend_min_span: int = 30
    growth_epsilon: float = 1e-9
    season_min_active_months: int = 10
    season_min_std: float = 1e-6
    risk_critical: int = 7
    risk_high: int = 4
    risk_moderate: int = 2


@dataclass(frozen=True)
class ForecastRules:
    seasonality: int = 7
    ma_window: int = 7
    min_train_points: int = 28
    pilot_top_n: int = 64
    selection_improvement: float = 0.01
    pi_z: float = 1.96


@dataclass(frozen=True)
class PolicyRules:
    assumption_set_id: int = 1
    name: str = "baseline_service_95_pct"
    starting_inventory_rule: str = "coverage_days"
    starting_coverage_days: float = 7.0
    lead_time_days: float = 7.0
    service_level: float = 0.95
    safety_stock_formula: str = "z_x_sigma_lead_time_demand"
    reorder_policy: str = "(s,Q)"
    reorder_quantity_rule: str = "capped_coverage_days"
    reorder_qty_multiple: float = 7.0
    max_order_qty_coverage_days: float = 28.0
    excess_coverage_days: float = 28.0
    demand_adjustment: float = 1.0


STOCKOUT_WEIGHTS = {
    "volume": 0.15,
    "volatility": 0.15,
    "stockout_prob": 0.30,
    "service_gap": 0.20,
    "urgency": 0.20,
}
EXCESS_WEIGHTS = {
    "excess_days_ratio": 0.40,
    "positioning_gap": 0.35,
    "excess_unit_efficiency": 0.25,
}
RISK_TIERS = ((0.70, "Critical"), (0.45, "High"), (0.25, "Medium"), (0.00, "Low"))
AT_RISK_TIERS = ("High", "Critical")
RANKING_TYPES = {
    "stockout": "stockout_risk_prioritization",
    "excess": "excess_inventory_prioritization",
}

BASELINE_MODELS = ("naive", "seasonal_naive", "moving_average", "weighted_ma")
STATISTICAL_MODELS = ("ets_holt_winters", "sarima")
MODEL_ORDER = BASELINE_MODELS + STATISTICAL_MODELS


@dataclass(frozen=True)
class Scenario:
    """One named what-if: a NULL parameter means the baseline value."""

    name: str
    scenario_type: str
    demand_adjustment_pct: float | None = None
    lead_time_delta_days: float | None = None
    service_level_target: float | None = None
    reorder_qty_multiple: float | None = None
    max_order_qty_coverage_days: float | None = None


SCENARIOS = (
    Scenario("baseline", "baseline"),
    Scenario("demand_shock_p20", "demand_shock", demand_adjustment_pct=0.20),
    Scenario("lead_time_plus_2d", "lead_time_change", lead_time_delta_days=2.0),
    Scenario("service_level_99", "service_level_change", service_level_target=0.99),
    Scenario(
        "reorder_policy_alt",
        "reorder_policy",
        reorder_qty_multiple=14.0,
        max_order_qty_coverage_days=28.0,
    ),
    Scenario("stockout_risk_rank", "stockout_risk_prioritization"),
    Scenario("excess_risk_rank", "excess_inventory_prioritization"),
)


def demand_rule_rows(rules: DemandRules = DemandRules()) -> list[tuple]:
    """(rule_key, rule_value, description), one row per demand threshold."""
    text = {
        "volume_quantile_low": "volume cut between low and medium",
        "volume_quantile_high": "volume cut between medium and high",
        "cv_low": "volatility is low below this variation",
        "cv_high": "volatility is high from this variation on",
        "zero_ratio_erratic": "share of zero days from which demand is erratic",
        "zero_ratio_lumpy": "share of zero days from which demand is lumpy",
        "zero_ratio_intermittent": "share of zero days from which demand is intermittent",
        "trend_up_pct": "slope effect from which a trend is increasing",
        "trend_down_pct": "slope effect up to which a trend is decreasing",
        "trend_min_mean": "smallest mean for which a slope effect is defined",
        "trend_min_span": "smallest span in days for which a slope effect is defined",
        "growth_epsilon": "prior mean up to which growth is undefined",
        "season_min_active_months": "months with demand needed for seasonality",
        "risk_critical": "risk index from which a series is critical",
        "risk_high": "risk index from which a series is high",
        "risk_moderate": "risk index from which a series is moderate",
    }
    return [(k, float(getattr(rules, k)), d) for k, d in text.items()]


def forecast_rule_rows(
    clock: Clock, rules: ForecastRules = ForecastRules()
) -> list[tuple]:
    return [
        ("final_horizon", float(clock.horizon), "forecast days"),
        ("observed_end", float(clock.observed_end), "last observed day"),
        ("train_end", float(clock.train_end), "last training day of the holdout split"),
        ("validation_start", float(clock.holdout_start), "first holdout day"),
        ("validation_end", float(clock.holdout_end), "last holdout day"),
        ("seasonality", float(rules.seasonality), "days in a season"),
        ("ma_window", float(rules.ma_window), "days in a moving average"),
        ("min_train_points", float(rules.min_train_points), "history needed for a fit"),
        ("pilot_top_n", float(rules.pilot_top_n), "series with statistical fits"),
        ("selection_improvement", rules.selection_improvement, "gain a statistical model needs"),
        ("pi_z", rules.pi_z, "interval multiplier"),
    ]


def scenario_rule_rows(
    clock: Clock, policy: PolicyRules = PolicyRules()
) -> list[tuple]:
    rows = [
        ("horizon_start_day", clock.forecast_start, "first projected day"),
        ("horizon_end_day", clock.forecast_end, "last projected day"),
        ("horizon_days", clock.horizon, "projected days"),
        ("base_assumption_set_id", policy.assumption_set_id, "baseline assumption set"),
        ("base_lead_time_days", policy.lead_time_days, "baseline lead time"),
        ("base_service_level", policy.service_level, "baseline service level"),
        ("base_reorder_qty_multiple", policy.reorder_qty_multiple, "baseline order size in days"),
        (
            "base_max_order_qty_coverage_days",
            policy.max_order_qty_coverage_days,
            "baseline cap on order size in days",
        ),
        ("demand_shock_planned", 0, "a shock does not resize the policy"),
        ("demand_shock_pct_min", -0.999, "lowest demand change, exclusive"),
        ("demand_shock_pct_max", 10.0, "highest demand change"),
        ("lead_time_min_days", 1.0, "shortest lead time"),
        ("stockout_w_volume", STOCKOUT_WEIGHTS["volume"], "stockout weight of volume"),
        ("stockout_w_volatility", STOCKOUT_WEIGHTS["volatility"], "stockout weight of variation"),
        ("stockout_w_prob", STOCKOUT_WEIGHTS["stockout_prob"], "stockout weight of probability"),
        ("stockout_w_service_gap", STOCKOUT_WEIGHTS["service_gap"], "stockout weight of the gap"),
        ("stockout_w_urgency", STOCKOUT_WEIGHTS["urgency"], "stockout weight of urgency"),
        ("excess_w_days", EXCESS_WEIGHTS["excess_days_ratio"], "excess weight of days"),
        ("excess_w_positioning", EXCESS_WEIGHTS["positioning_gap"], "excess weight of the gap"),
        (
            "excess_w_efficiency",
            EXCESS_WEIGHTS["excess_unit_efficiency"],
            "excess weight of units per demand",
        ),
        ("excess_coverage_days", policy.excess_coverage_days, "days of cover above which stock is excess"),
    ]
    return [(k, float(v), d) for k, v, d in rows]


def rules_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        rows, "rule_key string, rule_value double, description string"
    )


def assumption_set_row(spark: SparkSession, policy: PolicyRules = PolicyRules()) -> DataFrame:
    return spark.createDataFrame(
        [
            (
                policy.assumption_set_id,
                policy.name,
                policy.starting_inventory_rule,
                policy.lead_time_days,
                policy.service_level,
                policy.safety_stock_formula,
                policy.reorder_policy,
                policy.reorder_quantity_rule,
                policy.demand_adjustment,
                True,
                SIMULATED,
            )
        ],
        "assumption_set_id int, name string, starting_inventory_rule string,"
        " supplier_lead_time_days double, service_level double, safety_stock_formula string,"
        " reorder_policy string, reorder_quantity_rule string, demand_adjustment double,"
        " is_active boolean, data_provenance string",
    )


def scenario_definitions(
    spark: SparkSession, scenarios: tuple[Scenario, ...] = SCENARIOS
) -> DataFrame:
    return spark.createDataFrame(
        [
            (
                i,
                s.name,
                s.scenario_type,
                s.demand_adjustment_pct,
                s.lead_time_delta_days,
                s.service_level_target,
                s.reorder_qty_multiple,
                s.max_order_qty_coverage_days,
            )
            for i, s in enumerate(scenarios, start=1)
        ],
        "scenario_id int, scenario_name string, scenario_type string,"
        " demand_adjustment_pct double, lead_time_delta_days double,"
        " service_level_target double, reorder_qty_multiple double,"
        " max_order_qty_coverage_days double",
    )
