"""Wires the operators over one source into named, lazy tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandspark.config import SCENARIOS, SERIES, Clock
from demandspark.operators import (
    demand,
    dims,
    facts,
    forecast,
    forecast_fit,
    replenish,
    risk,
    scenario,
    weekly,
)
from demandspark.session import spread, stage
from demandspark.sources.order_tables import OrderTables, product_key


class RetailTables:
    """Dimensions and facts of one data folder, each made when first asked for.

    Most properties are plans and run nothing. Asking for one that several later
    steps read (daily totals, scenario results, risk ranks, fits) writes it to
    the shared folder at once; see `session.stage`.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        clock: Clock | None = None,
        staged: bool = True,
        fits: bool = False,
    ):
        """`fits` lets statistical models take part in the choice that stock and scenarios use."""
        self.fits = fits
        self.spark = spark
        self.source = OrderTables(spark, path, clock, staged)

    @property
    def clock(self) -> Clock:
        return self.source.clock

    @cached_property
    def with_fits(self) -> RetailTables:
        """The same source with the full rule: statistical winners among the chosen models."""
        if self.fits:
            return self
        other = RetailTables(self.spark, self.source.path, self.source.clock, fits=True)
        other.source = self.source
        return other

    @property
    def weeks(self) -> tuple[int, int]:
        return 1, (self.clock.observed_end - 1) // 7 + 1

    # -- dimensions ----------------------------------------------------------------
    @cached_property
    def product(self) -> DataFrame:
        """Products keyed by their brand number, so facts need no key lookup."""
        dept_no = F.substring("dept_id", 2, 5).cast("int")
        cat_no = F.substring("cat_id", 2, 5).cast("int")
        return self.source.products().select(
            product_key(F.col("item_id")).alias("product_surr_id"),
            F.col("item_id").alias("product_id"),
            "item_id",
            "dept_id",
            (dept_no + 1).alias("dept_surr_id"),
            F.col("cat_id").alias("category_id"),
            (cat_no + 1).alias("category_surr_id"),
        )

    @cached_property
    def store(self) -> DataFrame:
        return self.source.stores().select(
            "store_surr_id",
            "store_id",
            "state_id",
            dims.region_of(F.col("state_id")).alias("region_id"),
        )

    @cached_property
    def department(self) -> DataFrame:
        return self.product.select(
            "dept_surr_id",
            "dept_id",
            F.col("dept_id").alias("dept_name"),
            "category_id",
            "category_surr_id",
        ).distinct()

    @cached_property
    def category(self) -> DataFrame:
        return self.product.select(
            "category_surr_id", "category_id", F.col("category_id").alias("category_name")
        ).distinct()

    @cached_property
    def dates(self) -> DataFrame:
        return dims.dim_date(self.source.calendar(), self.clock.observed_end)

    # -- facts -----------------------------------------------------------------------
    @cached_property
    def daily(self) -> DataFrame:
        """Days with sales; a missing day is a day without demand."""
        return self.source.daily_sales()

    @cached_property
    def daily_dense(self) -> DataFrame:
        return facts.densify_daily(
            self.daily, self.clock.observed_start, self.clock.observed_end
        )

    @cached_property
    def price(self) -> DataFrame:
        return self.source.weekly_price()

    @cached_property
    def weekly(self) -> DataFrame:
        return weekly.weekly_sales(self.daily, self.dates, self.price, self.weeks)

    @cached_property
    def weekly_units(self) -> DataFrame:
        return weekly.weekly_units(self.daily, self.dates, self.weeks)

    @cached_property
    def sold_weeks(self) -> DataFrame:
        """The anchor without the weeks that sold nothing; all its sums are equal."""
        return weekly.weekly_sales(self.daily, self.dates, self.price)

    @cached_property
    def wide(self) -> DataFrame:
        return weekly.v_weekly(self.weekly, self.product, self.store, self.dates)

    @cached_property
    def sold_wide(self) -> DataFrame:
        return weekly.v_weekly(self.sold_weeks, self.product, self.store, self.dates)

    # -- demand -----------------------------------------------------------------------
    @cached_property
    def stats(self) -> DataFrame:
        return demand.demand_stats(
            self.daily, self.clock.observed_start, self.clock.observed_end
        )

    @cached_property
    def growth(self) -> DataFrame:
        return demand.weekly_growth(self.weekly_units)

    @cached_property
    def monthly(self) -> DataFrame:
        return demand.monthly_means(self.weekly_units, self.dates)

    @cached_property
    def seasonal(self) -> DataFrame:
        return demand.monthly_seasonality(self.monthly)

    @cached_property
    def analysis(self) -> DataFrame:
        return demand.demand_analysis(self.stats, self.growth, self.seasonal)

    @cached_property
    def dow_fine(self) -> DataFrame:
        return demand.dow_fine(
            self.daily,
            self.dates,
            self.product,
            self.store,
            self.clock.observed_start,
            self.clock.observed_end,
        )

    @cached_property
    def dow(self) -> DataFrame:
        return demand.dow_factors(self.dow_fine)

    # -- forecast ------------------------------------------------------------------------
    @cached_property
    def windows(self) -> DataFrame:
        return forecast.trailing_window_arrays(self.daily, forecast.forecast_windows(self.clock))

    @cached_property
    def scored(self) -> DataFrame:
        return forecast.evaluate(self.windows)

    @cached_property
    def selected(self) -> DataFrame:
        return forecast.select_for_series(self.scored)

    @cached_property
    def chosen(self) -> DataFrame:
        if self.fits:
            return self.chosen_all
        return forecast.chosen_baseline(self.windows, self.clock)

    @cached_property
    def chosen_all(self) -> DataFrame:
        """The full rule: statistical winners among the chosen models."""
        return forecast.chosen_forecast(
            self.windows, self.scored_all, self.selected_all, self.clock, self.statistical_final
        )

    @cached_property
    def final(self) -> DataFrame:
        return forecast.final_forecast(self.chosen, self.clock)

    @cached_property
    def pilot(self) -> DataFrame:
        return forecast.pilot_topn(self.stats)

    @cached_property
    def pilot_history(self) -> DataFrame:
        return forecast_fit.series_history(self.daily, self.clock, self.pilot)

    @cached_property
    def histories(self) -> DataFrame:
        """The whole history of each series in one row."""
        clock = self.clock
        return forecast_fit.history_arrays(self.daily, clock.observed_start, clock.observed_end)

    @cached_property
    def _fits(self) -> DataFrame:
        return stage(forecast_fit.fit_both(self.daily, self.clock))

    @cached_property
    def statistical_holdout(self) -> DataFrame:
        """Fits on the training days, to be scored on the holdout."""
        return forecast_fit.of_span(self._fits, "holdout")

    @cached_property
    def statistical_final(self) -> DataFrame:
        return forecast_fit.of_span(self._fits, "final")

    @cached_property
    def scored_all(self) -> DataFrame:
        return forecast.evaluate(self.windows, self.statistical_holdout)

    @cached_property
    def selected_all(self) -> DataFrame:
        return forecast.select_for_series(self.scored_all)

    # -- policy, projection and scenarios ----------------------------------------------------
    @cached_property
    def moments(self) -> DataFrame:
        return self.stats.select(
            *SERIES, "total_units", "mean_daily_units", "std_daily_units"
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return forecast.chosen_vectors(self.chosen)

    @cached_property
    def policy(self) -> DataFrame:
        return replenish.inventory_policy(self.moments)

    @cached_property
    def traced(self) -> DataFrame:
        return replenish.with_trace(spread(self.policy.join(self.vectors, SERIES), SERIES))

    @cached_property
    def projection(self) -> DataFrame:
        return replenish.inventory_projection(self.traced, clock=self.clock)

    @cached_property
    def results(self) -> DataFrame:
        """Outcome of all scenarios, written once for the ranks and reports."""
        return stage(scenario.scenario_result(self.moments, self.vectors))

    def scenario(self, name: str) -> DataFrame:
        """Outcome of one scenario; the others are not projected."""
        rows = scenario.scenario_result(
            self.moments, self.vectors, tuple(s for s in SCENARIOS if s.name == name)
        )
        place = [s.name for s in SCENARIOS].index(name) + 1
        return rows.withColumn("scenario_id", F.lit(place))

    @cached_property
    def baseline(self) -> DataFrame:
        """The baseline, written once for the ranks and reports."""
        return stage(self.scenario("baseline"))

    @cached_property
    def deltas(self) -> DataFrame:
        return scenario.scenario_deltas(self.results)

    @cached_property
    def ranked(self) -> DataFrame:
        return risk.risk_fact(self.baseline)
