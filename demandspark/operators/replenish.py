"""Replenishment policy and day-by-day stock projection of every series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.config import SERIES, SIMULATED, Clock, PolicyRules
from demandspark.functions.exprs import exact_mean, mean_of_scaled, ratio, scaled, unscaled, z_service
from demandspark.functions.ordering import top_n

RULES = PolicyRules()


# -- policy -----------------------------------------------------------------------------


def expected_daily_demand(
    daily: DataFrame, n_days: int | None = None, estimator: str = "mean"
) -> DataFrame:
    """Mean or median daily units; `n_days` counts missing days as zero demand."""
    units = F.col("units_sold").cast("double")
    if estimator == "median":
        if n_days is None:
            return daily.groupBy(*SERIES).agg(F.median(units).alias("expected_daily_demand"))
        # The missing days are zeros at the low end of the sorted values, so
        # the middle positions move down by their number. One series has at
        # most one value per calendar day.
        values = F.array_sort(F.collect_list(units))
        zeros = F.lit(n_days) - F.size("_values")
        at = lambda i: F.when(i < zeros, F.lit(0.0)).otherwise(
            F.try_element_at("_values", (i - zeros + 1).cast("int"))
        )
        low, high = F.lit((n_days - 1) // 2), F.lit(n_days // 2)
        return (
            daily.groupBy(*SERIES)
            .agg(values.alias("_values"))
            .select(*SERIES, ((at(low) + at(high)) / 2).alias("expected_daily_demand"))
        )
    total = F.sum(units)
    n = F.count(F.lit(1)) if n_days is None else F.lit(n_days)
    return daily.groupBy(*SERIES).agg(
        F.coalesce(ratio(total, n), F.lit(0.0)).alias("expected_daily_demand")
    )


def daily_sigma(sigma: Column) -> Column:
    """A deviation that is missing or not finite counts as none."""
    return F.when(sigma.isNotNull() & ~F.isnan(sigma) & (sigma < float("inf")), sigma).otherwise(0.0)


def safety_stock(sigma: Column, level: Column, lead_time: Column) -> Column:
    return F.round(z_service(level) * (sigma * F.sqrt(lead_time)), 6)


def reorder_point(mean: Column, lead_time: Column, safety: Column) -> Column:
    return F.round(mean * lead_time + safety, 6)


def reorder_quantity(mean: Column, multiple: Column, cap: Column) -> Column:
    order = F.greatest(F.least(multiple * mean, cap * mean), F.lit(0.0))
    return F.when(mean > 0, F.round(order, 6)).otherwise(0.0)


def inventory_policy(
    moments: DataFrame,
    rules: PolicyRules = RULES,
    *,
    lead_time: Column | None = None,
    service_level: Column | None = None,
    multiple: Column | None = None,
    cap: Column | None = None,
    starting_cover: Column | None = None,
    excess_cover: Column | None = None,
) -> DataFrame:
    """Size the (s,Q) policy of each row from its demand mean and deviation.

    The keyword columns replace a baseline value per row, which is how one
    job sizes all scenarios.
    """
    lead_time = F.lit(rules.lead_time_days) if lead_time is None else lead_time
    level = F.lit(rules.service_level) if service_level is None else service_level
    multiple = F.lit(rules.reorder_qty_multiple) if multiple is None else multiple
    cap = F.lit(rules.max_order_qty_coverage_days) if cap is None else cap
    start = F.lit(rules.starting_coverage_days) if starting_cover is None else starting_cover
    excess = F.lit(rules.excess_coverage_days) if excess_cover is None else excess_cover
    mean = F.coalesce(F.col("mean_daily_units").cast("double"), F.lit(0.0))
    sigma = F.coalesce(F.col("std_daily_units").cast("double"), F.lit(0.0))
    return (
        moments.withColumns({"_mean": mean, "_sigma": daily_sigma(sigma)})
        .withColumns({"lead_time_days": lead_time, "service_level_target": level})
        .withColumn(
            "safety_stock",
            safety_stock(F.col("_sigma"), F.col("service_level_target"), F.col("lead_time_days")),
        )
        .withColumns(
            {
                "expected_daily_demand": F.round("_mean", 6),
                "daily_sigma": F.col("_sigma"),
                "lead_time_demand": F.col("_mean") * F.col("lead_time_days"),
                "reorder_point": reorder_point(
                    F.col("_mean"), F.col("lead_time_days"), F.col("safety_stock")
                ),
                "reorder_qty": reorder_quantity(F.col("_mean"), multiple, cap),
                "starting_inventory": F.round(start * F.col("_mean"), 6),
                "excess_coverage_days": excess,
            }
        )
        .drop("_mean", "_sigma")
    )


def policy_validation(policy: DataFrame) -> DataFrame:
    """The rows and the rule each of them breaks; empty when all are sound."""
    amounts = (
        "expected_daily_demand", "safety_stock", "reorder_point", "reorder_qty",
        "starting_inventory", "lead_time_demand",
    )
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
    rules = [F.when(bad(c), F.lit(f"{c} must be finite and not negative")) for c in amounts]
    rules += [
        F.when(~F.coalesce(F.col("lead_time_days") >= 1, F.lit(False)), F.lit("lead time must be 1 or more")),
        F.when(~F.coalesce(F.col("excess_coverage_days") > 0, F.lit(False)), F.lit("excess cover must be positive")),
        F.when(
            ~F.coalesce(
                (F.col("service_level_target") > 0) & (F.col("service_level_target") < 1), F.lit(False)
            ),
            F.lit("service level must lie in (0, 1)"),
        ),
    ]
    broken = F.array_compact(F.array(*rules))
    return policy.withColumn("violation", F.explode(broken)).select(*SERIES, "violation")


# -- projection ---------------------------------------------------------------------------

_DAY = (
    "struct<starting_inventory:double,demand:double,arrival:double,on_hand:double,on_order:double,"
    "backlog:double,inventory_position:double,reorder_qty:double,unmet:double,"
    "service_level_achieved:double>"
)


def _let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def projection_trace(
    forecast: Column, start: Column, reorder_at: Column, quantity: Column, lead_days: Column
) -> Column:
    """Array of day structs: an ordered fold of stock over the forecast array.

    Each day takes in the order due, serves demand and backlog, and orders
    when the position is at or below the reorder point. Orders of past days
    stay in an array, as all of them take `lead_days`.
    """
    zero = F.lit(0.0)
    state = F.struct(
        start.cast("double").alias("on_hand"),
        zero.alias("on_order"),
        zero.alias("backlog"),
        F.array().cast("array<double>").alias("placed"),
        F.array().cast(f"array<{_DAY}>").alias("trace"),
    )

    def step(acc: Column, i: Column) -> Column:
        demand = F.greatest(F.element_at(forecast, i), zero)
        arrival = F.when(
            i > lead_days, F.try_element_at(acc["placed"], (i - lead_days).cast("int"))
        ).otherwise(zero)

        def served(a: Column) -> Column:
            stock = acc["on_hand"] + a["arrival"]
            total = a["demand"] + acc["backlog"]
            filled = F.least(stock, total)
            return F.struct(
                a["arrival"].alias("arrival"),
                a["demand"].alias("demand"),
                total.alias("total"),
                (stock - filled).alias("on_hand"),
                (acc["on_order"] - a["arrival"]).alias("on_order"),
                (total - filled).alias("backlog"),
            )

        def ordered(s: Column) -> Column:
            position = s["on_hand"] + s["on_order"] - s["backlog"]
            placed = F.when((position <= reorder_at) & (quantity > 0), quantity).otherwise(zero)
            return F.struct(s.alias("s"), placed.alias("placed"))

        def result(o: Column) -> Column:
            s, placed = o["s"], o["placed"]
            on_order = s["on_order"] + placed
            reached = F.when(
                s["total"] > 0, (s["total"] - s["backlog"]) / s["total"]
            ).otherwise(F.lit(1.0))
            day = F.struct(
                acc["on_hand"].alias("starting_inventory"),
                s["demand"].alias("demand"),
                s["arrival"].alias("arrival"),
                s["on_hand"].alias("on_hand"),
                on_order.alias("on_order"),
                s["backlog"].alias("backlog"),
                (s["on_hand"] + on_order - s["backlog"]).alias("inventory_position"),
                placed.alias("reorder_qty"),
                s["backlog"].alias("unmet"),
                reached.alias("service_level_achieved"),
            )
            return F.struct(
                s["on_hand"].alias("on_hand"),
                on_order.alias("on_order"),
                s["backlog"].alias("backlog"),
                F.array_append(acc["placed"], placed).alias("placed"),
                F.array_append(acc["trace"], day).alias("trace"),
            )

        today = F.struct(demand.alias("demand"), arrival.alias("arrival"))
        return _let(today, lambda a: _let(served(a), lambda s: _let(ordered(s), result)))

    days = F.sequence(F.lit(1), F.size(forecast))
    return F.aggregate(days, state, step, lambda acc: acc["trace"])


def excess_inventory(on_hand: Column, mean: Column, cover_days: Column) -> Column:
    return F.when(
        mean > 0, F.round(F.greatest(on_hand - cover_days * mean, F.lit(0.0)), 6)
    ).otherwise(0.0)


def days_of_inventory(on_hand: Column, mean: Column) -> Column:
    return F.when(mean > 0, F.round(ratio(on_hand, mean), 6)).otherwise(0.0)


def with_trace(policy: DataFrame, forecast: str = "forecast") -> DataFrame:
    """Add the projected days of each row as the array `trace`."""
    lead = F.bround("lead_time_days").cast("int")
    return policy.withColumn(
        "trace",
        projection_trace(
            F.col(forecast),
            F.col("starting_inventory"),
            F.col("reorder_point"),
            F.col("reorder_qty"),
            lead,
        ),
    )


def _day_columns(day: str, mean: Column, cover: Column) -> dict[str, Column]:
    """Reported values of a projected day, rounded as they are stored."""
    d = lambda name: F.col(f"{day}.{name}")
    return {
        "starting_inventory": F.round(d("starting_inventory"), 4),
        "demand_forecast": F.round(d("demand"), 4),
        "inventory_position": F.round(d("inventory_position"), 4),
        "on_hand": F.round(d("on_hand"), 4),
        "orders_placed": F.when(d("reorder_qty") > 0, 1.0).otherwise(0.0),
        "reorder_qty": F.round(d("reorder_qty"), 4),
        "projected_stockout": F.round(d("unmet"), 4) > 0,
        "stockout_units": F.round(d("unmet"), 4),
        "excess_inventory": F.round(excess_inventory(d("on_hand"), mean, cover), 4),
        "days_of_inventory": F.round(days_of_inventory(d("on_hand"), mean), 4),
        "service_level_achieved": F.round(d("service_level_achieved"), 6),
        "on_order": F.round(d("on_order"), 4),
    }


def inventory_projection(
    traced: DataFrame, clock: Clock, keys: list[str] = SERIES, set_id: int = 1
) -> DataFrame:
    """One row per series and projected day.

    The fold has its own column and an outer generator reads it, which keeps
    the optimizer from evaluating the fold again to test for empty arrays.
    """
    policy = ["lead_time_demand", "safety_stock", "reorder_point"]
    extra = ["expected_daily_demand", "excess_coverage_days"]
    rows = traced.select(
        *keys, *policy, *extra, F.posexplode_outer("trace").alias("_i", "_d")
    )
    days = _day_columns("_d", F.col("expected_daily_demand"), F.col("excess_coverage_days"))
    return rows.select(
        F.lit(set_id).alias("assumption_set_id"),
        *keys,
        (F.col("_i") + clock.forecast_start).alias("day_id"),
        *[F.round(c, 4).alias(c) for c in policy],
        *[c.alias(name) for name, c in days.items()],
        F.lit(SIMULATED).alias("data_provenance"),
    )


# -- summary --------------------------------------------------------------------------------

_SUMS = (
    "demand_forecast", "stockout_units", "reorder_qty", "inventory_position", "on_hand",
    "excess_inventory", "days_of_inventory",
)


def projection_summary(traced: DataFrame, keep: list[str]) -> DataFrame:
    """Totals, means and end state of each projection, from its own array.

    Works on the array of a row, so nothing is exploded or shuffled. Stored
    day values are whole numbers of 0.0001, which makes the sums exact.
    """
    mean, cover = F.col("expected_daily_demand"), F.col("excess_coverage_days")

    def stored(d: Column) -> Column:
        excess = F.round(excess_inventory(d["on_hand"], mean, cover), 4)
        cover_days = F.round(days_of_inventory(d["on_hand"], mean), 4)
        return F.struct(
            scaled(F.round(d["demand"], 4)).alias("demand_forecast"),
            scaled(F.round(d["unmet"], 4)).alias("stockout_units"),
            scaled(F.round(d["reorder_qty"], 4)).alias("reorder_qty"),
            scaled(F.round(d["inventory_position"], 4)).alias("inventory_position"),
            scaled(F.round(d["on_hand"], 4)).alias("on_hand"),
            scaled(excess).alias("excess_inventory"),
            scaled(cover_days).alias("days_of_inventory"),
            scaled(F.round(d["arrival"], 4)).alias("arrival"),
        )

    def total(name: str) -> Column:
        return F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x[name])

    def days_with(name: str) -> Column:
        return F.size(F.filter("_s", lambda x: x[name] > 0))

    n = F.size("_s")
    last = F.element_at("trace", -1)
    first = F.array_position(F.transform("_s", lambda x: x["stockout_units"] > 0), True)
    demand, backlog = total("demand_forecast"), scaled(F.round(last["backlog"], 4))
    return traced.withColumn("_s", F.transform("trace", stored)).select(
        *keep,
        unscaled(demand).alias("total_demand"),
        days_with("stockout_units").alias("stockout_days"),
        unscaled(total("stockout_units")).alias("stockout_units"),
        F.round(1 - ratio(days_with("stockout_units"), n), 6).alias("service_level_achieved"),
        F.when(demand > 0, F.round(ratio(demand - backlog, demand), 6))
        .otherwise(1.0)
        .alias("fill_rate"),
        days_with("reorder_qty").alias("reorder_frequency"),
        unscaled(total("reorder_qty")).alias("total_reorder_units"),
        unscaled(total("arrival")).alias("replenishment_units"),
        mean_of_scaled(total("inventory_position"), n).alias("avg_inventory_position"),
        mean_of_scaled(total("on_hand"), n).alias("avg_on_hand"),
        F.round(last["on_hand"], 4).alias("final_on_hand"),
        F.round(last["on_order"], 4).alias("final_on_order"),
        F.round(last["backlog"], 4).alias("final_backorder"),
        F.round(last["inventory_position"], 4).alias("final_inventory_position"),
        days_with("excess_inventory").alias("excess_days"),
        unscaled(total("excess_inventory")).alias("total_excess_units"),
        mean_of_scaled(total("days_of_inventory"), n).alias("avg_days_of_inventory"),
        F.when(first > 0, (first - 1).cast("int")).alias("first_stockout_offset"),
    )


# -- checks and reads ---------------------------------------------------------------------------


def trace_replay_check(projection: DataFrame, policy: DataFrame) -> DataFrame:
    """Replay stock identities on the stored days and count what does not fit.

    Works on the stored rows only, with windows over the days of one series:
    stock = stock before + arrival - served, an order arrives after the lead
    time, an order is placed exactly when the position asks for one, and the
    stockout flag agrees with the units.
    """
    w = W.partitionBy(*SERIES).orderBy("day_id")
    lead = policy.select(
        *SERIES,
        F.bround("lead_time_days").cast("int").alias("_lead"),
        F.col("reorder_qty").alias("_q"),
        F.col("starting_inventory").alias("_start"),
        F.col("reorder_point").alias("_rop"),
    )
    due = projection.join(lead, SERIES).select(
        *SERIES,
        (F.col("day_id") + F.col("_lead")).alias("day_id"),
        F.col("reorder_qty").alias("_arrival"),
    )
    days = (
        projection.join(due, [*SERIES, "day_id"], "left")
        .join(lead, SERIES)
        .withColumn("_arrival", F.coalesce("_arrival", F.lit(0.0)))
        .withColumn("_before", F.coalesce(F.lag("on_hand").over(w), F.col("_start")))
        .withColumn("_owed", F.coalesce(F.lag("stockout_units").over(w), F.lit(0.0)))
        .withColumn("_ordered", F.sum("reorder_qty").over(w))
        .withColumn("_landed", F.sum("_arrival").over(w))
    )
    served = F.col("demand_forecast") + F.col("_owed") - F.col("stockout_units")
    placed = F.col("orders_placed") > 0
    position_before = F.col("inventory_position") - F.col("reorder_qty")
    off = lambda a, b, tol: F.abs(a - b) > tol
    return days.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(off(F.col("starting_inventory"), F.col("_before"), 0.011)).alias("bad_start"),
        F.count_if(
            off(F.col("on_hand"), F.col("_before") + F.col("_arrival") - served, 0.011)
        ).alias("bad_on_hand"),
        F.count_if(
            off(
                F.col("inventory_position"),
                F.col("on_hand") + F.col("_ordered") - F.col("_landed") - F.col("stockout_units"),
                0.011,
            )
        ).alias("bad_position"),
        F.count_if(placed & off(F.col("reorder_qty"), F.col("_q"), 1e-3)).alias("bad_order_size"),
        F.count_if(
            (placed & (position_before > F.col("_rop") + 0.011))
            | (~placed & (F.col("_q") > 0) & (position_before < F.col("_rop") - 0.011))
        ).alias("bad_trigger"),
        F.count_if(F.col("projected_stockout") != (F.col("stockout_units") > 0)).alias("bad_flag"),
    )


def inventory_kpi(results: DataFrame) -> DataFrame:
    """Portfolio view of one scenario's results in one row."""
    mean = lambda c, stored=4: exact_mean(F.col(c), stored).alias(c)
    total = lambda c, out: unscaled(F.sum(scaled(F.col(c)))).alias(out)
    return (
        results.agg(
            mean("service_level_achieved", 6),
            mean("fill_rate", 6),
            total("stockout_units", "stockout_units"),
            total("total_excess_units", "excess_inventory"),
            mean("avg_days_of_inventory"),
            mean("safety_stock"),
            mean("reorder_point"),
            total("final_on_hand", "on_hand"),
            total("final_on_order", "on_order"),
            total("final_backorder", "backorder"),
            F.count(F.lit(1)).alias("n_series"),
        )
        .withColumn(
            "inventory_position",
            F.round(F.col("on_hand") + F.col("on_order") - F.col("backorder"), 4),
        )
    )


def inventory_horizon(
    projection: DataFrame, product: DataFrame, store: DataFrame, token: str
) -> DataFrame:
    from demandspark.operators.demand_views import one_series

    return one_series(projection, token, product, store).select(
        *SERIES,
        "day_id",
        "inventory_position",
        "on_hand",
        "on_order",
        "orders_placed",
        "projected_stockout",
        "stockout_units",
        "days_of_inventory",
        "data_provenance",
    ).orderBy("day_id")


def pilot_report(results: DataFrame, n: int = 64) -> DataFrame:
    """Totals over the n series with the most history units."""
    pilot = top_n(results, [F.desc("total_units_hist"), *map(F.asc, SERIES)], n, "_rank")
    total = lambda c, out: unscaled(F.sum(scaled(F.col(c)))).alias(out)
    return pilot.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("reorder_frequency").alias("reorder_triggers"),
        total("replenishment_units", "replenishment_units"),
        F.sum("stockout_days").alias("stockout_days"),
        total("stockout_units", "stockout_units"),
        F.sum("excess_days").alias("excess_days"),
        exact_mean(F.col("fill_rate"), 6).alias("mean_fill_rate"),
        F.min("fill_rate").alias("min_fill_rate"),
        F.max("fill_rate").alias("max_fill_rate"),
        exact_mean(F.col("service_level_achieved"), 6).alias("mean_service_level"),
        F.count_if(F.col("stockout_days") > 0).alias("series_with_stockout"),
        F.count_if(F.col("replenishment_units") > 0).alias("series_with_replenishment"),
    )
