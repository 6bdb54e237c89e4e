"""Exact moments and quantile sketches."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from demandspark.functions.exprs import exact_day_slope, exact_variance
from demandspark.operators import demand


def sums(values, first=1):
    return len(values), first, first + len(values) - 1, sum(values), sum(v * v for v in values), sum((first + i) * v for i, v in enumerate(values))


def plain(values, first=1):
    n, mean = len(values), Fraction(sum(values), len(values))
    variance = sum((v - mean) ** 2 for v in values) / (n - 1)
    mid = Fraction(2 * first + n - 1, 2)
    slope = sum((first + i - mid) * (v - mean) for i, v in enumerate(values)) / sum((first + i - mid) ** 2 for i in range(n))
    return float(variance), float(slope)


def test_moments_keep_nine_digits_where_doubles_cancel(spark):
    rnd = random.Random(2)
    cases = [[10**6 + rnd.choice([-1, 1]) for _ in range(2499)], [10**14 + i % 2 for i in range(500)], [5 * 10**15 + i for i in range(300)], [0, 0, 3], [7, 7, 7]]
    data = [(k, *map(str, sums(v, first=k + 1))) for k, v in enumerate(cases)]
    df = spark.createDataFrame(data, "k int, n string, first string, last string, s string, ss string, xs string")
    number = {c: F.col(c).cast("decimal(38,0)") for c in ("s", "ss", "xs")} | {c: F.col(c).cast("int") for c in ("n", "first", "last")}
    got = df.select("k", exact_variance(number["n"], number["s"], number["ss"]).alias("v"), exact_day_slope(number["first"], number["last"], number["s"], number["xs"]).alias("b")).collect()
    for r in got:
        assert (r.v, r.b) == pytest.approx(plain(cases[r.k], first=r.k + 1), rel=1e-9, abs=1e-300)


def test_moments_beyond_the_decimals_are_doubles(spark):
    row = spark.range(1).select(exact_variance(F.lit(3), F.lit("2e37").cast("decimal(38,0)"), F.lit("9e37").cast("decimal(38,0)")).alias("v"), exact_variance(F.lit(1), F.lit(5), F.lit(25)).alias("one")).first()
    assert row.v < 0 and row.one is None


def test_statistics_of_large_even_demand(spark):
    rnd = random.Random(4)
    values = [10**6 + rnd.choice([-1, 1]) for _ in range(400)]
    daily = spark.createDataFrame([(1, 1, i + 1, v) for i, v in enumerate(values)], "product_surr_id int, store_surr_id int, date_id int, units_sold int")
    row = demand.demand_stats(daily, 1, 400).first()
    variance, slope = plain(values)
    assert row.std_daily_units == pytest.approx(variance**0.5, abs=5.1e-5) and row.trend_slope == pytest.approx(slope, abs=5.1e-9)


@pytest.mark.parametrize("kind", ["skewed", "tied", "even"])
def test_sketched_ranks_are_within_the_stated_error(spark, kind):
    rnd = random.Random(6)
    draw = {"skewed": lambda: int(rnd.paretovariate(0.7)), "tied": lambda: rnd.choice([0, 0, 0, 5, 5, 9]), "even": lambda: rnd.randrange(10**9)}[kind]
    values = sorted(draw() for _ in range(60_000))
    df = spark.createDataFrame([(i % 17, v) for i, v in enumerate(values)], "store int, total_units bigint").repartition(8)
    items = 256
    low, high, n = demand.sketched_volume_quantiles(demand.volume_sketches(df, ["store"], items), items=items).first()
    assert n == len(values)
    for share, got in ((1 / 3, low), (2 / 3, high)):
        below, to = sum(v < got for v in values) / n, sum(v <= got for v in values) / n
        assert below - 2 * demand.sketch_rank_error(items) <= share <= to + 2 * demand.sketch_rank_error(items)


def test_small_and_empty_sketches(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 9), (2, None), (3, None)], "store int, total_units bigint")
    assert tuple(demand.sketched_volume_quantiles(demand.volume_sketches(df, ["store"])).first()) == (5, 7, 3)
    assert tuple(demand.sketched_volume_quantiles(demand.volume_sketches(df.limit(0), ["store"])).first()) == (None, None, 0)
