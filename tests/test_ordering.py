"""Distributed ranks, running sums and quantiles against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.functions.ordering import (
    exact_quantiles,
    page,
    percentile_rank,
    running_totals,
    top_n,
)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value."""
    rng = random.Random(7)
    rows = [(i, 5.0 if i % 3 == 0 else float(rng.randint(0, 50)), i % 11) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, v double, w int").repartition(7)


def test_running_totals_match_a_sort(hot):
    rows, df = hot
    got = running_totals(
        df, [-F.col("v"), F.col("id")], {"run": F.col("w")}, row_number="rank",
        grand={"all": F.col("w")},
    ).orderBy("rank").collect()
    want, run = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    for i, (row, w) in enumerate(zip(got, want), start=1):
        run += w[2]
        assert (row["id"], row["rank"], row["run"]) == (w[0], i, run)
    assert {r["all"] for r in got} == {run}


def test_hot_value_is_spread_over_buckets(hot):
    from demandspark.functions.ordering import _splitters

    _, df = hot
    keyed = df.withColumn("_key", F.struct(F.col("v"), F.col("id")))
    counts = (
        keyed.withColumn("_p", _splitters(keyed, 64))
        .groupBy(F.size(F.filter("_p", lambda p: p < F.col("_key"))).alias("b"))
        .count()
        .collect()
    )
    assert max(c["count"] for c in counts) < 3000 / 5


def test_percentile_rank_shares_ties(spark, hot):
    small = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 20.0)], "id int, v double")
    got = {r["id"]: r["p"] for r in percentile_rank(small, "v", "p").collect()}
    assert got == {1: 0.25, 2: 0.25, 3: 1.0}
    four = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "id int, v double")
    got = sorted(r["p"] for r in percentile_rank(four, "v", "p").collect())
    assert got == pytest.approx([0, 1 / 3, 2 / 3, 1])
    one = spark.createDataFrame([(1, 3.0)], "id int, v double")
    assert percentile_rank(one, "v", "p").first()["p"] == 0.5
    empty = spark.createDataFrame([(1, None), (2, 4.0)], "id int, v double")
    assert {r["id"]: r["p"] for r in percentile_rank(empty, "v", "p").collect()} == {1: 0.0, 2: 1.0}
    rows, df = hot
    got = {r["id"]: r["p"] for r in percentile_rank(df, "v", "p").collect()}
    values = np.array([r[1] for r in rows])
    for i, v, _ in rows[::97]:
        mean_rank = (values < v).sum() + ((values == v).sum() + 1) / 2
        assert got[i] == pytest.approx((mean_rank - 1) / (len(rows) - 1))


def test_exact_quantiles_interpolate(hot):
    rows, df = hot
    got = exact_quantiles(df, "v", {"a": 1 / 3, "b": 2 / 3, "m": 0.5, "top": 1.0}).first()
    want = np.quantile([r[1] for r in rows], [1 / 3, 2 / 3, 0.5, 1.0])
    assert [got["a"], got["b"], got["m"], got["top"]] == pytest.approx(list(want))


def test_pages_and_top_rows(hot):
    rows, df = hot
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    order = [F.asc("v"), F.asc("id")]
    assert [r["id"] for r in page(df, order, 3, 10).collect()] == want[20:30]
    assert [r["id"] for r in top_n(df, order, 5, "rank").orderBy("rank").collect()] == want[:5]


@pytest.mark.parametrize("splits,rows", [(64, 1_000_000), (5, 1_000_000), (64, 7)])
def test_ties_are_carried_across_buckets(spark, splits, rows):
    rng = random.Random(3)
    values = [0.0] * 500 + [rng.choice([-1.0, 1.0, 2.5, None, float("nan"), -0.0]) for _ in range(300)] + [rng.random() for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(5)
    clean = [0.0 if v is None or v != v else v for v in values]
    order = sorted(clean)
    first = {v: order.index(v) for v in clean}
    count = {v: clean.count(v) for v in clean}
    got = percentile_rank(df, "v", "p", splits=splits, bucket_rows=rows)
    assert got.columns == ["id", "v", "p"]
    for r in got.collect():
        v = clean[r.id]
        assert r.p == pytest.approx((first[v] + (count[v] - 1) / 2) / (len(values) - 1), abs=1e-12)


def test_half_of_the_rows_equal_and_no_task_over_a_twentieth(spark):
    from demandspark.functions.ordering import _in_buckets

    df = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    keyed = df.withColumn("_key", F.struct("v", F.xxhash64("id")))
    for splits, rows in ((64, 1_000_000), (2, 1000)):
        sizes = [r["count"] for r in _in_buckets(keyed, splits, rows).groupBy("_bucket").count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) <= 2000 * (1 if splits == 2 else 1.5)


def test_buckets_grow_with_the_rows_and_ranks_stay(spark):
    from demandspark.functions.ordering import _in_buckets

    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("id"))
    keyed = df.withColumn("_key", F.struct("id"))
    assert _in_buckets(keyed, 4, 10).select("_bucket").distinct().count() > 200
    got = running_totals(df, [F.col("id")], {"run": F.col("id")}, row_number="rank", splits=4, bucket_rows=10).collect()
    assert all(r["rank"] == r["id"] + 1 and r["run"] == r["id"] * (r["id"] + 1) // 2 for r in got) and len(got) == 3000


def test_ranks_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, 3.0)], "id int, v double")
    assert [r["p"] for r in percentile_rank(one, "v", "p").collect()] == [0.5]
    assert percentile_rank(one.limit(0), "v", "p").count() == 0
