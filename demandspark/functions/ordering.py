"""Ranks, running sums and exact quantiles over a whole table.

A window without partition keys moves every row to one task. These helpers
give the same numbers from range buckets: a bounded set of split points is
drawn from the rows, each row falls into the bucket between two of them, the
bucket totals (one row per bucket) are summed up in order, and a window inside
each bucket adds the rest. Split points are whole ordering keys, ids included,
so a value that a third of the rows share is still spread over many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.session import stage

#: Buckets of a small table, and rows that a bucket of a larger one holds.
SPLITS = 64
BUCKET_ROWS = 1_000_000


def _splitters(keyed: DataFrame, splits: int) -> Column:
    """Sorted array of at most `splits` ordering keys, the same on every run.

    The rows with the smallest key hashes are taken, which is a uniform draw
    that does not depend on how the rows are laid out.
    """
    sample = (
        keyed.select("_key", F.xxhash64("_key").alias("_h")).orderBy("_h", "_key").limit(splits)
    )
    return sample.agg(F.sort_array(F.collect_list("_key"))).scalar()


def _in_buckets(keyed: DataFrame, splits: int, bucket_rows: int) -> DataFrame:
    """Rows with the number of their range of `_key`, in `_bucket`; buckets grow in number with the rows.

    `keyed` is a written table. Up to `splits` full buckets every row looks its
    place up in an array of split points. Beyond, a range exchange deals the
    rows out, and what it did is written, so that all later reads agree.
    """
    rows = keyed.count()
    if rows <= splits * bucket_rows:
        pointed = keyed.withColumn("_points", _splitters(keyed, splits))
        return pointed.withColumn("_bucket", F.size(F.filter("_points", lambda p: p < F.col("_key"))))
    dealt = keyed.repartitionByRange(-(-rows // bucket_rows), "_key")
    return stage(dealt.withColumn("_bucket", F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    *,
    row_number: str | None = None,
    grand: dict[str, Column] | None = None,
    splits: int = SPLITS,
    written: bool = False,
    within: list[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add running sums (own row included) in ascending `order`.

    `order` must identify a row, so end it with ids; use a negated number for
    a descending sort. `row_number` names a rank column. `grand` adds totals
    over all rows. Three plans read the rows, so they are written once unless
    they come straight from a written table. `within` starts over in each of a
    few groups (scenarios or rankings, not series).
    """
    within = within or []
    measures = dict(sums)
    if row_number:
        measures[row_number] = F.lit(1)
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    keyed = df.withColumn("_key", F.struct(*named))
    keyed = keyed if written else stage(keyed)
    bucketed = _in_buckets(keyed, splits, bucket_rows)
    totals = bucketed.groupBy(*within, "_bucket").agg(
        *[F.sum(c).alias(f"_t_{name}") for name, c in measures.items()],
        *[F.sum(c).alias(f"_g_{name}") for name, c in (grand or {}).items()],
    )
    # One row per bucket, so about one for every `bucket_rows` rows in a group of these windows.
    buckets = W.partitionBy(*within).orderBy("_bucket")
    earlier = buckets.rowsBetween(W.unboundedPreceding, -1)
    everything = buckets.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        *within,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in measures
        ],
        *[F.sum(f"_g_{name}").over(everything).alias(f"_all_{name}") for name in grand or {}],
    )
    inside = (
        W.partitionBy(*within, "_bucket").orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    )
    joined = bucketed.join(F.broadcast(offsets), [*within, "_bucket"])
    running = {
        name: F.sum(c).over(inside) + F.col(f"_before_{name}") for name, c in measures.items()
    }
    keep = [c for c in df.columns if c not in running]
    return joined.select(
        *keep,
        *[c.alias(name) for name, c in running.items()],
        *[F.col(f"_all_{name}").alias(name) for name in grand or {}],
    )


def value_ranks(df: DataFrame, value: str, written: bool = False) -> DataFrame:
    """One row per distinct value: its count, the rows up to it, all rows.

    Equal values collapse before anything is moved, so a frequent value is
    one row here.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n_equal"))
    return running_totals(
        counts,
        [F.col(value)],
        {"n_up_to": F.col("n_equal")},
        grand={"n_all": F.col("n_equal")},
        written=written,
    )


def percentile_rank(
    df: DataFrame,
    value: str,
    out: str,
    written: bool = False,
    splits: int = SPLITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(average rank - 1) / (n - 1), ties sharing their average; 0.5 for one row.

    Rows are dealt to buckets by value and row, so one that half of the rows
    share fills many buckets. Inside a bucket a window counts the smaller and
    the equal rows. Only the lowest and the highest value of a bucket can go on
    in another one: their counts, at most two for each bucket, are added over
    the buckets and broadcast. No row meets another by its value.
    """
    filled = df.withColumn(
        "_v", F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)) + F.lit(0.0)
    )
    row = F.struct("_v", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    keyed = filled.withColumn("_key", row)
    keyed = _in_buckets(keyed if written else stage(keyed), splits, bucket_rows)
    edges = stage(
        keyed.groupBy("_bucket").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    # Windows over one row for each bucket.
    ordered = W.orderBy("_bucket")
    placed = edges.select(
        "*",
        F.coalesce(F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"),
    )
    on_edge = keyed.join(F.broadcast(edges), "_bucket").filter(F.col("_v").isin(F.col("_lo"), F.col("_hi")))
    held = on_edge.groupBy("_bucket", "_v").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(placed), "_bucket")
    # All rows of the first bucket of a value are smaller or equal unless the value is its lowest.
    smaller = F.col("_before") + F.when(F.col("_v") == F.col("_lo"), 0).otherwise(F.col("_n") - F.col("_c"))
    ties = held.groupBy("_v").agg(F.min(smaller).alias("_less"), F.sum("_c").alias("_equal"))
    inside = W.partitionBy("_bucket").orderBy("_v")
    counted = (
        keyed.withColumn("_below", F.rank().over(inside) - 1)
        .withColumn("_same", F.count(F.lit(1)).over(W.partitionBy("_bucket", "_v")))
        .join(F.broadcast(placed.select("_bucket", "_before", "_all")), "_bucket")
        .join(F.broadcast(ties), "_v", "left")
    )
    less = F.coalesce("_less", F.col("_before") + F.col("_below"))
    equal = F.coalesce("_equal", "_same")
    rank = F.when(F.col("_all") == 1, F.lit(0.5)).otherwise(
        (less + (equal - 1) / F.lit(2.0)) / (F.col("_all") - 1)
    )
    return counted.select(*[F.col(f"`{c}`") for c in df.columns], rank.alias(out))


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row of interpolated quantiles, computed without gathering the values."""
    ranks = value_ranks(df.filter(F.col(value).isNotNull()), value)
    first = F.col("n_up_to") - F.col("n_equal")  # 0-based position of its first copy
    last = F.col("n_up_to") - 1
    aggs = []
    for name, p in probabilities.items():
        position = (F.col("n_all") - 1) * F.lit(p)
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            held = (first <= at) & (last >= at)
            aggs.append(F.max(F.when(held, F.col(value).cast("double"))).alias(f"{name}_{tag}"))
        aggs.append(F.max(position - F.floor(position)).alias(f"{name}_f"))
    row = ranks.agg(*aggs)
    return row.select(
        *[
            (
                F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_f")
            ).alias(n)
            for n in probabilities
        ]
    )


def top_n(df: DataFrame, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows with their rank; the window sees only those n rows."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
