"""Layers clustered by series: a read of one skips the others."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from demandspark.operators import facts


def groups(path):
    """(bytes, rows, lowest and highest product and store) of every row group."""
    out = []
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            spans = [(stats[c].min, stats[c].max) for c in ("product_surr_id", "store_surr_id")]
            out.append((group.total_byte_size, group.num_rows, *spans))
    return out


def daily(spark):
    rows = spark.range(200 * 5 * 600)
    return rows.select(
        ((F.col("id") * 7919) % 200 + 1).cast("int").alias("product_surr_id"),
        (F.floor(F.col("id") / 200) % 5 + 1).cast("int").alias("store_surr_id"),
        F.floor(F.col("id") / 1000).cast("int").alias("date_id"),
        F.rand(3).alias("value"),
        (F.floor(F.col("id") / 1000) % 2).cast("int").alias("half"),
    )


def test_one_series_is_under_two_percent_of_a_layer(spark, tmp_path):
    df = daily(spark)
    path = str(tmp_path / "t")
    facts.write_fact(df, path, {}, "derived", 1, cluster_by=["product_surr_id", "store_surr_id"], group_bytes=64 << 10)
    found = groups(path)
    assert sum(g[1] for g in found) == 600_000
    size = sum(g[0] for g in found)
    for product, store in ((1, 1), (77, 3), (200, 5)):
        touched = [g for g in found if g[2][0] <= product <= g[2][1] and g[3][0] <= store <= g[3][1]]
        assert 0 < sum(g[0] for g in touched) < 0.02 * size
        one = facts.read_series(spark.read.parquet(path), product, store)
        assert one.count() == 600 == one.select("date_id").distinct().count()
        assert f"EqualTo(product_surr_id,{product})" in one._jdf.queryExecution().executedPlan().toString()


def test_slices_stay_and_are_clustered_too(spark, tmp_path):
    path = str(tmp_path / "t")
    facts.write_fact(daily(spark), path, {}, "derived", 1, ["half"], ["product_surr_id", "store_surr_id"], group_bytes=64 << 10)
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{path}/half=*")) == ["half=0", "half=1"]
    found = groups(path)
    touched = [g for g in found if g[2][0] <= 77 <= g[2][1] and g[3][0] <= 3 <= g[3][1]]
    assert sum(g[0] for g in touched) < 0.03 * sum(g[0] for g in found)
    assert facts.read_series(spark.read.parquet(path), 77, 3).count() == 600
