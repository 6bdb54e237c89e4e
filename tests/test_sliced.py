"""Atomic replacement of slices and merges into written tables."""

from __future__ import annotations

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from demandspark.operators.sliced import ConflictingWrite, SlicedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def failing(df, column, value):
    """A frame whose tasks fail on one row, after others were written."""
    bad = F.when(F.col(column) == value, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col(column))
    return df.withColumn(column, bad)


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    table.replace(spark.createDataFrame([(1, 10), (2, 20)], "w int, n int"))
    new = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5)], "w int, n int").repartition(8)
    for write in (lambda: table.replace(failing(new, "n", 77)), lambda: table.replace(failing(new, "n", 77), [(1,), (2,)]), lambda: table.upsert(failing(new, "n", 77), ["n"])):
        with pytest.raises(Exception, match="lost"):
            write()
        assert rows(table.read()) == [(10, 1), (20, 2)] and table.versions() == [1]
    table.replace(new, [(1,), (2,)])
    assert table.read().count() == 101


def test_a_frame_that_reads_the_table_may_be_written_into_it(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    table.replace(spark.createDataFrame([(w, n) for w in range(4) for n in range(50)], "w int, n int"))
    before = table.read()
    table.replace(table.read().where("w < 2").withColumn("n", F.col("n") * 2))
    table.upsert(table.read().where("w = 3").withColumn("n", F.col("n") + 1000), ["w", "n"])
    assert table.read().agg(F.sum("n"), F.count(F.lit(1))).first() == (1225 * 6 + 1225 + 50_000, 250)
    assert before.agg(F.sum("n")).first()[0] == 1225 * 4  # a reader keeps its version
    assert table.read(1).count() == 200


def test_only_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    table.replace(spark.createDataFrame([(1, 10)], "w int, n int"))
    stale = table.manifest()
    table.replace(spark.createDataFrame([(1, 11)], "w int, n int"))
    other = SlicedTable(spark, str(tmp_path), ["w"])
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(ConflictingWrite):
        other.replace(spark.createDataFrame([(1, 12)], "w int, n int"))
    assert rows(table.read()) == [(11, 1)]


def test_slice_values_of_any_kind(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["s", "b", "d"])
    kind = "n int, s string, b boolean, d date"
    odd = ["a b", "x=y/z", "%", "ä:*?", None, "__x", "1"]
    data = [(i, s, i % 2 == 0, date(2020, 1, 1 + i)) for i, s in enumerate(odd)]
    table.replace(spark.createDataFrame(data, kind))
    assert rows(table.read()) == rows(spark.createDataFrame(data, kind))
    table.replace(spark.createDataFrame([(100 + r[0], *r[1:]) for r in data[:3]], kind), [r[1:] for r in data[:5]])
    assert sorted(r.n for r in table.read().collect()) == [5, 6, 100, 101, 102]
    table.upsert(spark.createDataFrame([(7, None, None, None)], kind), ["n"])
    table.replace(spark.createDataFrame([], kind), [(None, None, None)])
    assert sorted(r.n for r in table.read().collect()) == [5, 6, 100, 101, 102]


def test_upsert_rewrites_only_the_slices_it_touches(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    table.replace(spark.createDataFrame([(k, k % 5, "old") for k in range(100)], "k int, w int, v string"))
    before = dict(table.manifest()["slices"])
    # Key 0 moves from slice 0 to slice 1, key 200 is new in slice 9.
    table.upsert(spark.createDataFrame([(0, 1, "new"), (200, 9, "new"), (200, 9, "newer")], "k int, w int, v string"), ["k"])
    after = table.manifest()["slices"]
    assert {f for f in before if after.get(f) != before[f]} == {"w=0", "w=1"} and "w=9" in after
    want = {k: (k % 5, "old") for k in range(100)} | {0: (1, "new"), 200: (9, "new")}
    assert {r.k: (r.w, r.v) for r in table.read().collect()} == want and table.read().count() == 101


@pytest.mark.parametrize("key", [["k"], ["k", "w"]])
def test_upserts_equal_a_plain_version(spark, tmp_path, key):
    rnd = random.Random(1)
    pick = lambda: (rnd.choice([None, *range(12)]), rnd.choice([None, 1, 2, 3]), rnd.randrange(1000))
    table, held = SlicedTable(spark, str(tmp_path), ["w"]), []
    for turn in range(4):
        new = [pick() for _ in range(8 if turn else 20)]
        table.upsert(spark.createDataFrame(new, "k int, w int, v int"), key)
        at = [0, 1] if len(key) == 2 else [0]
        name = lambda r: tuple(r[i] for i in at)
        rank = lambda r: [(x is not None, x or 0) for x in r]
        first = {name(r): r for r in sorted(new, key=rank, reverse=True)}
        held = [r for r in held if name(r) not in first] + list(first.values())
        assert rows(table.read().select("k", "w", "v")) == sorted(held, key=repr)


def test_vacuum_keeps_what_the_kept_versions_need(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    for n in range(4):
        table.replace(spark.createDataFrame([(n % 2, n)], "w int, n int"))
    assert len(files(tmp_path)) == 4
    table.vacuum(keep_versions=2)
    assert table.versions() == [3, 4] and len(files(tmp_path)) == 3
    table.vacuum()
    assert rows(table.read()) == [(2, 0), (3, 1)] and len(files(tmp_path)) == 2


def test_wrong_columns_and_missing_tables_are_errors(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    with pytest.raises(FileNotFoundError):
        table.read()
    with pytest.raises(ValueError):
        table.replace(spark.createDataFrame([(1,)], "n int"))
    table.replace(spark.createDataFrame([], "w int, n int"))
    assert table.read().count() == 0
    with pytest.raises(ValueError):
        table.replace(spark.createDataFrame([(1, "x")], "w int, n string"))


def test_a_hot_slice_is_written_by_many_tasks(spark, tmp_path):
    table = SlicedTable(spark, str(tmp_path), ["w"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table.replace(spark.range(2000).select(F.lit(1).alias("w"), F.col("id").alias("n")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files(tmp_path)) > 1 and table.read().count() == 2000
