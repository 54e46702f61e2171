"""Incremental modes: upsert equals full rebuild, re-runs are idempotent,
high-water marks pass only later rows; the landing stream is a no-op on re-run."""
import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom import storage
from riskloom.operators.dedupe import dedupe
from riskloom.session import scratch_path
from riskloom.sources.writers import write_year_partitioned
from riskloom.streaming.incremental import incremental_hwm, late_rows, rebuild_full, same_rows, upsert_partitioned

KEYS = ["trade_date", "k"]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, k string, v double, seq int")


def test_upsert_equals_full_and_is_idempotent(spark):
    d = lambda y, m, dd: dt.date(y, m, dd)
    stored = _rows(spark, [(d(2020, 1, 2), "a", 1.0, 0), (d(2021, 3, 1), "b", 2.0, 0)])
    batch = _rows(spark, [(d(2021, 3, 1), "b", 9.0, 1), (d(2021, 3, 2), "c", 3.0, 1), (d(2022, 1, 5), "d", 4.0, 1)])
    root = scratch_path(spark, f"test-upsert-{uuid.uuid4().hex}")
    path = os.path.join(root, "t")
    write_year_partitioned(stored, path, KEYS)
    upsert_partitioned(spark, batch, path, KEYS, ["seq"], "first")
    got = spark.read.parquet(path).drop("year")
    full = dedupe(stored.unionByName(batch), KEYS, ["seq"], "first")
    assert same_rows(got, full).count() == 0
    assert {r.k: r.v for r in got.collect()}["b"] == 2.0  # keep-first: stored row wins
    snap = os.path.join(root, "snap")
    got.write.parquet(snap)
    upsert_partitioned(spark, batch, path, KEYS, ["seq"], "first")
    assert same_rows(spark.read.parquet(snap), spark.read.parquet(path).drop("year")).count() == 0
    # keep-last lets the correction win
    upsert_partitioned(spark, batch, path, KEYS, ["seq"], "last")
    assert {r.k: r.v for r in spark.read.parquet(path).collect()}["b"] == 9.0


def test_hwm_passes_only_later_rows(spark):
    d = dt.date
    stored = _rows(spark, [(d(2020, 5, 1), "a", 1.0, 0), (d(2021, 1, 1), "b", 1.0, 0)])
    new = _rows(spark, [(d(2020, 4, 1), "late", 1.0, 1), (d(2020, 6, 1), "x", 1.0, 1),
                        (d(2021, 1, 1), "same", 1.0, 1), (d(2022, 1, 1), "y", 1.0, 1)])
    assert sorted(r.k for r in incremental_hwm(new, stored).collect()) == ["x", "y"]


def test_landing_stream_rerun_is_noop(spark):
    from riskloom.streaming.landing import run_landing_to_table
    root = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    land = os.path.join(root, "landing")
    rows = [("2024-01-02", "a", "1.5", "1"), ("2024-01-02", "a", "2.5", "2"), ("2024-02-01", "b", "x", "1")]
    spark.createDataFrame(rows, "d string, k string, v string, seq string").write.option("header", True).csv(land)
    cols = ["seq", "d", "v", "k"]

    def transform(b):
        return b.select(F.to_date("d").alias("trade_date"), "k", F.col("v").try_cast("double").alias("v"),
                        F.col("seq").cast("int").alias("seq"))

    table, ck = os.path.join(root, "table"), os.path.join(root, "ck")
    n1 = run_landing_to_table(spark, land, cols, table, ck, transform, KEYS, ["seq"])
    first = {r.k: r.v for r in spark.read.parquet(table).collect()}
    assert n1 >= 1 and first == {"a": 1.5, "b": None}
    n2 = run_landing_to_table(spark, land, cols, table, ck, transform, KEYS, ["seq"])
    assert n2 == 0 and spark.read.parquet(table).count() == 2


def _years(spark, path):
    return {(r.trade_date.isoformat(), r.k): r.v for r in spark.read.parquet(path).collect()}


def test_upsert_touches_only_its_own_years(spark):
    """Upsert 1998, rebuild 1998 with corrected values, upsert 1999: 1998 stays rebuilt."""
    path = os.path.join(scratch_path(spark, f"test-years-{uuid.uuid4().hex}"), "t")
    d = dt.date
    upsert_partitioned(spark, _rows(spark, [(d(1998, 1, 5), "a", 1.0, 0)]), path, KEYS)
    rebuild_full(lambda: _rows(spark, [(d(1998, 1, 5), "a", 9.0, 0)]), path, KEYS)
    assert _years(spark, path) == {("1998-01-05", "a"): 9.0}
    upsert_partitioned(spark, _rows(spark, [(d(1999, 1, 5), "b", 2.0, 0)]), path, KEYS)
    assert _years(spark, path) == {("1998-01-05", "a"): 9.0, ("1999-01-05", "b"): 2.0}
    upsert_partitioned(spark, _rows(spark, []), path, KEYS)
    assert len(_years(spark, path)) == 2
    assert not storage.children(spark, path + "__staging")


def test_failed_rebuild_and_failed_check_leave_the_table(spark):
    path = os.path.join(scratch_path(spark, f"test-fail-{uuid.uuid4().hex}"), "t")
    good = _rows(spark, [(dt.date(2020, 1, 5), "a", 1.0, 0)])
    rebuild_full(lambda: good, path, KEYS)

    def refuse(df):
        raise ValueError("refused")
    with pytest.raises(ValueError):
        rebuild_full(lambda: good.withColumn("v", F.lit(5.0)), path, KEYS, check=refuse)
    with pytest.raises(ValueError):
        upsert_partitioned(spark, good.withColumn("v", F.lit(5.0)), path, KEYS, keep="last", check=refuse)
    with pytest.raises(Exception):
        rebuild_full(lambda: good.withColumn("v", F.raise_error(F.lit("boom")).cast("double")), path, KEYS)
    assert _years(spark, path) == {("2020-01-05", "a"): 1.0}


def test_storage_errors_are_not_taken_for_a_missing_table(spark):
    with pytest.raises(Exception):
        upsert_partitioned(spark, _rows(spark, [(dt.date(2020, 1, 5), "a", 1.0, 0)]), "nosuchscheme://x/t", KEYS)


def test_late_rows_are_found_in_closed_years(spark):
    d = dt.date
    stored = _rows(spark, [(d(2020, 5, 1), "a", 1.0, 0), (d(2021, 1, 1), "b", 1.0, 0)])
    new = _rows(spark, [(d(2020, 5, 1), "a", 2.0, 0), (d(2020, 3, 1), "c", 1.0, 0), (d(2021, 1, 1), "b", 1.0, 0), (d(2022, 1, 1), "d", 1.0, 0)])
    assert {r.k for r in late_rows(new, stored, KEYS).collect()} == {"a", "c", "d"}


def test_session_setting_is_left_alone(spark):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    path = os.path.join(scratch_path(spark, f"test-conf-{uuid.uuid4().hex}"), "t")
    upsert_partitioned(spark, _rows(spark, [(dt.date(2020, 1, 5), "a", 1.0, 0)]), path, KEYS)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_fingerprints_find_changed_repeated_and_swapped_rows(spark):
    from riskloom.streaming.incremental import changed_years, fingerprint, same_rows_by_year
    base = spark.range(2000).selectExpr("date_add(date'2019-06-01', cast(id % 1200 as int)) as trade_date", "concat('k', id) as k",
                                        "cast(id * 1.5 as double) as v", "if(id % 7 = 0, null, 'x') as a", "if(id % 7 = 0, 'x', null) as b")
    shuffled = base.orderBy(F.rand(3)).repartition(5)
    assert changed_years(base, shuffled).count() == 0 and same_rows_by_year(base, shuffled).count() == 0
    in_2020 = "year(trade_date) = 2020"
    cases = {
        "changed": base.withColumn("v", F.expr("if(k = 'k300', v + 1e-9, v)")),
        "repeated": base.union(base.where("k = 'k300'")),
        "missing": base.where("k <> 'k300'"),
        "swapped": base.withColumn("v", F.expr("case k when 'k300' then 451.5 when 'k301' then 450.0 else v end")),
        "null moved": base.withColumns({"a": F.expr("if(k = 'k301', b, a)"), "b": F.expr("if(k = 'k301', a, b)")}),
    }
    for name, other in cases.items():
        assert [r.year for r in changed_years(base, other).collect()] == [2020], name
        assert same_rows_by_year(base, other).count() > 0, name
        assert same_rows_by_year(base.where(f"not {in_2020}"), other.where(f"not {in_2020}")).count() == 0
    plan = fingerprint(base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count(1)" in plan and "SortMergeJoin" not in plan
