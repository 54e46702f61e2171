"""Incremental maintenance of year-partitioned tables.

* ``hwm``: per-year high-water mark of what is stored; only strictly later
  rows are new (source-system parity; late rows are dropped).
* ``late_rows``: rows whose key is not stored, or is stored with other
  values, wherever their date lies; ``late="upsert"`` in the daily job.

Marks and touched years are one row per calendar year, so broadcasting them
is bounded by the calendar, not by the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.dedupe import dedupe
from ..sources.writers import write_year_partitioned


def high_water_marks(existing: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """(year, hwm): latest stored date per year, by the partition column where there is one."""
    year = F.col("year") if "year" in existing.columns else F.year(date_col).alias("year")
    return existing.groupBy(year).agg(F.max(date_col).alias("hwm"))


def _after(new: DataFrame, marks: DataFrame, date_col: str) -> DataFrame:
    m = marks.select(F.col("year").alias("_year"), "hwm")
    j = new.withColumn("_new_year", F.year(date_col)).join(F.broadcast(m), F.col("_new_year") == F.col("_year"), "left")
    return j.filter(F.col("hwm").isNull() | (F.col(date_col) > F.col("hwm"))).drop("_new_year", "_year", "hwm")


def incremental_hwm(new: DataFrame, existing: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Rows of ``new`` strictly after the stored high-water mark of their year
    (years with nothing stored pass entirely)."""
    return _after(new, high_water_marks(existing, date_col), date_col)


def incremental_hwm_min2(new: DataFrame, existing_a: DataFrame, existing_b: DataFrame,
                         date_col: str = "trade_date") -> DataFrame:
    """Two tables fed by one source (options and futures): the mark is the
    *smaller* of their marks (NULL-skipping), so the laggard catches up."""
    a = high_water_marks(existing_a, date_col).withColumnRenamed("hwm", "hwm_a")
    b = high_water_marks(existing_b, date_col).withColumnRenamed("hwm", "hwm_b")
    return _after(new, a.join(b, "year", "full").select("year", F.least("hwm_a", "hwm_b").alias("hwm")), date_col)


def incremental_by_key(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet (left-anti)."""
    return candidates.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def late_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``new`` that are not stored with the same key and ``columns``
    (default: all columns both sides have): late arrivals and corrections."""
    cols = list(columns or [c for c in new.columns if c in existing.columns])
    both = list(dict.fromkeys([*keys, *cols]))
    e = existing.select(*[F.col(c).alias(f"_e_{c}") for c in both]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in both]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return new.join(e, cond, "left_anti")


def upsert_partitioned(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str],
                       order: Sequence[str] = (), keep: str = "first", date_col: str = "trade_date",
                       existing_exists: bool | None = None, check=None, stored_first: bool = True) -> None:
    """Merge ``batch`` into the year-partitioned table at ``path``.

    Only the years present in the batch are read back, merged and
    overwritten (dynamic partition overwrite, set on this write alone).
    Arrival order is stored rows first, then the batch (then ``order`` within
    each): keep-first lets stored rows win, keep-last lets the batch correct
    them; with ``stored_first=False`` ``order`` (columns of the table) decides before that.  The merged years are first written to a staging folder of this
    call's own, so the overwrite never reads the files it replaces and never
    sees years of another batch; a failed call, or a ``check`` that raises on the
    staged rows, leaves the table as it was.
    """
    stage = f"{path.rstrip('/')}__staging/{uuid.uuid4().hex}"
    have = storage.has_data(spark, path) if existing_exists is None else existing_exists
    batch = batch.withColumn("year", F.year(date_col)).withColumn("_arrival", F.lit(1))
    if have:
        stored = spark.read.parquet(path)
        years = batch.select(F.col("year").cast(dict(stored.dtypes)["year"]).alias("year")).distinct()
        stored = stored.join(F.broadcast(years), "year", "left_semi").withColumn("_arrival", F.lit(0))
        merged = stored.unionByName(batch, allowMissingColumns=True)
    else:
        merged = batch
    merged = dedupe(merged, list(keys), ["_arrival", *order] if stored_first else [*order, "_arrival"], keep).drop("year", "_arrival")
    try:
        # de-duplication has just dealt the rows out by key
        write_year_partitioned(merged, stage, list(keys), date_col, mode="error", rebalance=False)
        if storage.has_data(spark, stage):  # an empty batch changes nothing
            staged = spark.read.parquet(stage).drop("year")
            if check:
                check(staged)
            write_year_partitioned(staged, path, list(keys), date_col, replace="years", rebalance=False)  # staged balanced
    finally:
        storage.delete(spark, stage)


def rebuild_full(build, path: str, keys: Sequence[str], date_col: str = "trade_date", check=None) -> None:
    """Recompute everything from raw and replace the table.

    The new table is written aside, given to ``check`` (which may raise) and
    swapped in by renaming, so a failed build leaves the old one in place.
    """
    df = build()
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}__rebuild-{mark}", f"{path.rstrip('/')}__old-{mark}"
    try:
        write_year_partitioned(df, fresh, list(keys), date_col, mode="error")
        if check:
            check(spark.read.parquet(fresh))
    except Exception:
        storage.delete(spark, fresh)
        raise
    had = storage.exists(spark, path)
    if had:
        storage.rename(spark, path, old)
    try:
        storage.rename(spark, fresh, path)
    except Exception:
        if had:
            storage.rename(spark, old, path)
        raise
    if had:
        storage.delete(spark, old)
    spark.catalog.refreshByPath(path)


def fingerprint(df: DataFrame, by: str = "year", date_col: str = "trade_date") -> DataFrame:
    """(by, n, f1, f2): per year the number of rows and two sums of row hashes.

    Independent of order, sensitive to repeated, changed and swapped values (NULLs are
    hashed with their place).  Only one number per task and year is shuffled.
    """
    cols = sorted(c for c in df.columns if c != by)
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    year = F.col(by) if by in df.columns else F.year(date_col).alias(by)
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n"), wide(F.xxhash64(*parts)).alias("f1"),
                                wide(F.xxhash64(F.lit("second"), *parts)).alias("f2"))


def changed_years(a: DataFrame, b: DataFrame, by: str = "year", date_col: str = "trade_date") -> DataFrame:
    """(by): the years whose rows differ between two tables, by their fingerprints."""
    x = fingerprint(a, by, date_col)
    y = fingerprint(b, by, date_col).toDF("_by", "_n", "_f1", "_f2")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("f1").eqNullSafe(F.col("_f1")) & F.col("f2").eqNullSafe(F.col("_f2"))
    return x.join(y, F.col(by).eqNullSafe(F.col("_by")), "full").where(~same).select(F.coalesce(by, "_by").alias(by))


def same_rows_by_year(a: DataFrame, b: DataFrame, by: str = "year", date_col: str = "trade_date") -> DataFrame:
    """``same_rows`` of two tables, reading row by row only the years whose fingerprints differ."""
    years = changed_years(a, b, by, date_col).withColumnRenamed(by, "_changed")
    of = lambda d: d.join(F.broadcast(years), (F.col(by) if by in d.columns else F.year(date_col)).eqNullSafe(F.col("_changed")), "left_semi")
    return same_rows(of(a), of(b))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in ``a`` not in ``b`` and vice versa (multiset); empty = identical."""
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).withColumn("_side", F.lit("left_only")).unionByName(
        b.exceptAll(a).withColumn("_side", F.lit("right_only")))
