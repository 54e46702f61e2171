"""Sinks: year-partitioned tables, single-file dimensions, CSV export, run manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_year_partitioned(df: DataFrame, path: str, keys: list[str], date_col: str = "trade_date",
                           mode: str = "overwrite", replace: str = "table", rebalance: bool = True) -> None:
    """Write ``df`` partitioned by ``year`` (from ``date_col``), rows sorted by key.

    ``REBALANCE(year)`` lets AQE size the write tasks: a big year is split
    over several tasks (a plain hash on year would give one task per year)
    and small ones are merged.  Unlike ``repartitionByRange`` it needs no
    sampling pass, which would evaluate the whole upstream plan (for the
    curated chain: the IV solve) a second time.  Each file is sorted by
    date and key, so Parquet row-group statistics prune on ``trade_date``.
    ``mode="overwrite"`` replaces the whole table, or with ``replace="years"``
    only the years present in ``df``; the choice is made on this write, the
    session's setting is left alone.
    ``rebalance=False`` writes the rows from the tasks that hold them: for rows
    already dealt out by key or read from a balanced table, another shuffle would
    only move them again.
    """
    how = "dynamic" if replace == "years" else "static"
    d = df.withColumn("year", F.year(date_col))
    d = d.hint("rebalance", "year") if rebalance else d
    (d.sortWithinPartitions("year", *[k for k in ([date_col] + list(keys)) if k != "year"])
     .write.mode(mode).option("partitionOverwriteMode", how).partitionBy("year").parquet(path))


def strike_key(col: str = "strike"):
    """Strike in hundredths as BIGINT: a join/bucket key without the float
    normalisation Spark applies to DOUBLE keys (which defeats bucketing)."""
    return F.round(F.col(col) * 100.0).cast("bigint")


def write_bucketed_year_table(df: DataFrame, name: str, path: str, keys: list[str], buckets: int,
                              date_col: str = "trade_date") -> None:
    """Year-partitioned table bucketed (and sorted) on ``keys``, registered in
    the session catalog under ``name`` with its files at ``path``.  Joins on
    exactly ``keys`` then shuffle only the other side."""
    # hash-partition on the bucket key with the bucket count first: each task
    # then holds exactly one bucket and writes one file per year (without it
    # every task writes a file for every (year, bucket) pair)
    d = df.withColumn("year", F.year(date_col)).repartition(buckets, *keys)
    (d.write.mode("overwrite").partitionBy("year").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))


def ensure_bucketed_table(spark, name: str, path: str, schema, keys: list[str], buckets: int) -> None:
    """Re-register a bucketed table written by an earlier context (the bucket
    layout lives in the catalog, not in the files)."""
    if spark.catalog.tableExists(name):
        return
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet PARTITIONED BY (year) "
              f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_single_table(df: DataFrame, path: str) -> None:
    """Small dimension (tens of rows) as one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    d = df.coalesce(1) if single_file else df
    d.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def run_manifest(summary: DataFrame, params: dict) -> DataFrame:
    """One JSON line per summary row: the parameters of the run + the row."""
    p = F.struct(*[F.lit(v).alias(k) for k, v in params.items()])
    return summary.select(F.to_json(F.struct(p.alias("params"), F.struct(*summary.columns).alias("summary")))
                          .alias("value"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("append").text(path)
