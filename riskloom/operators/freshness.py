"""Cross-layer freshness: latest date per dataset, expected date, sync report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import parse_date

DATE_COLUMN_CANDIDATES = ["TIMESTAMP", "Date", "DATE", "date", "trade_date"]


def dataset_latest(layer: str, name: str, df: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(layer, dataset, latest_date) for one dataset; reads only the date column.

    The date column is the first of TIMESTAMP/Date/DATE/date/trade_date that
    exists; text dates are parsed; a dataset without one, or a missing dataset
    (None), gives NULL.
    """
    col = next((c for c in DATE_COLUMN_CANDIDATES if df is not None and c in df.columns), None)
    if col is None:
        return spark.createDataFrame([(layer, name, None)], "layer string, dataset string, latest_date date")
    d = df.select(parse_date(F.col(col)) if dict(df.dtypes)[col] == "string" else F.to_date(F.col(col)))
    return d.agg(F.max(d.columns[0]).alias("latest_date")).select(
        F.lit(layer).alias("layer"), F.lit(name).alias("dataset"), "latest_date")


def latest_by_dataset(datasets: Mapping[tuple[str, str], DataFrame | None]) -> DataFrame:
    """Union of per-dataset max dates.  Each is a tiny aggregate; the union is
    one job whose width is the number of datasets, not their size."""
    spark = SparkSession.getActiveSession()
    parts = [dataset_latest(layer, name, df, spark) for (layer, name), df in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sync_report(latest: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """IN SYNC / OUT OF SYNC / NO DATA per dataset against the expected date.

    expected = max latest over all datasets (clamped to ``date_to``);
    a dataset whose latest is before ``date_from`` counts as NO DATA.
    """
    d = latest
    if date_from is not None:
        d = d.withColumn("latest_date", F.when(F.col("latest_date") >= F.lit(date_from).cast("date"),
                                                F.col("latest_date")))
    w = Window.partitionBy()
    exp = F.max("latest_date").over(w)
    if date_to is not None:
        exp = F.least(exp, F.lit(date_to).cast("date"))
    d = d.withColumn("expected_date", exp)
    status = (F.when(F.col("latest_date").isNull(), "NO DATA")
              .when(F.col("latest_date") >= F.col("expected_date"), "IN SYNC").otherwise("OUT OF SYNC"))
    return d.withColumn("status", status).withColumn(
        "days_behind", F.datediff(F.col("expected_date"), F.col("latest_date")))
