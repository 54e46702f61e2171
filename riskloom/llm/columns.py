"""Small Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever ``body`` does with it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; empty for null or blank text."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_RUN)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed(df: DataFrame, *cols: Column | str) -> DataFrame:
    """``df.select(*cols)`` whose values are computed once per row.

    The values pass through a generator, so the optimizer cannot copy their
    expressions into later filters and projections.
    """
    return df.select(F.inline(F.array(F.struct(*cols))))
