"""Projection, cleaning and normalisation operators (all Column-level).

ANSI mode is on in Spark 4, so every coercion of untrusted text uses the
``try_*`` family: bad input becomes NULL instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import PAR_PRICE_THRESHOLD, TENOR_DAYS


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def clean_headers(df: DataFrame, case: str = "keep") -> DataFrame:
    """Strip header names; optionally upper/lower-case them."""
    def fix(c: str) -> str:
        c = c.strip()
        return c.upper() if case == "upper" else c.lower() if case == "lower" else c
    return df.toDF(*[fix(c) for c in df.columns])


def snake_case(name: str) -> str:
    """CamelCase / spaced folder name -> snake_case view name."""
    s = re.sub(r"[\s\-]+", "_", name.strip())
    s = re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", s)
    return s.lower()


def reindex_columns(df: DataFrame, columns: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Project to a canonical column list; absent columns become typed NULLs."""
    types = types or {}
    return df.select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c)
            for c in columns
        ]
    )


def parse_date(c: Column | str, formats: Iterable[str] = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy")) -> Column:
    """Mixed-format date text -> DATE; unparseable -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])


def parse_dates(df: DataFrame, cols: Sequence[str], formats=("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy")) -> DataFrame:
    return df.withColumns({c: parse_date(c, formats) for c in cols})


def cast_nullable_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in cols})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-numeric text (e.g. '-') -> NULL double."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def strike_coerce_zero(c: str = "strike") -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def strip_percent(c: str) -> Column:
    """'1,234.5%' -> 1234.5"""
    return F.regexp_replace(F.col(c).cast("string"), "[%,]", "").try_cast("double")


def classify_instrument(strike: str = "strike") -> Column:
    """strike == 0 -> FUTIDX, else OPTIDX (overrides the source label)."""
    return F.when(F.col(strike) == 0.0, F.lit("FUTIDX")).otherwise(F.lit("OPTIDX"))


def trim_upper(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.upper(F.trim(F.col(c))) for c in cols})


def normalise_symbol(df: DataFrame, aliases: DataFrame, col: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Map source spellings to internal symbols.

    ``aliases`` is the fixed alias dimension (a dozen rows), so it is
    broadcast.  Returns (mapped rows, rejected rows) — rejects via left-anti.
    """
    a = F.broadcast(aliases.withColumnRenamed("symbol", "_sym").withColumnRenamed("alias", col))
    mapped = df.join(a, col, "inner").withColumn(col, F.col("_sym")).drop("_sym")
    rejected = df.join(a.select(col), col, "left_anti")
    return mapped.select(*df.columns), rejected


def fill_null_yield(df: DataFrame, col: str = "div_yield") -> DataFrame:
    """NULL dividend yield -> 0.0, keeping a flag of what was filled."""
    return df.withColumns(
        {f"{col}_filled": F.col(col).isNull(), col: F.coalesce(F.col(col), F.lit(0.0))}
    )


def fill_null_report(df: DataFrame, col: str = "div_yield") -> DataFrame:
    """Count, symbols and date range of the rows that were filled."""
    return df.filter(F.col(col).isNull()).agg(
        F.count(F.lit(1)).alias("filled_rows"),
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
    )


def par_price_to_yield(df: DataFrame, value_cols=("yield_pct", "open", "high", "low")) -> DataFrame:
    """Bond rows whose ``yield_pct`` exceeds 15 carry par prices: convert
    every value column of such rows to an annualised yield in percent.

    The tenor -> days map is a fixed three-entry literal (no join).
    """
    days = F.create_map(*[x for t, d in TENOR_DAYS.items() for x in (F.lit(t), F.lit(float(d)))])
    is_par = F.col("yield_pct") > PAR_PRICE_THRESHOLD
    conv = {
        c: F.when(is_par, ((F.lit(100.0) - F.col(c)) / 100.0) * (F.lit(365.0) / days[F.col("tenor")]) * 100.0)
        .otherwise(F.col(c))
        for c in value_cols
        if c in df.columns
    }
    return df.withColumn("was_par_price", is_par).withColumns(conv)


def compute_dte(expiry: str = "expiry_date", trade: str = "trade_date") -> Column:
    return F.datediff(F.col(expiry), F.col(trade))


def split_instruments(df: DataFrame, col: str = "instrument") -> tuple[DataFrame, DataFrame]:
    """(options, futures) branches of one parent plan."""
    return df.filter(F.col(col) == "OPTIDX"), df.filter(F.col(col) == "FUTIDX")


def extract_year(col: str = "trade_date") -> Column:
    return F.year(F.col(col))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)
