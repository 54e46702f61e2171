"""Validation, audits and data-quality reports.

Validators return *violation DataFrames* (one row per broken rule and row)
instead of raising on the first bad value, so a 100 TB table is checked in
one distributed pass; ``fail_fast`` turns a non-empty report into an error
with a bounded sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import POSITION_TYPES, SYMBOLS, TENOR_DAYS


class ValidationError(ValueError):
    pass


def validate_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Plan-time check: required columns are present."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValidationError(f"missing columns: {missing}")


def null_key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: count of NULLs per key column (single aggregate pass)."""
    return df.agg(*[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys])


def validate_schema(df: DataFrame, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Columns at plan time; NULL keys reported as (rule, n) rows."""
    validate_columns(df, required)
    counts = null_key_counts(df, keys)
    stack = F.inline(F.array(*[F.struct(F.lit(f"null_{k}").alias("rule"), F.col(f"null_{k}").alias("n"))
                               for k in keys]))
    return counts.select(stack)


def fail_fast(violations: DataFrame, sample: int = 20) -> None:
    """Raise if the violation report has any rows (shows a bounded sample)."""
    rows = violations.limit(sample).collect()
    if rows:
        raise ValidationError(f"{len(rows)}+ violations, e.g. {rows[:5]}")


def _violations(df: DataFrame, rules: dict[str, object], keep: Sequence[str]) -> DataFrame:
    arr = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(*keep, F.explode(arr).alias("rule"))


def validate_positions(positions: DataFrame, keep: Sequence[str] = ("portfolio_id",),
                       strict: bool = False) -> DataFrame:
    """(row keys, rule) for every broken position rule.

    Base rules: unknown symbol, unknown option type, quantity 0, entry price
    <= 0.  ``strict`` adds the entry-form rules: NULLs per column, negative
    strike, zero strike on an option, unparseable dates.
    """
    validate_columns(positions, ["symbol", "expiry_date", "strike", "option_type", "quantity",
                                 "entry_date", "entry_price"])
    sym = F.upper(F.trim("symbol"))
    typ = F.upper(F.trim("option_type"))
    rules = {
        "unknown_symbol": ~F.coalesce(sym.isin(SYMBOLS), F.lit(False)),
        "unknown_option_type": ~F.coalesce(typ.isin(POSITION_TYPES), F.lit(False)),
        "zero_quantity": F.coalesce(F.col("quantity") == 0, F.lit(False)),
        "non_positive_entry_price": F.coalesce(F.col("entry_price") <= 0, F.lit(False)),
    }
    if strict:
        for c in ["symbol", "expiry_date", "strike", "option_type", "quantity", "entry_date", "entry_price"]:
            rules[f"null_{c}"] = F.col(c).isNull()
        rules["negative_strike"] = F.coalesce(F.col("strike") < 0, F.lit(False))
        rules["option_zero_strike"] = F.coalesce(typ.isin("CE", "PE") & (F.col("strike") == 0), F.lit(False))
        rules["expiry_before_entry"] = F.coalesce(F.col("expiry_date") < F.col("entry_date"), F.lit(False))
    keep = [c for c in keep if c in positions.columns] + [
        c for c in ("symbol", "expiry_date", "strike", "option_type", "quantity") if c not in keep]
    return _violations(positions, rules, keep)


def validate_tenor_domain(gbond: DataFrame, threshold: float = 15.0) -> DataFrame:
    """Bond rows with a tenor outside 3m/6m/1y, or a yield still above 15."""
    rules = {
        "bad_tenor": ~F.coalesce(F.col("tenor").isin(list(TENOR_DAYS)), F.lit(False)),
        "yield_above_threshold": F.coalesce(F.col("yield_pct") > threshold, F.lit(False)),
    }
    return _violations(gbond, rules, ["trade_date", "tenor", "yield_pct"])


def validate_request(requests: DataFrame, min_lookback: int = 10, max_lookback: int = 1260) -> DataFrame:
    """Request-table rules: expiry >= trade date, lookback range, known symbol."""
    rules = {
        "expiry_before_trade_date": F.coalesce(F.col("expiry_date") < F.col("trade_date"), F.lit(False)),
        "lookback_out_of_range": ~F.coalesce(F.col("lookback").between(min_lookback, max_lookback), F.lit(False)),
        "unknown_symbol": ~F.coalesce(F.col("symbol").isin(SYMBOLS), F.lit(False)),
    }
    return _violations(requests, rules, list(requests.columns))


def unknown_symbols(df: DataFrame, universe: Sequence[str] = SYMBOLS, year_col: str = "trade_date") -> DataFrame:
    """Per year: sorted set of symbols outside the universe."""
    return (df.filter(~F.col("symbol").isin(list(universe)))
            .groupBy(F.year(year_col).alias("year"))
            .agg(F.array_sort(F.collect_set("symbol")).alias("unknown_symbols")))


def audit_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def audit_zeros(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in cols])


FEED_COLUMNS = ("CLOSE", "SETTLE_PR", "EXPIRY_DT", "STRIKE_PR", "OPTION_TYP")


def audit_feed(ingest: DataFrame) -> DataFrame:
    """NULL counts of the feed's key columns and zero closes, on the ingest text."""
    return ingest.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in FEED_COLUMNS],
                      F.count_if(F.col("CLOSE").try_cast("double") == 0).alias("zero_close"))


def audit_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def lot_size_gaps(lots: DataFrame) -> DataFrame:
    """Per symbol: next period not starting the day after this one ends, or an
    open-ended period that is not the last.  Window over a config-sized table."""
    w = Window.partitionBy("symbol").orderBy("start_date")
    d = lots.withColumn("next_start", F.lead("start_date").over(w))
    gap = F.col("end_date").isNotNull() & F.col("next_start").isNotNull() & (
        F.col("next_start") != F.date_add("end_date", 1))
    open_mid = F.col("end_date").isNull() & F.col("next_start").isNotNull()
    return d.withColumn("issue", F.when(gap, "gap").when(open_mid, "open_end_not_last")).filter(
        F.col("issue").isNotNull()).select("symbol", "start_date", "end_date", "next_start", "issue")


def lot_size_overlaps(lots: DataFrame) -> DataFrame:
    """Periods starting on/before the previous end, or ending before they start."""
    w = Window.partitionBy("symbol").orderBy("start_date")
    d = lots.withColumn("prev_end", F.lag("end_date").over(w)).withColumn(
        "prev_start", F.lag("start_date").over(w))
    overlap = F.col("prev_start").isNotNull() & (F.col("prev_end").isNull() | (F.col("start_date") <= F.col("prev_end")))
    inverted = F.col("end_date").isNotNull() & (F.col("end_date") < F.col("start_date"))
    return d.withColumn("issue", F.when(inverted, "end_before_start").when(overlap, "overlap")).filter(
        F.col("issue").isNotNull()).select("symbol", "start_date", "end_date", "prev_end", "issue")


def run_counts(df: DataFrame, name: str, cols: Sequence[str] = ()) -> DataFrame:
    """Attach row / NULL counters computed in the same pass as the sink.

    Read them after the action with ``observation.get`` (``Observation``).
    """
    from pyspark.sql import Observation

    obs = Observation(name)
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                     *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
    out._riskloom_observation = obs  # type: ignore[attr-defined]
    return out


def counters(df: DataFrame) -> DataFrame:
    """The counters of a ``run_counts`` frame as a one-row table (dataset, counter columns);
    call it after the action."""
    obs = df._riskloom_observation  # type: ignore[attr-defined]
    got = obs.get
    cols = ", ".join(f"`{k}` bigint" for k in got)
    return df.sparkSession.createDataFrame([(obs._name, *got.values())], f"dataset string, {cols}")
