"""Sources: table folders, landed exchange CSV files, position files.

All readers take an explicit schema (no inference) and read every file of a
folder in one distributed scan.  Text is typed later with ``try_*`` casts,
so a malformed value becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..operators.clean import compute_dte, parse_date, snake_case, strip_percent
from ..schemas import POSITIONS

# ---------------------------------------------------------------------------
# Source column names of the two daily derivatives layouts.
# ---------------------------------------------------------------------------

LEGACY_RENAME = {
    "TradDt": "TIMESTAMP",
    "BizDt": "TIMESTAMP",
    "InstrmntType": "INSTRUMENT",
    "Symbl": "SYMBOL",
    "XpryDt": "EXPIRY_DT",
    "StrkPric": "STRIKE_PR",
    "OptnTyp": "OPTION_TYP",
    "OpnPric": "OPEN",
    "HghPric": "HIGH",
    "LwPric": "LOW",
    "ClsPric": "CLOSE",
    "SttlmPric": "SETTLE_PR",
    "TtlTradgVol": "CONTRACTS",
    "OpnIntrst": "OPEN_INT",
    "ChngInOpnIntrst": "CHG_IN_OI",
}

UDIFF_RENAME = {
    "FinInstrmId": "INSTRUMENT",
    "TckrSymb": "SYMBOL",
    "XpryDt": "EXPIRY_DT",
    "StrkPric": "STRIKE_PR",
    "OptnTp": "OPTION_TYP",
    "OpnPric": "OPEN",
    "HghPric": "HIGH",
    "LwPric": "LOW",
    "ClsPric": "CLOSE",
    "SttlmPric": "SETTLE_PR",
    "TtlTradgVol": "CONTRACTS",
    "OpnIntrst": "OPEN_INT",
    "ChngInOpnIntrst": "CHG_IN_OI",
}

# Standard ingest columns of the derivatives feed.
INGEST_COLUMNS = ["INSTRUMENT", "SYMBOL", "EXPIRY_DT", "STRIKE_PR", "OPTION_TYP", "OPEN", "HIGH", "LOW",
                  "CLOSE", "SETTLE_PR", "CONTRACTS", "OPEN_INT", "CHG_IN_OI", "TIMESTAMP"]

# Ingest -> processed names.
PROCESSED_RENAME = {
    "TIMESTAMP": "trade_date", "SYMBOL": "symbol", "EXPIRY_DT": "expiry_date", "STRIKE_PR": "strike",
    "OPTION_TYP": "option_type", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close",
    "SETTLE_PR": "settle", "CONTRACTS": "contracts", "OPEN_INT": "open_interest", "CHG_IN_OI": "chg_in_oi",
    "INSTRUMENT": "instrument",
}

# All-index close file: column names.
INDEX_CLOSE_COLUMNS = ["Index Name", "Index Date", "Open Index Value", "High Index Value",
                       "Low Index Value", "Closing Index Value"]

# Order of arrival within the landed files.
ARRIVAL = ["_file", "_block", "_row"]

# ---------------------------------------------------------------------------


def text_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def scan_parquet_glob(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Every parquet file under ``folder`` (any depth) as one DataFrame."""
    r = spark.read.option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(folder)


def discover_tables(spark: SparkSession, root: str, layer: str | None = None) -> dict[str, DataFrame]:
    """Folders (or ``name.parquet`` entries) under ``root`` -> view name -> DataFrame.

    View names are ``v_[layer_]snake_case``.  Only the folder listing runs on
    the driver, by Spark's own file system; the data stays distributed.  Empty folders are skipped; no
    table at all is an error.
    """
    out: dict[str, DataFrame] = {}
    for entry, path, folder in storage.children(spark, root):
        name = entry[:-len(".parquet")] if entry.endswith(".parquet") else entry
        if folder and not entry.endswith(".parquet"):
            if not storage.has_file(spark, path, ".parquet"):
                continue
        elif not entry.endswith(".parquet"):
            continue
        view = "v_" + (f"{layer}_" if layer else "") + snake_case(name)
        out[view] = scan_parquet_glob(spark, path)
    if not out:
        raise FileNotFoundError(f"no parquet tables under {root}")
    return out


def register_views(tables: dict[str, DataFrame]) -> list[str]:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def _read_csv(spark: SparkSession, path: str, cols, required=(), lower: bool = False) -> DataFrame:
    """Text columns of ``cols`` by the header name of *each file*, and ``ARRIVAL``.

    Spark binds one positional schema to all files it reads, so files are
    read in groups of equal header (read by the driver, one line per file).
    A column that a file lacks is NULL; one of ``required`` that it lacks is
    an error that names the file.  No type inference: everything is text.
    """
    out = None
    for header, files in storage.csv_headers(spark, path).items():
        names = [h.strip().lower() if lower else h.strip() for h in header]
        lack = [c for c in required if c not in names]
        if lack:
            raise ValueError(f"{files[0]}: missing columns {lack}")
        at = {n: i for i, n in reversed(list(enumerate(names)))}
        d = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(
            text_schema(f"_c{i}" for i in range(len(names)))).csv(files)
        d = d.select(*[F.col(f"_c{at[c]}").alias(c) if c in at else F.lit(None).cast("string").alias(c) for c in cols],
                     F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], text_schema(cols)).withColumns(
            {"_file": F.lit(""), "_block": F.lit(0).cast("bigint"), "_row": F.lit(0).cast("bigint")})
    return out


def standardise_bhav(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Renamed raw layout -> ingest columns (missing ones NULL), header trimmed."""
    df = df.toDF(*[c.strip() for c in df.columns])
    # several source names may map to one column: the first that has a value
    src: dict[str, list[str]] = {}
    for c in df.columns:
        src.setdefault(rename.get(c, c), []).append(c)
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    return df.select(*[F.coalesce(*[value(s) for s in src[c]]).alias(c) if c in src
                       else F.lit(None).cast("string").alias(c) for c in INGEST_COLUMNS],
                     *[c for c in ARRIVAL if c in df.columns])


def read_bhavcopy_legacy(spark: SparkSession, path: str) -> DataFrame:
    cols = list(dict.fromkeys(LEGACY_RENAME))
    return standardise_bhav(_read_csv(spark, path, cols), LEGACY_RENAME)


def read_bhavcopy_udiff(spark: SparkSession, path: str) -> DataFrame:
    cols = list(UDIFF_RENAME) + ["TradDt"]
    rn = dict(UDIFF_RENAME, TradDt="TIMESTAMP")
    return standardise_bhav(_read_csv(spark, path, cols), rn)


def read_bhavcopy(spark: SparkSession, legacy_path: str | None, udiff_path: str | None) -> DataFrame:
    """Both layouts as one ingest frame (``unionByName``)."""
    parts = []
    if legacy_path:
        parts.append(read_bhavcopy_legacy(spark, legacy_path))
    if udiff_path:
        parts.append(read_bhavcopy_udiff(spark, udiff_path))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def type_bhav(ingest: DataFrame) -> DataFrame:
    """Ingest text -> typed processed-layer columns (instrument and arrival kept)."""
    d = ingest.withColumnsRenamed(PROCESSED_RENAME)
    strike = F.coalesce(F.col("strike").try_cast("double"), F.lit(0.0))
    return d.select(
        parse_date("trade_date").alias("trade_date"), F.trim("symbol").alias("symbol"),
        parse_date("expiry_date").alias("expiry_date"), strike.alias("strike"),
        F.upper(F.trim("option_type")).alias("option_type"),
        *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "settle")],
        *[F.col(c).try_cast("bigint").alias(c) for c in ("contracts", "open_interest", "chg_in_oi")],
        F.when(strike == 0.0, "FUTIDX").otherwise("OPTIDX").alias("instrument"),
        *[c for c in ARRIVAL if c in ingest.columns],
    ).withColumn("dte", compute_dte())


def read_index_close_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One scan of the all-index close files -> (spot rows, vix rows)."""
    raw = _read_csv(spark, path, INDEX_CLOSE_COLUMNS)
    from ..dims import SYMBOL_ALIASES, VIX_INDEX_NAME
    spot = raw.filter(F.col("`Index Name`").isin(list(SYMBOL_ALIASES))).select(
        parse_date("`Index Date`").alias("Date"), F.col("`Index Name`").alias("Index"),
        F.col("`Open Index Value`").try_cast("double").alias("Open"),
        F.col("`High Index Value`").try_cast("double").alias("High"),
        F.col("`Low Index Value`").try_cast("double").alias("Low"),
        F.col("`Closing Index Value`").try_cast("double").alias("Close"), *ARRIVAL)
    vix = raw.filter(F.col("`Index Name`") == VIX_INDEX_NAME).select(
        parse_date("`Index Date`").alias("Date"),
        F.col("`Closing Index Value`").try_cast("double").alias("VIX_Close"), *ARRIVAL)
    return spot, vix


def read_tenor_csvs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One CSV folder per tenor: ``paths`` maps the tenor to its folder.

    Headers are trimmed and lower-cased; ``date`` is dd-MM-yyyy;
    ``change %`` loses its ``%`` and thousands separators.
    """
    cols = ["date", "price", "open", "high", "low", "change %"]
    out = None
    for tenor, path in paths.items():
        d = _read_csv(spark, path, cols, lower=True)
        d = d.select(
            F.try_to_date(F.trim("date"), "dd-MM-yyyy").alias("date"),
            *[F.col(c).try_cast("double").alias(c) for c in ("price", "open", "high", "low")],
            strip_percent("change %").alias("change_pct"), F.lit(tenor).alias("tenor"), *ARRIVAL)
        out = d if out is None else out.unionByName(d)
    return out


def read_index_yield_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dividend-yield files: trade_date, symbol, div_yield (percent text allowed)."""
    d = _read_csv(spark, path, ["trade_date", "symbol", "div_yield"], required=["trade_date", "symbol", "div_yield"])
    return d.select(parse_date("trade_date").alias("trade_date"), "symbol", strip_percent("div_yield").alias("div_yield"), *ARRIVAL)


def read_lot_size_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lot-size schedule: symbol, start_date, end_date (blank = open), lot_size."""
    cols = ["symbol", "start_date", "end_date", "lot_size"]
    d = _read_csv(spark, path, cols, required=cols)
    return d.select("symbol", parse_date("start_date").alias("start_date"), parse_date("end_date").alias("end_date"),
                    F.trim("lot_size").try_cast("int").alias("lot_size"), *ARRIVAL)


def read_positions_text(spark: SparkSession, path: str, schema: T.StructType = POSITIONS) -> DataFrame:
    """Portfolio file as text, columns by header name; a missing one is an error."""
    return _read_csv(spark, path, schema.fieldNames(), required=schema.fieldNames())


def _typed(f: T.StructField):
    text = F.nullif(F.trim(F.col(f.name)), F.lit(""))
    if isinstance(f.dataType, T.DateType):
        return parse_date(text)
    return text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType.simpleString())


def read_positions_csv(spark: SparkSession, path: str, schema: T.StructType = POSITIONS) -> DataFrame:
    """Portfolio file, typed (bad values -> NULL, row kept; see ``position_parse_errors``)."""
    return read_positions_text(spark, path, schema).select(*[_typed(f).alias(f.name) for f in schema])


def position_parse_errors(text: DataFrame, schema: T.StructType = POSITIONS) -> DataFrame:
    """(row columns, field, value) of every value that cannot be read as its type."""
    bad = F.array(*[F.when(F.nullif(F.trim(F.col(f.name)), F.lit("")).isNotNull() & _typed(f).isNull(),
                           F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("value"))) for f in schema])
    return text.select(*schema.fieldNames(), F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("_b")).select(
        *schema.fieldNames(), "_b.*")
