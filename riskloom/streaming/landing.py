"""Landing-folder stream: exchange files of several feeds and layouts -> upserted tables.

One Structured Streaming file source over the landing folder.  Each file is
read as text, and its own first line says what its columns are called, so files
of both exchange layouts, of other feeds and with columns in any order go through one
stream; a positional schema is laid over nothing.  ``Feed.needs`` (column names)
decides which feed a file belongs to; files of no feed are listed in the ``unmatched``
table.

Repeated rows (a file delivered twice, under any name) are dropped by
``dropDuplicatesWithinWatermark`` before the sink: the state holds a hash per row for
``remember`` after its arrival, by the clock of the stream, so no row is ever late.
What is left (corrections, the same contract in two files) is decided by the upsert:
arrival order within a batch, stored rows before new ones; with ``stored_first=False`` the
feed's ``order`` alone, so that the table does not depend on how files fall into batches.

Disk: a micro-batch takes at most ``BATCH_BYTES`` of files.  Its records are shuffled as text (the line
and the header line), stored once as compressed Parquet for all feeds, and deleted after the
upserts; shuffle files of a batch are released when the next one begins.  What grows with all that
has landed is the table and the state: 16 bytes of hash a record.

``trigger(availableNow=True)`` processes what has landed since the last checkpoint and
stops; files and hashes are in the checkpoint, so a re-run is a no-op and a restart
goes on where the last one stopped (hashes of checkpoints begun with 32 bytes are not
found again: for those records the upsert decides).  A file is one row until it is cut into lines: files
are as large as one trading day.  Quoted values may hold commas, not line breaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as _field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..session import release_shuffles, scratch_path
from .incremental import upsert_partitioned

_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
ARRIVAL = ["_file", "_row"]
UNMATCHED = "unmatched"
#: Hashes are kept on the executors' disks with bounded memory, not in their heaps (a checkpoint keeps the store it began with).
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.minBatchesToRetain": "2"}
#: Bytes of files (as they lie there, compressed or not) of a micro-batch; a larger file is a batch of its own.
BATCH_BYTES = 512 << 20


@dataclass(frozen=True)
class Feed:
    """Files whose header has all of ``needs``; ``transform`` types their records for the table at ``path``."""

    name: str
    needs: Sequence[str]
    transform: Callable[[DataFrame], DataFrame]
    path: str
    keys: Sequence[str]
    order: Sequence[str] = _field(default=tuple(ARRIVAL))
    keep: str = "first"
    date_col: str = "trade_date"
    stored_first: bool = True


def _cells(line: Column) -> Column:
    """Values of a CSV line: trimmed, without their quotes."""
    quoted = F.transform(F.split(line, _COMMA, -1), lambda x: F.replace(
        F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    plain = F.split(line, ",", -1)  # the pattern looks ahead to the line's end at every comma: for lines that need it
    return (F.when(F.contains(line, F.lit('"')), quoted)
            .when(F.contains(line, F.lit(" ")), F.transform(plain, lambda x: F.trim(x))).otherwise(plain))


def value_of(name: str) -> Column:
    """Value of the named column of a record; NULL where the file lacks it or it is empty."""
    at = F.array_position("_header", name).cast("int")
    return F.when(at > 0, F.nullif(F.trim(F.get("_cells", at - 1)), F.lit("")))


def named(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Records as text columns, whatever their order in the file, with their place of arrival."""
    return records.select(*[value_of(c).alias(c) for c in columns], *ARRIVAL)


def texts(files: DataFrame) -> DataFrame:
    """(_file, _head, _header, _lines) of whole-text files: header line as it is and in values, all lines."""
    split = F.split(F.regexp_replace("value", "^\\uFEFF", ""), "\r?\n")
    d = files.select(F.col("_metadata.file_path").alias("_file"), split.alias("_lines"))
    # the header is taken before the lines are dealt out: taken after it, every row would carry all lines of its file
    d = d.withColumn("_head", F.get("_lines", F.lit(0)))
    return d.withColumn("_header", _cells(F.col("_head")))


def lines(files: DataFrame) -> DataFrame:
    """(_row, _line) of ``texts`` with its other columns; empty lines and files without a row give nothing."""
    d = files.select(*[c for c in files.columns if c != "_lines"], F.posexplode("_lines").alias("_row", "_line"))
    return d.where("_row > 0 and trim(_line) <> ''").withColumn("_row", F.col("_row").cast("long"))


def cut(rows: DataFrame) -> DataFrame:
    """Records of lines: _header and _cells in place of _head and _line."""
    values = {"_head": _cells(F.col("_head")).alias("_header"), "_line": _cells(F.col("_line")).alias("_cells")}
    return rows.select(*[values.get(c, F.col(c)) for c in rows.columns])


def records(files: DataFrame) -> DataFrame:
    """(_file, _row, _header, _cells) of whole-text files; empty lines and files without a row give nothing."""
    return lines(texts(files)).select("_file", "_row", "_header", _cells(F.col("_line")).alias("_cells"))


def feed_of(feeds: Sequence[Feed]) -> Column:
    """Name of the first feed that the header fits, NULL if none."""
    out = F.lit(None).cast("string")
    for f in reversed(feeds):
        fits = F.size(F.array_except(F.array(*[F.lit(c) for c in f.needs]), "_header")) == 0
        out = F.when(fits, F.lit(f.name)).otherwise(out)
    return out


def landing_stream(spark: SparkSession, folder: str, feeds: Sequence[Feed], remember: str = "30 days",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines (_file, _row, _head, _line) of the landed files with their feed, each different record once."""
    r = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    r = r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r.option("maxBytesPerTrigger", BATCH_BYTES)
    d = lines(texts(r.load(folder)).withColumn("_feed", feed_of(feeds)))
    # the same record whatever the order of its columns
    pairs = F.array_sort(F.zip_with("_header", _cells(F.col("_line")), lambda h, c: F.concat_ws("=", h, c)))
    d = d.withColumns({"_hash": F.substring(F.unhex(F.sha2(F.to_json(pairs), 256)), 1, 16), "_arrived": F.current_timestamp()}).drop("_header")
    return d.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark(["_feed", "_hash"])


def run_feeds(spark: SparkSession, landing: str, feeds: Sequence[Feed], checkpoint: str, unmatched: str | None = None,
              remember: str = "30 days", max_files_per_trigger: int | None = None) -> dict[str, int]:
    """Process all landed files into the feeds' tables; returns the new records by feed."""
    seen: dict[str, int] = {}

    def sink(batch: DataFrame, epoch_id: int) -> None:
        release_shuffles(spark)
        path = scratch_path(spark, f"landing/{uuid.uuid4().hex}")
        batch = batch.drop("_hash", "_arrived")
        try:
            batch.write.option("compression", "zstd").parquet(path)  # read once per feed
            batch = cut(spark.read.schema(batch.schema).parquet(path))
            here = {r["_feed"] or UNMATCHED: r["count"] for r in batch.groupBy("_feed").count().collect()}
            for f in feeds:
                if f.name in here:
                    upsert_partitioned(spark, f.transform(batch.where(F.col("_feed") == f.name)), f.path, f.keys, f.order, f.keep,
                                       f.date_col, stored_first=f.stored_first)
            if unmatched and UNMATCHED in here:
                lost = batch.where("_feed is null").groupBy("_file").agg(F.first("_header").alias("header"), F.count(F.lit(1)).alias("rows"))
                lost.write.mode("overwrite").parquet(f"{unmatched}/epoch={epoch_id}")
            for name, n in here.items():
                seen[name] = seen.get(name, 0) + n
        finally:
            storage.delete(spark, path)

    stream = landing_stream(spark, landing, feeds, remember, max_files_per_trigger)
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return seen


def run_landing_to_table(spark: SparkSession, landing: str, columns: Sequence[str], table_path: str,
                         checkpoint: str, transform, keys: Sequence[str], order: Sequence[str],
                         keep: str = "first", date_col: str = "trade_date", stored_first: bool = True) -> int:
    """One feed: files that have ``columns`` (in any order) into ``table_path``; returns the new records."""
    feed = Feed("table", columns, lambda d: transform(named(d, columns)), table_path, keys, order, keep, date_col, stored_first)
    return run_feeds(spark, landing, [feed], checkpoint).get("table", 0)
