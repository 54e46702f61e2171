"""The training-data pipeline: five text operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's input, so a lost executor or
driver costs one stage.  All but the last return the columns of ``documents``.

* language ID: documents without a letter, which no language fits, go;
  ``lang`` becomes the predicted language;
* line dedup: lines that an earlier line of the corpus repeats go; documents
  with nothing left go;
* near-duplicates: the first document of each group stays;
* decontamination: documents that hold a benchmark item go;
* packing: one row per piece of a document, with its bin.

``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, lang_ppm, line_dedup, minhash, packing
from riskloom.llm.columns import table
from riskloom.llm.shared import written


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = lang_ppm.language_id(docs, docs.where(~held)).where(F.col("lang_pred") != lang_ppm.UNDETERMINED)
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs)
    left = out.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _counted(left, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drop = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.col("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")))  # documents without id go by their text
    keyed = docs.select(key.alias("key"), "text")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    hit = written(found.select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, key == F.col("_hit"), "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, MinHash banding and best-fit packing are not SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
