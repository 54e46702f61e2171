"""Written intermediates in the shared folder: cut lineage, survive lost executors."""

from __future__ import annotations

import gc
import importlib.util
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root

_PACKAGE = "riskloom"
_runs: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{checkpoint_root(spark)}/llm-{app}-{uuid.uuid4().hex[:8]}"
    return _runs[app]


BATCH_BYTES = 8 << 20


_importable: set[str] = set()


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"ok": [importlib.util.find_spec(_PACKAGE) is not None] * len(b)})


def ship_package(spark: SparkSession) -> None:
    """Send the package to executors whose Python cannot import it (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _importable:
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        ok = spark.range(1).mapInPandas(_probe, "ok boolean").first()[0]
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    if not ok:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="riskloom-code-"), "riskloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "riskloom")):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
        spark.sparkContext.addPyFile(path)
    _importable.add(app)


def text_batches(spark: SparkSession) -> SparkSession:
    """Make tasks ready for texts: the package importable, and Arrow batches
    bounded by bytes (the default bounds rows, and thousands of long texts at
    once are more than a Python worker should hold)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again.

    The path is new on every call, so results of concurrent or repeated
    queries never overwrite each other.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession, *dfs: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, and shuffle files without a reader."""
    jvm = spark._jvm
    for df in dfs:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    jvm.System.gc()
