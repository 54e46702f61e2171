"""Rows of 64-bit numbers dealt to buckets as packed arrays.

A map task sorts its rows by bucket and emits one binary per bucket; Spark
shuffles the binaries, and a reduce task reads one bucket's rows as one numpy
array.  This costs a fraction of shuffling the rows one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, kind int, data binary"
_NAMES = ["bucket", "kind", "data"]
BUCKET_BYTES = 12 << 20


def buckets_for(docs: DataFrame, text_col: str, share: float) -> int:
    """Buckets so that each holds about ``BUCKET_BYTES`` if all hold ``share`` times the text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, int(total * share / BUCKET_BYTES) + 1)


def parts(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows in it) of the buckets that have rows."""
    order = np.argsort(bucket.astype(np.uint16) if n < 1 << 16 else bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(edge[1:] > edge[:-1]):
        yield int(k), order[edge[k]:edge[k + 1]]


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], _NAMES)


def by_kind(t: pa.Table) -> dict[int, list]:
    """Buffers of one bucket by kind."""
    out: dict[int, list] = {}
    for k, d in zip(t["kind"].to_pylist(), t["data"].to_pylist()):
        out.setdefault(k, []).append(d)
    return out
