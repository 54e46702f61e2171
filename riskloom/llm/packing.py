"""Conflict-constrained best-fit packing of documents into training sequences.

Documents (cut into pieces of ``capacity`` words where longer) go, largest
first, into the open bin with the least sufficient room that holds neither the
piece's source nor its duplicate cluster.  Open bins lie in residual order, each
with a 64-bit source bitmap and a 64-bit cluster bitmap; the search starts at
the successor of the piece's size and goes on until the tightest compatible
bin.  A clear bit proves compatibility; bits that several values share are
settled by the bin's own sets, so the result equals an exhaustive search.

Rows are dealt to shards of about ``shard_docs`` documents by a hash of the id
and size; shards are packed independently, so no task sees more than its shard
and a hot source or cluster is spread over all of them.

Cases: null text, or text without words, is one piece of no words; a null or
missing source, and an empty text's cluster, conflict with nothing; equal sizes
go by doc_id (null first) and piece; repeated rows are packed as separate
copies of one cluster; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import computed, table, words_of
from .shared import text_batches

CAPACITY = 2048
SHARD_DOCS = 20_000
OUT = "doc_id long, piece int, start_word long, n_words long, bin_id long, slot int"
_OWN = 48  # frequent sources with a bit of their own; the others share the rest
_BLOCK = 512


class Bins:
    """Open bins in residual order."""

    def __init__(self, own_sources: dict):
        self.own = own_sources
        self.room = np.empty(0, np.int64)
        self.src = np.empty(0, np.uint64)
        self.dup = np.empty(0, np.uint64)
        self.no = np.empty(0, np.int64)
        self.members: list[tuple[set, set]] = []
        self.fill: list[int] = []

    def bits(self, source, cluster) -> tuple[np.uint64, np.uint64, np.uint64]:
        """Own source bit, shared source bit, cluster bit."""
        one = np.uint64(1)
        if source is None:
            own = shared = np.uint64(0)
        elif source in self.own:
            own, shared = one << np.uint64(self.own[source]), np.uint64(0)
        else:
            own, shared = np.uint64(0), one << np.uint64(_OWN + hash_of(source) % (64 - _OWN))
        dup = np.uint64(0) if cluster is None else one << np.uint64(cluster % 64)
        return own, shared, dup

    def place(self, size: int, source, cluster, capacity: int) -> tuple[int, int]:
        """Put a piece into its bin; (bin number, slot)."""
        own, shared, dup = self.bits(source, cluster)
        at = self.find(size, source, cluster, own, shared, dup)
        if at is None:
            no, room, src, dups = len(self.members), capacity, np.uint64(0), np.uint64(0)
            self.members.append((set(), set()))
            self.fill.append(0)
        else:
            no, room, src, dups = int(self.no[at]), int(self.room[at]), self.src[at], self.dup[at]
        if source is not None:
            self.members[no][0].add(source)
        if cluster is not None:
            self.members[no][1].add(cluster)
        self.move(at, no, room - size, src | own | shared, dups | dup)
        self.fill[no] += 1
        return no, self.fill[no] - 1

    def find(self, size, source, cluster, own, shared, dup) -> int | None:
        lo = int(np.searchsorted(self.room, size))
        for i in range(lo, len(self.room), _BLOCK):
            src, dups = self.src[i:i + _BLOCK], self.dup[i:i + _BLOCK]
            open_ = np.flatnonzero((src & own) == 0)
            unsure = ((src[open_] & shared) | (dups[open_] & dup)) != 0
            for k, check in zip(open_, unsure):
                if not check:
                    return i + int(k)
                sources, clusters = self.members[int(self.no[i + k])]
                if source not in sources and cluster not in clusters:
                    return i + int(k)
        return None

    def move(self, at: int | None, no: int, room: int, src, dup) -> None:
        to = int(np.searchsorted(self.room, room))
        while to < len(self.room) and self.room[to] == room and self.no[to] < no:
            to += 1
        for name, v in (("room", room), ("src", src), ("dup", dup), ("no", no)):
            a = getattr(self, name)
            if at is None:
                a = np.insert(a, to, v)
            else:  # room only shrinks: the bins between shift up by one
                a[to + 1:at + 1] = a[to:at].copy()
                a[to] = v
            setattr(self, name, a)


def hash_of(value) -> int:
    """A hash that is the same in every process."""
    h = 0
    for b in str(value).encode():
        h = (h * 131 + b) & 0xFFFFFFFF
    return h >> 3


def pack_shard(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit packing of one shard: columns shard, doc_id, n_words, source, cluster."""
    none = lambda col: [None if pd.isna(x) else x for x in rows[col]]
    ids, sources = none("doc_id"), none("source")
    clusters = [None if x is None else int(x) for x in none("cluster")]
    pieces = []
    for i, n in enumerate(rows["n_words"]):
        for k, start in enumerate(range(0, max(int(n), 1), capacity)):
            pieces.append((min(capacity, int(n) - start), i, k, start))
    pieces.sort(key=lambda p: (-p[0], ids[p[1]] is not None, ids[p[1]] or 0, p[2], clusters[p[1]] or 0))
    top = [s for s, _ in sorted(Counter(s for s in sources if s is not None).items(), key=lambda x: (-x[1], str(x[0])))[:_OWN]]
    bins = Bins({s: k for k, s in enumerate(top)})
    base = int(rows["shard"].iloc[0]) << 32
    out = []
    for size, i, k, start in pieces:
        no, slot = bins.place(size, sources[i], clusters[i], capacity)
        out.append((ids[i], k, start, size, base + no, slot))
    frame = pd.DataFrame(out, columns=["doc_id", "piece", "start_word", "n_words", "bin_id", "slot"])
    return frame.astype({"doc_id": "Int64", "piece": "int32", "slot": "int32"})


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     cluster_col: str | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: its words (``start_word``, ``n_words``), bin and place in the bin.

    ``cluster_col`` names a long column of duplicate clusters; without it,
    texts with the same lower-case words are one cluster.
    """
    text_batches(docs.sparkSession)
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")
    words = computed(docs, F.col(id_col).cast("long").alias("doc_id"), source.alias("source"),
                     cluster.alias("given"), words_of(F.col(text_col)).alias("w"))
    same = F.when(F.size("w") > 0, F.xxhash64(F.lower(F.array_join("w", " "))))
    rows = computed(words, "doc_id", "source", F.size("w").cast("long").alias("n_words"),
                    (F.col("given") if cluster_col else same).alias("cluster"))
    shards = max(1, -(-docs.count() // shard_docs))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_words", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), OUT)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
