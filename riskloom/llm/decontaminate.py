"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

A document is contaminated by an item when some run of its words is within
``EDIT_RATE`` of the item: word edit distance at most ``EDIT_RATE * n`` for an
item of ``n`` words (A-Z lower-cased).

The CGK random walk embeds a window: at step ``t`` it writes the word at its
cursor and moves on if bit ``t`` of that word's random bits is set.  Windows at
small edit distance get embeddings at small Hamming distance.  Each of
``REPEATS`` walks has own bits and an own sample of ``SAMPLES`` steps per window
size, whose words are hashed to one key; equal keys make a candidate.

Windows follow the items: half an item's words, rounded down to a power of two,
at most 32.  They start where a word has the least hash of ``ANCHOR`` words in
a row, in items and documents alike, so an item gives several windows and
any unedited one of them finds the passage.  All walks of a text step together
(numpy), 64 steps in all.  Candidates are verified exactly on whole items
by semi-global word edit distance.

The benchmark is shipped to tasks in blocks of at most ``BLOCK_WORDS`` words (the
bound of what a task holds), one pass over the documents for each block, so no
benchmark is too large; documents are never shuffled or grouped.

Cases: items or documents with null or blank text match nothing; rows with a
null doc_id are judged and reported with null; items of up to four words must match
exactly; a repeated item_id is judged per row and reported once per document; an
empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import table
from .shared import text_batches
from .words import Words, mix64, salt, slices, sliding_argmin

EDIT_RATE = 0.2
REPEATS = 3
SAMPLES = 8
ANCHOR = 4
MAX_WINDOW = 32
BLOCK_WORDS = 1_000_000
OUT = "doc_id long, item_id long, edits int, item_words int, end_word long"
_SLICE = 1 << 20
_FILTER = 1 << 20


def window_size(n: int) -> int:
    return min(MAX_WINDOW, 1 << max(0, (max(1, n // 2)).bit_length() - 1))


def anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of windows: the least hash of each ``ANCHOR`` words in a row, and a text's first word."""
    order = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    at = sliding_argmin(order, ANCHOR)
    heads = first[:-1][first[1:] > first[:-1]]
    return np.unique(np.concatenate((at, heads)))


def embed_keys(h: np.ndarray, stop: np.ndarray, starts: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(repeat, window size, key of each start).  ``stop`` is the end of each start's text."""
    pad = np.append(h, np.uint64(0))
    for rep in range(REPEATS):
        rng = np.random.default_rng(1000 + rep)
        steps = {s: np.sort(rng.choice(np.arange(2 * s), min(SAMPLES, 2 * s), replace=False)) for s in _SIZES}
        bits = mix64(pad + salt(rep + 1))
        cursor = starts.copy()
        keys = {s: np.full(len(starts), np.uint64(s * 31 + rep + 1)) for s in sizes}
        ends = {s: np.minimum(starts + s, stop) for s in sizes}
        for t in range(2 * max(sizes, default=0)):
            word = None
            for s in sizes:
                if t in steps[s]:
                    word = pad[cursor] if word is None else word
                    keys[s] = mix64(keys[s] ^ np.where(cursor < ends[s], word, np.uint64(0)))
            cursor += ((bits[cursor] >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
            np.minimum(cursor, stop, out=cursor)
        for s in sizes:
            yield rep, s, keys[s]


_SIZES = [1 << k for k in range(MAX_WINDOW.bit_length())]


def edit_end(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Least word edits of ``item`` against any run of ``part``, and that run's end."""
    row = np.zeros(len(part) + 1, np.int64)
    step = np.arange(len(part) + 1)
    for i, w in enumerate(item):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (part != w))
        row = np.minimum.accumulate(best - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """Keys of a block of benchmark items, built once per task."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        w = Words([t.encode() for _, t in rows], lower=True)
        self.ids = [i for i, _ in rows]
        self.words = [w.hash[w.first[i]:w.first[i + 1]] for i in range(len(rows))]
        n = np.array([len(x) for x in self.words], np.int64)
        self.size = np.array([window_size(int(x)) for x in n], np.int64)
        self.sizes = sorted({int(s) for s, x in zip(self.size, n) if x})
        starts = anchors(w.hash, w.first)
        owner = w.text_of(starts)
        fits = starts + self.size[owner] <= w.first[owner + 1]
        starts, owner = starts[fits], owner[fits]
        stop = w.first[owner + 1]
        self.tables = {}
        for rep, s, keys in embed_keys(w.hash, stop, starts, self.sizes):
            mine = np.flatnonzero(self.size[owner] == s)
            order = mine[np.argsort(keys[mine], kind="stable")]
            seen = np.zeros(_FILTER, bool)
            seen[(keys[order] % np.uint64(_FILTER)).astype(np.int64)] = True
            self.tables[rep, s] = (keys[order], owner[order], (starts - w.first[owner])[order], seen)

    def matches(self, w: Words) -> dict[tuple[int, int], tuple[int, int]]:
        """{(text, item): (edits, end)} of the best match of each pair within the bound."""
        starts = anchors(w.hash, w.first)
        stop = w.first[w.text_of(starts) + 1]
        found = []
        for rep, s, keys in embed_keys(w.hash, stop, starts, self.sizes):
            table_, owner, offset, seen = self.tables[rep, s]
            hit = np.flatnonzero(seen[(keys % np.uint64(_FILTER)).astype(np.int64)])
            lo = np.searchsorted(table_, keys[hit], side="left")
            hi = np.searchsorted(table_, keys[hit], side="right")
            n = hi - lo
            which = np.repeat(hit, n)
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack((starts[which] - offset[entry], owner[entry], w.text_of(starts[which])), 1))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        tried = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
        for at, item, text in tried.tolist():
            words = self.words[item]
            bound = int(EDIT_RATE * len(words))
            a, b = int(w.first[text]), int(w.first[text + 1])
            lo, hi = max(a, at - bound), min(b, at + len(words) + bound)
            if out.get((text, item), (1,))[0] == 0:
                continue
            if at >= a and at + len(words) <= b and np.array_equal(w.hash[at:at + len(words)], words):
                edits, end = 0, at + len(words)
            else:
                edits, end = edit_end(words, w.hash[lo:hi])
                end += lo
            if edits <= bound and (edits, end - a) < out.get((text, item), (edits + 1, 0)):
                out[text, item] = (edits, end - a)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words at most."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(r"t rlike '[^\\x20\\x09-\\x0D]'")
    letters = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-letters // (2 * BLOCK_WORDS)))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    for k in range(blocks):
        got = sorted({(r.i, r.t) for r in rows.where(part == k).collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if got:
            yield got


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word): documents that hold an item, and where its best match ends."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = text_batches(docs.sparkSession).createDataFrame([], OUT)
    for rows in _blocks(benchmark, item_col, item_text):
        def scan(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            items = Items(rows)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                raw = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
                hits = []
                for a, b in slices([len(t or b"") for t in raw], _SLICE):
                    best: dict[tuple[int, int | None], tuple] = {}
                    for (t, i), (edits, end) in items.matches(Words(raw[a:b], lower=True)).items():
                        key, new = (a + t, items.ids[i]), (edits, len(items.words[i]), end)
                        best[key] = min(new, best.get(key, new))
                    hits += [(ids[t], i, *v) for (t, i), v in best.items()]
                cols = list(zip(*hits)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "edits", "item_words", "end_word"])
        out = out.union(text.mapInArrow(scan, OUT))
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
