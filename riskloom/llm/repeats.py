"""Finding word runs that several documents share: anchors, shards, spans.

Shared by the operators that remove repeated passages.  A run is ``run``
consecutive words; its anchor is the ``anchor_words`` words within it whose hash is
least, so equal runs have equal anchors.  ``suspects`` compares the anchors of
all documents; ``spans`` deals the words around anchors that several documents
have to shards, where ``shard`` (an operator's own method) finds the covered
spans; ``without_repeats`` takes them out of the texts.

What one map task knows already stays out of the shards: of the documents
of one slice that share an anchor only one asks for it, and of equal pieces only
that of the smallest doc_id is sent, the others being covered.  A passage
that every document has therefore costs its shard one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .shared import release, text_batches, written
from .words import Words, mix64, salt, slices, sliding_argmin, windows_hash

_UNSURE, _MARK, _KNOWN = 0, 1, 2
_PIECE, _DONE = 0, 1
SPANS = "doc_id long, first long, last long"


class Runs:
    """Stretches of neighbouring runs with one anchor, of many texts.

    One entry per stretch: ``anchor`` (hash), ``at`` (the anchor's first word),
    ``begin`` and ``end`` (the stretch's runs cover words begin..end-1), ``text``.
    """

    def __init__(self, w: Words, size: int, anchor_words: int):
        grams = windows_hash(w.hash, anchor_words)
        at = sliding_argmin(mix64(grams), size - anchor_words + 1)
        text = w.text_of(np.arange(len(at)))
        inside = w.first[text + 1] >= np.arange(len(at)) + size
        where = np.flatnonzero(inside)
        if not len(where):
            self.anchor = np.empty(0, np.uint64)
            self.at = self.begin = self.end = self.text = np.empty(0, np.int64)
            return
        at, text = at[where], text[where]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(where)])) - 1
        self.anchor, self.at, self.text = grams[at[head]], at[head], text[head]
        self.begin, self.end = where[head], where[tail] + size


def _scan(batches, work) -> Iterator[pa.RecordBatch]:
    """Run ``work(ids, texts, *more)`` over slices of batches (doc_id, text, ...)."""
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        raw = [None if t is None else t.encode() for t in cols[1]]
        for i, j in slices([len(t or b"") for t in raw]):
            yield from work(cols[0][i:j], raw[i:j], *(c[i:j] for c in cols[2:]))


def _pairs(a: np.ndarray, doc: np.ndarray) -> bytes:
    return np.concatenate((a.view(np.int64), doc)).tobytes()


def _unpair(data: list) -> tuple[np.ndarray, np.ndarray]:
    got = [np.frombuffer(d, np.int64).reshape(2, -1) for d in data]
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([g[0] for g in got]).view(np.uint64), np.concatenate([g[1] for g in got])


def _group(a: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)


def suspects(docs: DataFrame, n: int, run: int, anchor_words: int) -> DataFrame:
    """(doc_id, anchors): the anchors of each document that another document has too."""
    def emit(batches):
        def work(ids, texts):
            runs = Runs(Words(texts), run, anchor_words)
            doc = np.array(ids, np.int64)[runs.text]
            order = np.lexsort((doc, runs.anchor))
            a, doc = runs.anchor[order], doc[order]
            one = np.concatenate(([True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])))[: len(a)]
            a, doc = a[one], doc[one]
            g = _group(a)
            many = np.repeat(np.diff(np.append(g, len(a))) > 1, np.diff(np.append(g, len(a))))
            lead = np.zeros(len(a), bool)
            lead[g] = True
            rows = []
            for kind, which in ((_UNSURE, ~many), (_MARK, many & lead), (_KNOWN, many)):
                x, y = a[which], doc[which]
                key = x if kind != _KNOWN else mix64(y.view(np.uint64))  # known ones only pass through
                for k, sel in blobs.parts((key >> np.uint64(7)) % np.uint64(n), n):
                    rows.append((k, kind, _pairs(x[sel], y[sel])))
            yield blobs.batch(rows)
        return _scan(batches, work)

    def gather(t: pa.Table) -> pa.Table:
        data = blobs.by_kind(t)
        a, doc = _unpair(data.get(_UNSURE, []))
        mark, _ = _unpair(data.get(_MARK, []))
        order = np.argsort(a, kind="stable")
        a, doc = a[order], doc[order]
        g = _group(a)
        if len(g):
            n_ = np.diff(np.append(g, len(a)))
            several = np.minimum.reduceat(doc, g) != np.maximum.reduceat(doc, g)
            hit = np.repeat(several, n_) | np.isin(a, mark)
            a, doc = a[hit], doc[hit]
        known = _unpair(data.get(_KNOWN, []))
        a, doc = np.concatenate((a, known[0])), np.concatenate((doc, known[1]))
        to = mix64(doc.view(np.uint64)) % np.uint64(n)
        return pa.Table.from_batches([blobs.batch([(k, _KNOWN, _pairs(a[i], doc[i])) for k, i in blobs.parts(to, n)])])

    def by_doc(t: pa.Table) -> pa.Table:
        a, doc = _unpair(t["data"].to_pylist())
        order = np.argsort(doc, kind="stable")
        a, doc = a[order], doc[order]
        g = _group(doc)
        lists = pa.ListArray.from_arrays(pa.array(np.append(g, len(a)), pa.int32()), pa.array(a.view(np.int64)))
        return pa.table([pa.array(doc[g], pa.int64()), lists], names=["doc_id", "anchors"])

    packed = docs.mapInArrow(emit, blobs.SCHEMA)
    found = packed.groupBy("bucket").applyInArrow(gather, blobs.SCHEMA)
    return found.groupBy("bucket").applyInArrow(by_doc, "doc_id long, anchors array<long>")


def _pack(head: np.ndarray, words: np.ndarray) -> bytes:
    """Pieces of one shard (rows doc, begin, size, offset of the anchor) and their word ids in a row."""
    return head.shape[1].to_bytes(8, "little") + head.astype(np.int64).tobytes() + words.tobytes()


def _unpack(data: list) -> tuple[np.ndarray, np.ndarray]:
    heads, words = [], []
    for d in data:
        n = int.from_bytes(d[:8], "little")
        heads.append(np.frombuffer(d, np.int64, 4 * n, 8).reshape(4, n))
        words.append(np.frombuffer(d, np.uint32, -1, 8 + 32 * n))
    return np.concatenate(heads, 1), np.concatenate(words)


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + size[i] - 1 of all i in a row."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _piece_hash(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each piece words[begin : begin + size]."""
    flat = _flat(begin, size)
    place = (flat - np.repeat(begin, size)).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    v = mix64(mix64(words[flat].astype(np.uint64)) + (place + np.uint64(1)) * salt(1))
    return mix64(np.add.reduceat(v, at) + size.astype(np.uint64)) if len(size) else np.empty(0, np.uint64)


class Pieces:
    """Pieces of one shard; equal ones joined.

    ``later``: spans of pieces that an earlier document has whole.  ``rest``: one
    piece of each kind, of its smallest document, in order of doc_id.
    """

    def __init__(self, head: np.ndarray, words: np.ndarray):
        self.doc, self.begin, self.size, self.offset = head
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        key = _piece_hash(words, self.at, self.size)
        order = np.lexsort((self.doc, key))
        g = _group(key[order])
        n = np.diff(np.append(g, len(order)))
        lead = np.repeat(order[g], n)
        later = order[self.doc[order] > self.doc[lead]]
        self.later = np.stack((self.doc[later], self.begin[later], self.begin[later] + self.size[later]))
        self.rest = order[g][np.argsort(self.doc[order[g]], kind="stable")]
        twin = (self.doc[order] == self.doc[lead]) & (order != lead)  # repeats within the smallest document
        by = np.argsort(lead[twin], kind="stable")
        self._twin_of, self._twin = lead[twin][by], order[twin][by]

    def by_anchor(self, words: np.ndarray, n: int) -> list[np.ndarray]:
        """``rest`` in groups of equal anchors (``n`` words), each in order of doc_id."""
        at = self.at[self.rest] + self.offset[self.rest]
        key = _piece_hash(words, at, np.full(len(at), n))
        order = np.argsort(key, kind="stable")
        return np.split(self.rest[order], _group(key[order])[1:]) if len(order) else []

    def spans(self, i: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Spans of pieces ``i`` from word ``first`` to before ``last`` of the piece, and of their twins."""
        lo, hi = np.searchsorted(self._twin_of, i, "left"), np.searchsorted(self._twin_of, i, "right")
        n = hi - lo
        k = np.concatenate((np.arange(len(i)), np.repeat(np.arange(len(i)), n)))
        j = np.concatenate((i, self._twin[_flat(lo, n)])) if n.any() else i
        k = k[: len(j)]
        return np.stack((self.doc[j], self.begin[j] + first[k], self.begin[j] + last[k]))


def spans(docs: DataFrame, anchors: DataFrame, n: int, run: int, anchor_words: int, shard: Callable) -> DataFrame:
    """(doc_id, first, last): covered spans, as word positions of the document.

    ``shard(head, words, run)`` gives the spans [docs, first, last] of one shard's pieces.
    """
    def emit(batches):
        def work(ids, texts, anchors):
            w = Words(texts)
            runs = Runs(w, run, anchor_words)
            ids = np.array(ids, np.int64)
            keep = np.zeros(len(runs.anchor), bool)
            edge = np.searchsorted(runs.text, np.arange(len(texts) + 1))
            for t, mine in enumerate(anchors):
                i, j = edge[t], edge[t + 1]
                if j > i:
                    keep[i:j] = np.isin(runs.anchor[i:j], np.array(mine, np.int64).view(np.uint64))
            a, b, t = runs.anchor[keep], runs.begin[keep], runs.text[keep]
            size, doc, begin = runs.end[keep] - b, ids[t], b - w.first[t]
            head = np.stack((doc, begin, size, runs.at[keep] - b))
            word = w.hash.astype(np.uint32)
            key = _piece_hash(word, b, size)
            order = np.lexsort((doc, key))
            g = _group(key[order])
            m = np.diff(np.append(g, len(order)))
            done = np.zeros(len(order), bool)
            done[order] = doc[order] > np.repeat(doc[order][g], m)
            rows = []
            if done.any():
                rows.append((int(ids[0] % n), _DONE, np.stack((doc, begin, begin + size))[:, done].tobytes()))
            live = np.flatnonzero(~done)
            for k, sel in blobs.parts((a[live] >> np.uint64(7)) % np.uint64(n), n):
                sel = live[sel]
                rows.append((k, _PIECE, _pack(head[:, sel], word[_flat(b[sel], size[sel])])))
            yield blobs.batch(rows)
        return _scan(batches, work)

    def solve(t: pa.Table) -> pa.Table:
        data = blobs.by_kind(t)
        out = [np.frombuffer(d, np.int64).reshape(3, -1) for d in data.get(_DONE, [])]
        if _PIECE in data:
            out += shard(*_unpack(data[_PIECE]), run)
        got = np.concatenate(out, 1)
        got = got[:, np.lexsort((got[2], got[1], got[0]))]
        # join spans that touch, to send less
        new = np.concatenate(([True], (got[0, 1:] != got[0, :-1]) | (got[1, 1:] > got[2, :-1]))) if got.shape[1] else np.empty(0, bool)
        g = np.flatnonzero(new)
        last = np.maximum.reduceat(got[2], g) if len(g) else got[2]
        return pa.table([pa.array(got[0][g]), pa.array(got[1][g]), pa.array(last)], names=["doc_id", "first", "last"])

    packed = docs.join(anchors, "doc_id").select("doc_id", "text", "anchors").mapInArrow(emit, blobs.SCHEMA)
    return packed.groupBy("bucket").applyInArrow(solve, SPANS)


def repeated_spans(docs: DataFrame, run: int, anchor_words: int, shard: Callable, share: float) -> DataFrame:
    """(doc_id, first, last) of (doc_id, text); ``share`` is about what is dealt out, as a part of the text's bytes."""
    spark = text_batches(docs.sparkSession)
    real = docs.where("doc_id is not null and text is not null")
    n = blobs.buckets_for(docs, "text", share)
    anchors = written(suspects(real, n, run, anchor_words), "suspects")
    release(spark)
    out = written(spans(real, anchors, n, run, anchor_words, shard), "spans")
    release(spark, anchors)
    return out


def _keep(text: str | None, gone) -> tuple[int, int, bytes]:
    words = (text or "").encode().split()
    n = len(words)
    if gone:
        drop = np.zeros(n + 1, np.int64)
        for s in gone:
            drop[s["first"]] += 1
            drop[s["last"]] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    return n, n - len(words), b" ".join(words)


def without_repeats(docs: DataFrame, id_col: str, text_col: str, run: int, anchor_words: int, shard: Callable,
                    share: float) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts of the words that stay, joined by single spaces."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeated_spans(text, run, anchor_words, shard, share).groupBy(F.col("doc_id").alias("d")).agg(
        F.collect_list(F.struct("first", "last")).alias("gone"))

    def rebuild(batches):
        for b in batches:
            got = [_keep(t, g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()),
                 pa.array([x[2].decode() for x in got], pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    both = text.join(gone, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "gone")
    return both.mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, text string")
