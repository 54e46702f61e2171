"""Toxicity by class-conditional Kneser-Ney models.

Two word distributions, learnt from the toxic and the ordinary labelled documents.
As in Kneser-Ney's lower order, a word counts by the different words it follows
in its class, not by its occurrences: a word that one long document or a group
of copies repeats has few left contexts.  One is discounted from every count, which
takes out what a document (and its copies) contributed about itself.  With the
shared distribution ``S`` of both classes and ``E(w) = total * S(w)``,

    P_c(w) = E / (E + K) * (count_c(w) - 1) / total  +  K / (E + K) * S(w)

so a frequent word has its class's frequency, a rare one falls back on the
shared counts, and a word seen in one context only costs both classes the same.
The totals of the classes are made equal, hence

    log P_toxic(w) - log P_ordinary(w) = log((count_t - 1 + K) / (b * (count_o - 1) + K))

``order=2`` puts the word pair on top.  A pair (v, w) counts by the different words
it follows in its class, one is discounted, and what the discount and ``K`` leave goes
to the class's word level, relative to the shared distribution ``S(w | v)``:

    P_c(w | v) = E / (E + K) * (count_c(v, w) - 1) / total_c  +  K / (E + K) * S(w | v) * P_c(w) / S(w)

with E and the totals now of pairs.  So a pair that says nothing has the price of its word,

    log((count_t - 1 + K * r) / (b * (count_o - 1) + K / r)),   r * r = P_toxic(w) / P_ordinary(w)

Only a part of a toxic text's words is toxic.  With ``share`` below 1 its words are drawn from the
toxic model with that probability, else from the ordinary one, so with ``p`` the price of the pair above

    g(w | v) = 1 - share + share * exp(p),    price = log g(w | v) - log Z(v)

where Z(v) is the mean of ``g`` over what follows v in the labelled texts, relative to its mean over
all pairs (with one pair of mean 1 added).  It makes g(. | v) a distribution again; without it, classes of
different size (whose counts of different left words saturate) and languages of different size lean
every word of a text.  For the same reason a word then counts by the different pairs of words to its
left, and pairs have a ``K`` of their own.  No word or pair is left out: hundreds of words that lean by chance add up to
little, the more so the smaller ``share`` is.  As Z(v) does not depend on w, it is paid once, by v.

A price nearer to 0 than ``evidence`` (0 in the query) counts as 0.  A text's value is the
sum of the prices over its words, divided by its words plus ``PRIOR_WORDS`` (so that one word does not decide a text of three).  The threshold
is the value with the best F1 on the labelled documents; ``score`` is a logistic
curve through 0.7 there.

Plan.  Contexts and prices grow with the corpus, so neither is broadcast nor
collected.  Contexts are dealt by hash of word and left word, so that a frequent
word is spread over all tasks, made distinct per bucket, and summed per word; a
pair is complete in its bucket, where at most its different left words per block meet.
Documents are read in blocks of about ``BLOCK_WORDS`` words: a block asks for the
prices of its different words (dealt by word as packed arrays), the answers (with
the left words that change a price) come back as one array per bucket, and the block's
texts, kept as ranks of their words, are priced with them.  A bitmap of fixed size tells words that have no price
beforehand; it may let others pass, which are then asked for.
A word's occurrence is a rank of a few bits to two bytes.  To the driver come the totals, the bitmap and a
histogram of values (bounded by ``LIMIT`` and ``BINS``).

Words are runs of bytes other than white space and ASCII punctuation, ASCII
capitals folded.  Inputs of a score: the text alone.

Cases: null, empty or wordless text has value 0; a document whose label rows
differ counts as toxic; labels that are null or of unknown documents are left
out; with no toxic or no ordinary labelled text every score is 0; repeated rows
are scored row by row, rows without id too; ids are read as long; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import table
from .shared import release, text_batches, written
from .words import Words, mix64, slices

K = 4.0
DISCOUNT = 1
PRIOR_WORDS = 20
WORD_K, PAIR_K, SHARE = 2.0, 100.0, 0.01  # of the query: smoothing of words and pairs, toxic words in a toxic text
THRESHOLD = 0.7
BLOCK_WORDS = 3_000_000
BUCKET_BYTES = 12 << 20
BINS, LIMIT = 1000, 10  # values are counted in steps of share / BINS up to +-LIMIT
MAP_BITS = 24  # words with a price are marked by the first bits of their hash

_BLANK = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more at the end)."""
    w = Words([(t or b"").translate(_BLANK) for t in texts], lower=True)
    return w.hash, w.first


def _texts(batches, columns: int) -> Iterator[tuple]:
    """Slices of batches whose last column is the text: (other columns, hashes, starts)."""
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        raw = [None if t is None else t.encode() for t in cols[columns]]
        for i, j in slices([len(t or b"") for t in raw]):
            yield ([c[i:j] for c in cols[:columns]], *tokens(raw[i:j]))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary: bytes of equal weight next to each other, deflated."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
        data = zlib.compress(planes, 1)
        out.append(struct.pack("<q", len(data)) + data)
    return b"".join(out)


def _unpacked(data: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        (n,) = struct.unpack_from("<q", data, at)
        planes = np.frombuffer(zlib.decompress(data[at + 8:at + 8 + n]), np.uint8)
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(t))
        at += 8 + n
    return out


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a 64-bit hash; Spark's ``pmod(h, n)``."""
    return h.view(np.int64) % n


# --- counting ----------------------------------------------------------------

def _distinct(w: np.ndarray, left: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (word, left words) in order of word, and the classes (bits) that have them."""
    order = np.lexsort((left, w))
    w, left, flag = w[order], left[order], flag[order]
    if not len(w):
        return w, left, flag
    head = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (left[1:] != left[:-1]))))
    return w[head], left[head], np.bitwise_or.reduceat(flag, head)


def _as_left(h: np.ndarray) -> np.ndarray:
    """32-bit hash of words as left words."""
    return (mix64(h) >> np.uint64(32)).astype(np.uint32)


def _left(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32-bit hash of the word to the left of each word, one value for none."""
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[first[:-1][first[:-1] < len(h)]] = 0
    return _as_left(prev)


def _contexts(n: int, order: int):
    """Map side: different (word, left word, class), with ``order`` 2 (word, two left words, class),
    of the task's texts, one binary per bucket."""
    def emit(parts: list[tuple]) -> pa.RecordBatch:
        w, left, flag = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        bucket = _bucket(mix64(w ^ ((left >> np.uint64(32)) * _MIX)), n)
        at = np.argsort(bucket, kind="stable")
        w, left, flag, bucket = w[at], left[at], flag[at], bucket[at]
        head = _runs(bucket)
        rows = []
        for a, b in zip(head, np.append(head[1:], len(w))):
            first = _runs(w[a:b])
            each = np.diff(np.append(first, b - a)).astype(np.uint32)
            rows.append((int(bucket[a]), _packed(w[a:b][first], each, (left[a:b] >> np.uint64(32)).astype(np.uint32),
                                                 left[a:b].astype(np.uint32), flag[a:b])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                          ["bucket", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for (toxic,), h, first in _texts(batches, 1):
            v = _left(h, first)
            left = v.astype(np.uint64) << np.uint64(32)
            if order > 1:
                begins = first[:-1][first[:-1] < len(h)]
                left[1:] |= (v[:-1] >> np.uint32(8)).astype(np.uint64)  # 24 bits of it: it is only counted
                left[begins] = v[begins].astype(np.uint64) << np.uint64(32) | (v[begins] >> np.uint32(8)).astype(np.uint64)
            flag = np.repeat(np.array([1 if t else 2 for t in toxic], np.uint8), np.diff(first))
            parts.append((h, left, flag))
            size += len(h)
            if size >= BLOCK_WORDS:
                yield emit(parts)
                parts, size = [], 0
        if size:
            yield emit(parts)
    return scan


def _merge(t: pa.Table, deep: bool = False) -> pa.Table:
    """Reduce side, of one bucket (``deep``: contexts of a word are two left words, not one): (word, null, contexts in toxic texts, contexts in ordinary texts, word as a left word), and
    of the pairs with two contexts or more in a class (word, left word, contexts in toxic texts, in ordinary texts, null)."""
    ws, lefts, flags = [], [], []
    for d in t["data"].to_pylist():
        w, each, v, u, flag = _unpacked(d, np.uint64, np.uint32, np.uint32, np.uint32, np.uint8)
        ws.append(np.repeat(w, each))
        lefts.append(v.astype(np.uint64) << np.uint64(32) | u.astype(np.uint64))
        flags.append(flag)
    w, left, flag = _distinct(np.concatenate(ws), np.concatenate(lefts), np.concatenate(flags))
    v = (left >> np.uint64(32)).astype(np.uint32)
    pair = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1]))))
    toxic, ordinary = (np.add.reduceat(x.astype(np.int64), pair) for x in (flag & 1, flag >> 1))
    word = _runs(w[pair])
    mt, mo = (np.add.reduceat(x if deep else (x > 0).astype(np.int64), word) for x in (toxic, ordinary))
    known = (toxic > DISCOUNT) | (ordinary > DISCOUNT)
    alone = np.arange(len(word) + known.sum()) < len(word)
    side = np.concatenate((_as_left(w[pair][word]), v[pair][known])).view(np.int32)
    return pa.table({
        "w": pa.array(np.concatenate((w[pair][word], w[pair][known])).view(np.int64)),
        "v": pa.array(side, mask=alone),
        "mt": pa.array(np.concatenate((mt, toxic[known]))), "mo": pa.array(np.concatenate((mo, ordinary[known]))),
        "as_left": pa.array(side, mask=~alone)})


def fit(labelled: DataFrame, buckets: int, text_col: str = "text", toxic_col: str = "toxic", order: int = 1,
        evidence: float = 0.0, k: float = K, pair_k: float | None = None, share: float = 1.0) -> DataFrame:
    """(w, v, price, z): log of toxic over ordinary probability, of each word (v null) whose class counts say anything,
    and with ``order`` 2 of each word after v where that differs; prices nearer to 0 than ``evidence`` are 0.
    With ``share`` below 1 (and ``order`` 2) prices of the mixture, and z is log Z of a word as left word."""
    if share < 1 and order < 2:
        raise ValueError("share needs order 2")
    pair_k = k if pair_k is None else pair_k
    spark = labelled.sparkSession
    src = labelled.where(F.col(toxic_col).isNotNull()).select((F.col(toxic_col) > 0).alias("toxic"), F.col(text_col).alias("text"))
    contexts = src.mapInArrow(_contexts(buckets, order), "bucket long, data binary")
    partial = contexts.groupBy("bucket").applyInArrow(lambda t: _merge(t, share < 1), "w long, v int, mt long, mo long, as_left int")
    partial = written(partial, "toxicity-contexts")
    release(spark)
    counts = partial.where("v is null").groupBy("w").agg(F.sum("mt").alias("mt"), F.sum("mo").alias("mo"), F.max("as_left").alias("as_left"))
    rest = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0)).alias(c)
    counts = counts.select("w", rest("mt"), rest("mo"), "as_left")
    # a word may say nothing itself and yet be the left word of pairs that do
    counts = written(counts if share < 1 else counts.where("mt > 0 or mo > 0"), "toxicity-counts")
    toxic, ordinary = counts.agg(F.sum("mt"), F.sum("mo")).first()
    none = F.lit(None).cast("int").alias("v")
    if not toxic or not ordinary:
        return counts.where("false").select("w", none, F.lit(0.0).alias("price"), F.lit(0.0).alias("z"))
    told = lambda p: F.abs(p) >= evidence
    own = F.log((F.col("mt") + k) / (F.col("mo") * (toxic / ordinary) + k)).alias("price")
    words = counts.where("mt > 0 or mo > 0").select("w", own)
    prices = words.where(told(F.col("price"))).select("w", none, "price", F.lit(0.0).alias("z"))
    if order > 1:
        pairs = partial.where("v is not null").select("w", "v", rest("mt"), rest("mo"))
        t, o = pairs.agg(F.sum("mt"), F.sum("mo")).first()
        balance = t / o if t and o else toxic / ordinary
        half = F.coalesce(F.col("price"), F.lit(0.0)) / 2
        both = pairs.join(words, "w", "left").select(
            "w", "v", (half * 2).alias("own"), (F.col("mt") + F.col("mo")).alias("n"),
            F.log((F.col("mt") + pair_k * F.exp(half)) / (F.col("mo") * balance + pair_k * F.exp(-half))).alias("price"))
        both = both.where(told(F.col("price")) | told(F.col("own")))
        price = F.when(told(F.col("price")), F.col("price")).otherwise(0.0).alias("price")
        if share < 1:
            mixed = lambda p: F.log1p(share * F.expm1(p)).alias("price")
            both = written(both.select("w", "v", mixed(price), "n"), "toxicity-pairs")
            g = F.col("n") * F.exp("price")
            total, n = both.agg(F.sum(g), F.sum("n")).first()
            z = both.groupBy("v").agg(F.log((F.sum(g) * (n / total if total else 1.0) + 1) / (F.sum("n") + 1)).alias("z"))
            prices = counts.join(z, F.col("as_left") == F.col("v"), "left").where("mt > 0 or mo > 0 or z is not null").select(
                "w", none, mixed(F.when(told(own), own).otherwise(0.0)), F.coalesce("z", F.lit(0.0)).alias("z"))
            price = F.col("price")
        prices = prices.union(both.select("w", "v", price, F.lit(0.0)))
    prices = written(prices, "toxicity-prices")
    release(spark, partial, counts, *([both] if share < 1 else []))
    return prices


# --- scoring -----------------------------------------------------------------

_ASK, _BLOCK = 0, 1


def _marked(prices: DataFrame) -> np.ndarray:
    """Bitmap of the words that have a price, by the first ``MAP_BITS`` of their hash."""
    at = F.shiftrightunsigned("w", 64 - MAP_BITS)
    bits = prices.groupBy(F.shiftright(at, 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(w, {64 - MAP_BITS}) % 64 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[bits["i"].to_numpy()] = bits["b"].to_numpy()
    return out.view(np.uint64)


def _has(marked: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - MAP_BITS)
    return (marked[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _blocks(n: int, marked: np.ndarray):
    """Blocks of documents: the different words they ask for, by bucket, and the texts as ranks of their words."""
    def emit(block: int, docs: list[tuple]) -> pa.RecordBatch:
        ids = [i for d in docs for i in d[0]]
        size = np.concatenate([d[1] for d in docs]).astype(np.uint32)
        words, at, many = np.unique(np.concatenate([d[2] for d in docs]), return_inverse=True, return_counts=True)
        often = np.argsort(-many, kind="stable")  # frequent words have small ranks, so the ranks' upper bytes pack well
        rank = np.empty(len(words), np.uint32)
        rank[often] = np.arange(len(words), dtype=np.uint32)
        words, at = words[often], rank[at]
        asked = np.flatnonzero(_has(marked, words))
        bucket = _bucket(words[asked], n)
        by_bucket = np.argsort(bucket, kind="stable")
        asked, bucket = asked[by_bucket], bucket[by_bucket]
        place = np.zeros(len(words), np.uint32)  # in the answers, from 1; 0 is not asked for
        place[asked] = np.arange(1, len(asked) + 1)
        known = np.array([i is not None for i in ids], np.uint8)
        data = _packed(np.array([i or 0 for i in ids], np.int64), known, size, at, place, _as_left(words))
        head = _runs(bucket)
        rows = [(int(bucket[a]), block, _ASK, words[asked[a:b]].tobytes()) for a, b in zip(head, np.append(head[1:], len(asked)))]
        rows.append((-1, block, _BLOCK, data))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                                           pa.array(cols[3], pa.binary())], ["bucket", "block", "kind", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, size = TaskContext.get().partitionId() << 32, [], 0
        for (ids,), h, first in _texts(batches, 1):
            size += len(h) + len(ids)
            docs.append((ids, np.diff(first), h))
            if size >= BLOCK_WORDS:
                yield emit(block, docs)
                block, docs, size = block + 1, [], 0
        if docs:
            yield emit(block, docs)
    return scan


def _answer(asked: pa.Table, prices: pa.Table) -> pa.Table:
    """Prices of the words that each block asked this bucket for, in the block's order (0 for unknown ones), and after left words;
    each word pays its z, whatever is to its left."""
    w, p = prices["w"].to_numpy(), prices["price"].to_numpy() - prices["z"].to_numpy()
    alone = prices["v"].is_null().to_numpy()
    v = prices["v"].fill_null(0).to_numpy().view(np.uint32)
    order = np.argsort(w[alone])
    word, price, z = w[alone][order], p[alone][order].astype(np.float32), prices["z"].to_numpy()[alone][order]
    order = np.lexsort((v[~alone], w[~alone]))
    pair, left, after = w[~alone][order], v[~alone][order], p[~alone][order]
    if len(word):
        at = np.minimum(np.searchsorted(word, pair), len(word) - 1)
        after = after - np.where(word[at] == pair, z[at], 0.0)
    after = after.astype(np.float32)
    out = []
    for d in asked["data"].to_pylist():
        want = np.frombuffer(d, np.int64)
        at = np.minimum(np.searchsorted(word, want), max(len(word) - 1, 0))
        own = np.where(word[at] == want, price[at], np.float32(0)) if len(word) else np.zeros(len(want), np.float32)
        lo = np.searchsorted(pair, want)
        each = np.searchsorted(pair, want, side="right") - lo
        i = np.repeat(lo - np.cumsum(each) + each, each) + np.arange(each.sum())
        out.append(_packed(own, each.astype(np.uint32), left[i], after[i]))
    return pa.table({"block": asked["block"], "bucket": asked["bucket"], "data": pa.array(out, pa.binary())})


def _values(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """(doc_id, value) of the documents of one block."""
    got = [_unpacked(d, np.float32, np.uint32, np.uint32, np.float32)
           for _, d in sorted(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))]
    price, many, left, after = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, t) for t in ("f4", "u4", "u4", "f4"))
    ids, known, size, at, place, side = _unpacked(blocks["data"][0].as_py(), np.int64, np.uint8, *[np.uint32] * 4)
    doc = np.repeat(np.arange(len(ids)), size)
    word = place[at]
    paid = np.concatenate((np.zeros(1, np.float32), price))[word].astype(np.float64)
    if len(left) and len(at):
        v = np.empty(len(at), np.uint32)
        v[1:] = side[at[:-1]]
        v[(np.cumsum(size, dtype=np.int64) - size)[size > 0]] = _as_left(np.zeros(1, np.uint64))[0]
        pair = np.repeat(np.arange(1, len(many) + 1, dtype=np.uint64), many) << np.uint64(32) | left.astype(np.uint64)
        key = word.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)
        i = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        paid = np.where(pair[i] == key, after[i], paid)
    total = np.bincount(doc, paid, len(ids)) if len(doc) else np.zeros(len(ids))
    return pa.table({"doc_id": pa.array(ids, mask=known == 0), "value": pa.array(total / (size + PRIOR_WORDS))})


def values(docs: DataFrame, prices: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value): the length-normalised difference of the two log-likelihoods of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = _blocks(buckets, _marked(prices))
    blocks = written(src.mapInArrow(scan, "bucket long, block long, kind int, data binary"), "toxicity-blocks")
    asked = blocks.where(F.col("kind") == _ASK).select("bucket", "block", "data")
    known = prices.select(F.expr(f"pmod(w, {buckets})").alias("bucket"), "w", "v", "price", "z")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answer, "block long, bucket long, data binary")
    own = blocks.where(F.col("kind") == _BLOCK).select("block", "data")
    out = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_values, "doc_id long, value double")
    out = written(out, "toxicity-values")
    release(docs.sparkSession, blocks)
    return out


def cut_of(histogram: pd.DataFrame, bins: float = BINS) -> tuple[float, float] | None:
    """Threshold with the best F1 and the scale of the score, of (bin, toxic, n) in steps of 1 / ``bins``; thresholds are above 0."""
    n = histogram.pivot_table(index="bin", columns="toxic", values="n", aggfunc="sum", fill_value=0)
    n = n.reindex(columns=[False, True], fill_value=0).sort_index(ascending=False)
    at, ordinary, toxic = n.index.to_numpy() / bins, n[False].to_numpy(), n[True].to_numpy()
    if not ordinary.sum() or not toxic.sum() or not (at > 0).any():
        return None
    hit = np.cumsum(toxic)
    f1 = np.where(at > 0, 2 * hit / (hit + np.cumsum(ordinary) + toxic.sum()), -1.0)
    gap = (at * toxic).sum() / toxic.sum() - (at * ordinary).sum() / ordinary.sum()
    return float(at[f1.argmax()]), max(float(gap) / 4, 1 / bins)


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             toxic_col: str = "toxic", order: int = 1, evidence: float = 0.0, k: float = K, pair_k: float | None = None, share: float = 1.0) -> DataFrame:
    """(doc_id, value, score) of every row of ``docs``; ``labelled`` has (doc_id, text, toxic) of the rows to learn from.

    ``order`` 2 adds the word pairs; prices nearer to 0 than ``evidence`` count as 0; ``share`` is that of toxic words in toxic texts
    (below 1 a word counts by the different pairs of words to its left); ``k`` and ``pair_k`` (default: the same) smooth words and pairs.
    """
    spark = text_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, int(total * 0.4 / BUCKET_BYTES) + 1)
    prices = fit(labelled, buckets, text_col, toxic_col, order, evidence, k, pair_k, share)
    scored = values(docs, prices, buckets, id_col, text_col)
    release(spark, prices)
    fine = BINS / share  # prices of a mixture are in proportion to its share
    bins = F.round(F.greatest(F.least(F.col("value"), F.lit(float(LIMIT))), F.lit(float(-LIMIT))) * fine).cast("int").alias("bin")
    truth = labelled.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(toxic_col) > 0).alias("toxic"))
    truth = truth.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    seen = scored.join(truth, "doc_id").groupBy(bins, "toxic").agg(F.count(F.lit(1)).alias("n"))
    cut = cut_of(seen.toPandas(), fine)
    if cut is None:
        return scored.withColumn("score", F.lit(0.0))
    at, scale = cut
    odds = math.log(THRESHOLD / (1 - THRESHOLD))
    # the lower edge of the threshold's bin, so that its documents are at or above it
    z = F.lit(odds) + (F.col("value") - F.lit(at - 0.5 / fine)) / F.lit(scale)
    return scored.withColumn("score", 1 / (1 + F.exp(-z)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without most of those that no label names, so that a join with the labels shuffles few
    other texts; the join decides."""
    key = F.xxhash64("doc_id").alias("w")
    marked = _marked(labels.select(key))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = pa.array(_has(marked, b.column(2).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(named) for i in (0, 1)], ["doc_id", "text"])
    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text", key).mapInArrow(scan, docs.select("doc_id", "text").schema)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = table(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").where(~held)
    # labels grow with the documents, so they are merged with them at every size and never broadcast
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).hint("merge")
    out = toxicity(docs, _labelled(docs, labels).join(labels, "doc_id"), order=2, k=WORD_K, pair_k=PAIR_K, share=SHARE)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
