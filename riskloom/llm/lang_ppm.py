"""Language ID by prediction by partial matching (PPM).

One variable-order byte context tree per language: at a node (context) seen
``T`` times with ``q`` different next bytes, a seen byte costs
``-log2(n / (T + q))`` bits and any other byte costs the escape
``-log2(q / (T + q))`` plus its price one order lower; below order 0 every
byte is equally likely (escape method C, no exclusion).  Statistics are frozen
after fitting, so the price of a byte depends only on the ``ORDER`` bytes before
it; the trees are unrolled into one table ``cost[context + byte, language]``,
built once per Python worker from the counts (a few MB in the task closure), and
a text's code length is a sum of table rows.

Bytes are folded first: ASCII letters to lower case, the ``ALPHABET - 1`` most
frequent bytes of the sample to one class each, all others to one class whose
price includes the choice among them.

Bound of the fitting sample, per language: ``train_docs`` documents of at most
``train_bytes`` bytes, the first in order of a hash of the id.

Cases: null text or text without a letter gives ``und`` and score 0; with no
labelled rows every text is ``und``; equal code lengths go to the
alphabetically first language; repeated rows are scored alike; an empty table
gives an empty result.  Texts are scored whole, in slices of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .columns import table
from .shared import text_batches
from .words import slices

ORDER = 3
ALPHABET = 48
TRAIN_DOCS = 400
TRAIN_BYTES = 1 << 16
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_PAD = b"\n" * ORDER
_SCORE_BYTES = 64
_SPAN = 1 << 18
_UNIT = 1024  # prices are kept in 1/1024 bit, so a table entry takes two bytes


class PPM:
    """Fitted model: folding of bytes and sparse counts of (ORDER + 1)-grams."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        joined = [np.frombuffer(_PAD + _PAD.join(samples[x]) + _PAD, np.uint8) for x in self.langs]
        joined = [_LOWER[x] for x in joined]
        seen = sum((np.bincount(x, minlength=256) for x in joined), np.zeros(256, np.int64))
        top = [b for b in np.argsort(-seen, kind="stable")[: ALPHABET - 1] if seen[b]]
        fold = np.full(256, ALPHABET - 1, np.uint32)
        fold[top] = np.arange(len(top), dtype=np.uint32)
        self.fold = fold[_LOWER]
        self.rest = max(1, 256 - len(top))
        self.counts = [np.unique(_grams(self.fold[x]), return_counts=True) for x in joined]
        content = hashlib.sha256(repr((self.langs, self.rest, self.fold.tolist())).encode())
        for grams, n in self.counts:
            content.update(grams.tobytes() + n.tobytes())
        self.key = content.hexdigest()  # all that the price table is made of

    def table(self) -> np.ndarray:
        """``cost[gram, language]`` in 1/1024 bit (at most 64 bits), uint16.

        The highest order is priced one first byte at a time, to bound memory.
        """
        part = ALPHABET ** ORDER
        out = np.empty((ALPHABET * part, len(self.langs)), np.uint16)
        for k, (grams, n) in enumerate(self.counts):
            cost = np.full(ALPHABET, np.log2(ALPHABET))
            for order in range(ORDER):
                size = ALPHABET ** (order + 1)
                cost = _prices(np.bincount(grams % size, n, size), cost)
            for i in range(ALPHABET):
                mine = grams // part == i
                top = _prices(np.bincount(grams[mine] % part, n[mine], part), cost)
                top.reshape(-1, ALPHABET)[:, -1] += np.log2(self.rest)
                out[i * part:(i + 1) * part, k] = np.minimum(np.rint(top * _UNIT), 65535)
        return out


def _prices(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bits of each gram from its counts and the prices one order lower."""
    c = count.reshape(-1, ALPHABET)
    total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        known = np.log2(total + kinds) - np.log2(c)
        escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0)
    # the lower context is the longest proper suffix: its prices repeat for every first byte
    low = np.resize(lower.reshape(-1, ALPHABET), c.shape)
    return np.where(c > 0, known, escape + low).reshape(-1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _grams(f: np.ndarray) -> np.ndarray:
    """Index of the gram that ends at each position from ORDER on."""
    g = f[: len(f) - ORDER].copy()
    for i in range(1, ORDER + 1):
        g *= np.uint32(ALPHABET)
        g += f[i: len(f) - ORDER + i]
    return g


def code_lengths(model: PPM, cost: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Bits of every text under every language, [texts, languages]."""
    buf = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8)
    at = np.cumsum([0] + [len(t) + ORDER for t in texts])
    bits = np.zeros((len(texts), len(model.langs)))
    for lo in range(0, int(at[-1]), _SPAN):
        hi = min(lo + _SPAN, int(at[-1]))
        # grams ending at bytes ORDER + lo .. ORDER + hi - 1: text bytes and the pads after them
        prices = cost[_grams(model.fold[buf[lo: hi + ORDER]])]
        pos = np.arange(lo, hi)
        which = np.searchsorted(at, pos, side="right") - 1
        prices[pos - at[which] >= at[which + 1] - at[which] - ORDER] = 0
        edge = np.flatnonzero(np.diff(which, prepend=-1))
        bits[which[edge]] += np.add.reduceat(prices, edge, axis=0, dtype=np.int64)
    return bits / _UNIT


def _cost(model: PPM) -> np.ndarray:
    if model.key not in _tables:
        _tables.clear()
        _tables[model.key] = model.table()
    return _tables[model.key]


def _predict(model: PPM, texts: pa.Array) -> pa.Array:
    raw = [None if t is None else t.encode() for t in texts.to_pylist()]
    names, scores = [UNDETERMINED] * len(raw), np.zeros(len(raw))
    use = [i for i, t in enumerate(raw) if t] if model.langs else []
    cost = _cost(model) if use else None
    for a, b in slices([len(raw[i]) for i in use]):
        part = use[a:b]
        bits = code_lengths(model, cost, [raw[i] for i in part])
        best = bits.argmin(1)
        size = np.array([len(raw[i]) for i in part])
        scale = np.minimum(size, _SCORE_BYTES) / size
        gap = (bits - bits.min(1, keepdims=True)) * scale[:, None]
        score = 1 / np.exp2(-gap).sum(1)
        for i, k, s in zip(part, best, score):
            names[i], scores[i] = model.langs[k], s
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> PPM:
    """Fit on the bounded sample of ``labelled`` rows (null texts and languages are left out)."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).cast("string").alias("k"), F.col(lang_col).alias("lang"),
                           F.octet_length(text_col).alias("n"))
    rows = rows.where("lang is not null and n > 0").where(F.col("n") <= train_bytes)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= train_docs)
    chosen = [(r.k, r.lang) for r in first.select("k", "lang").limit(train_docs * MAX_LANGUAGES + 1).collect()]
    if len({x for _, x in chosen}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages in the labels")
    samples: dict[str, list[bytes]] = {}
    if chosen:
        ids = F.broadcast(spark.createDataFrame(sorted(set(chosen)), "k string, l string"))
        hit = labelled.select(F.col(id_col).cast("string").alias("k"), F.col(lang_col).alias("l"),
                              F.col(text_col).alias("t")).where(F.octet_length("t") <= train_bytes)
        for r in hit.join(ids, ["k", "l"], "left_semi").select("l", "t", "k").collect():
            samples.setdefault(r.l, []).append((r.k, r.t.encode()))
    return PPM({lang: [t for _, t in sorted(ts)[:train_docs]] for lang, ts in samples.items()})


def predict(model: PPM, text: Column) -> Column:
    """struct<lang_pred, score> of a text column."""
    @F.arrow_udf("lang_pred string, score double")
    def ppm(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield _predict(model, texts)
    # not to be repeated below a filter on its result
    return ppm.asNondeterministic()(F.when(text.rlike(r"\p{L}"), text))


def language_id(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replaced where ``docs`` has such columns)."""
    text_batches(docs.sparkSession)
    model = fit(labelled, id_col, text_col, lang_col)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "_ppm")]
    return docs.select(*keep, predict(model, F.col(text_col)).alias("_ppm")).select(*keep, "_ppm.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = language_id(docs.select("doc_id", "text"), docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
