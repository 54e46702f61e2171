"""Suffix-array dedup: sparse suffixes at minimisers, sorted, neighbours compared, matches extended.

A word is removed if it lies in a stretch of at least ``MIN_WORDS`` words that a
document with a smaller doc_id has too.

Only suffixes that start at a minimiser are retained: the ``ANCHOR_WORDS`` words
with the least hash among those of any ``MIN_WORDS`` words in a row, about one
suffix in 22 words.  Equal stretches have equal minimisers, so suffixes whose
minimiser occurs in one document only are done with, and the others are dealt
to shards by it, with the words around them.  Each shard

1. joins equal pieces, with their smallest doc_id;
2. sorts the suffixes by their words and compares each with its neighbours in
   that order: no other suffix shares a longer beginning, so a suffix whose best
   neighbour and own left side together stay short of a match is done with;
3. extends the others to the left: every place before the minimiser from which
   the neighbour's common prefix still reaches ``MIN_WORDS`` words begins a suffix
   of its own, these are sorted again, and neighbours with ``MIN_WORDS`` words in
   common are matches.  In such a run the smallest document keeps its words.

Neighbours in suffix order share at least what any two suffixes around them do,
so the result is exact, and a run of any length is passed in linear work.

Cases: as in ``automaton``: null or blank text has no words; rows without doc_id
keep all words and cover nothing; rows of one doc_id do not cover each other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .columns import table

MIN_WORDS = 50
ANCHOR_WORDS = 8
_ROWS = 1 << 15


def _rows(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Matrix of n[i] words from at[i] on, zero-padded."""
    place = np.arange(int(n.max(initial=0)))
    inside = place < n[:, None]
    got = np.zeros(inside.shape, np.uint32)
    got[inside] = words[(at[:, None] + place)[inside]]
    return got


def _suffix_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows by their words."""
    key = np.ascontiguousarray(rows.astype(">u4")).view(f"V{4 * rows.shape[1]}").ravel()
    return np.argsort(key, kind="stable")


def _common_prefix(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words that each row of a sorted matrix shares with the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), _ROWS):
        x, y = slice(a, a + _ROWS), slice(a - 1, min(a + _ROWS, len(rows)) - 1)
        differ = rows[x] != rows[y]
        out[x] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[x] = np.minimum(out[x], np.minimum(n[x], n[y]))
    return out


def _extended(words: np.ndarray, at: np.ndarray, starts: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the suffixes with ``run`` words that a smaller document has.

    Piece i, at word at[i], begins a suffix at each of its first starts[i] words.
    """
    piece = np.repeat(np.arange(len(at)), starts)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(starts) - starts, starts)
    rows = words[(at[piece] + start)[:, None] + np.arange(run)]
    order = _suffix_order(rows)
    same = _common_prefix(rows[order], np.full(len(order), run)) == run
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc[piece[order]], head)
    later = order[doc[piece[order]] > np.repeat(least, np.diff(np.append(head, len(order))))]
    return piece[later], start[later]


def shard_spans(head: np.ndarray, words: np.ndarray, run: int) -> list[np.ndarray]:
    """[docs, first, last] spans of one shard's pieces (rows doc, begin, size, offset of the suffix)."""
    pieces = repeats.Pieces(head, words)
    out = [pieces.later]
    groups = [g for g in pieces.by_anchor(words, min(ANCHOR_WORDS, run)) if len(g) > 1]
    while groups:  # some groups at a time, to bound the matrices
        take, n = [], 0
        while groups and (not take or n + len(groups[-1]) <= _ROWS):
            take.append(groups.pop())
            n += len(take[-1])
        i = np.concatenate(take)
        off, size, at = pieces.offset[i], pieces.size[i], pieces.at[i]
        rows = _rows(words, at + off, size - off)
        order = _suffix_order(rows)
        i, off, size, at = i[order], off[order], size[order], at[order]
        before = _common_prefix(rows[order], size - off)
        best = np.maximum(before, np.append(before[1:], 0))
        starts = np.clip(np.minimum(size, off + best) - run + 1, 0, off + 1)
        alive = starts > 0
        if alive.any():
            k, first = _extended(words, at[alive], starts[alive], pieces.doc[i[alive]], run)
            out.append(pieces.spans(i[alive][k], first, first + run))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts of the kept words, joined by single spaces."""
    return repeats.without_repeats(docs, id_col, text_col, run, ANCHOR_WORDS, shard_spans, share=0.25)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "text")
