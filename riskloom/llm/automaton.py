"""Substring dedup: suffix automata of reference shards, matching statistics, span removal.

A word is removed if some run of ``MIN_WORDS`` consecutive words that covers it
also starts in a document with a smaller doc_id; runs are judged on the input.

One automaton of a whole corpus fits nowhere, so the reference is cut into
shards that hold everything a run can match.  Each run of words has one anchor:
the 5 words within it whose hash is least.  Equal runs have equal anchors, so:

1. anchors of all documents are compared; one that is found in a single
   document cannot belong to a repeated run, and its words are done with;
2. for every other anchor the words around it (all runs it is the anchor of)
   go to the anchor's shard.  Equal pieces meet as one, with their smallest
   doc_id, in the map task already; the later ones are covered at once;
3. each shard's task builds one suffix automaton, online, in order of doc_id.
   Every piece is streamed through it: where the matching statistic reaches
   ``MIN_WORDS``, the state's first document tells whether the run is covered.
   A piece with a new run is then added;
4. covered spans return to their documents, which drop the words.

Shards are routed, not broadcast: their number follows the corpus, so no bound
holds for all of them together, while each stays near ``blobs.BUCKET_BYTES``
and each automaton near ``TREE_WORDS`` states.

Cases: null or blank text has no words; rows with a null doc_id keep all words
and cover nothing; rows of one doc_id do not cover each other; texts of
fewer words than a run stay whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .columns import table

MIN_WORDS = 13
ANCHOR_WORDS = 5
TREE_WORDS = 100_000


class SuffixAutomaton:
    """Online suffix automaton of several pieces, with each state's first document."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.doc = [0]

    def add(self, piece: list[int], doc: int) -> None:
        nxt, link, size, docs = self.next, self.link, self.size, self.doc
        last = 0
        for c in piece:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(size)
                nxt.append({})
                size.append(size[last] + 1)
                docs.append(doc)
                link.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    continue
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                p, cur = last, None
            clone = len(size)
            nxt.append(nxt[q].copy())
            size.append(size[p] + 1)
            docs.append(docs[q])
            link.append(link[q])
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if cur is None:
                last = clone
            else:
                link[cur] = clone
                last = cur

    def first_docs(self, piece: list[int], run: int) -> list[int | None]:
        """For each run of ``run`` words of the piece, the first document added that has it."""
        nxt, link, size, docs = self.next, self.link, self.size, self.doc
        out, v, n = [], 0, 0
        for i, c in enumerate(piece):
            while v and c not in nxt[v]:
                v = link[v]
                n = size[v]
            q = nxt[v].get(c)
            if q is None:
                n = 0
            else:
                v, n = q, n + 1
                if n >= run:
                    while size[link[v]] >= run:
                        v = link[v]
                    n = run
            if i >= run - 1:
                out.append(docs[v] if n >= run else None)
        return out


def shard_spans(head: np.ndarray, words: np.ndarray, run: int) -> list[np.ndarray]:
    """[docs, first, last]: covered word spans of one shard's pieces (rows doc, begin, size, offset).

    Pieces of different anchors share no run, so anchors with one kind of piece
    are done, and the others fill automata of about ``TREE_WORDS`` words.
    """
    pieces = repeats.Pieces(head, words)
    groups = [g for g in pieces.by_anchor(words, min(ANCHOR_WORDS, run)) if len(g) > 1]
    tree, flat = SuffixAutomaton(), words.tolist() if groups else []
    owner, at = [], []
    for group in groups:
        if len(tree.size) > TREE_WORDS:
            tree = SuffixAutomaton()
        for i in group.tolist():
            d, a = int(pieces.doc[i]), int(pieces.at[i])
            piece = flat[a:a + int(pieces.size[i])]
            found = tree.first_docs(piece, run)
            if None in found:
                tree.add(piece, d)
            for k, e in enumerate(found):
                if e is not None and e < d:
                    owner.append(i)
                    at.append(k)
    first = np.array(at, np.int64)
    return [pieces.later, pieces.spans(np.array(owner, np.int64), first, first + run)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts of the kept words, joined by single spaces."""
    return repeats.without_repeats(docs, id_col, text_col, run, min(ANCHOR_WORDS, run), shard_spans, share=0.8)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
