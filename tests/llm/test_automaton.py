import hashlib
import random

import pytest

from riskloom.llm import automaton
from . import corpus


def brute(rows, run):
    cover = corpus.covered_words(rows, run)
    out = {}
    for i, t in rows:
        w = corpus.words(t)
        kept = [x for p, x in enumerate(w) if p not in cover[i]]
        out[i] = (len(w), len(w) - len(kept), " ".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rows = list(enumerate(corpus.corpus(seed)))
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in automaton.substring_dedup(docs(rows)).collect()}
    assert got == brute(rows, automaton.MIN_WORDS)


def test_equals_brute_force_in_small_slices(docs, monkeypatch):
    """One text per slice: nothing is settled in the map task."""
    rows = list(enumerate(corpus.corpus(9)))
    df = docs(rows).repartition(len(rows))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in automaton.substring_dedup(df).collect()}
    assert got == brute(rows, automaton.MIN_WORDS)


def test_automaton_finds_the_first_document_of_each_run():
    rng = random.Random(4)
    tree, pieces = automaton.SuffixAutomaton(), []
    for doc in range(60):
        piece = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        want = []
        for p in range(len(piece) - 3):
            has = [d for d, q in pieces if any(q[k:k + 4] == piece[p:p + 4] for k in range(len(q) - 3))]
            want.append(min(has, default=None))
        assert tree.first_docs(piece, 4) == want
        tree.add(piece, doc)
        pieces.append((doc, piece))


def test_nulls_repeats_empty_and_other_columns(docs):
    long_ = " ".join(f"w{i}" for i in range(20))
    rows = [(2, long_, 1), (2, long_, 1), (None, long_, 2), (4, None, 3), (9, "x " + long_, 4)]
    got = automaton.substring_dedup(docs(rows, "doc_id long, text string, first int")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.text) for r in got) == [
        (-1, 20, 0, long_), (2, 20, 0, long_), (2, 20, 0, long_), (4, 0, 0, ""), (9, 21, 20, "x")]
    assert automaton.substring_dedup(docs([])).count() == 0
