import random

import pytest

from riskloom.llm import suffix_array as s
from . import corpus


def rows(seed):
    rng = random.Random(seed)
    vocab = corpus.vocabulary(rng, 500)
    text = lambda a, b: [rng.choice(vocab) for _ in range(rng.randint(a, b))]
    passages = [text(50, 130) for _ in range(5)]
    out = []
    for i in range(120):
        w = text(0, 160)
        if i % 2:
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 10, 45])
            at = rng.randint(0, len(w))
            w[at:at] = p[cut:]
        if out and i % 11 == 0:
            w = corpus.words(rng.choice(out)[1])
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    data = rows(seed)
    cover = corpus.covered_words(data, s.MIN_WORDS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in s.suffix_dedup(docs(data)).collect()}
    for i, t in data:
        w = corpus.words(t)
        kept = [x for p, x in enumerate(w) if p not in cover[i]]
        assert got[i] == (len(w), len(w) - len(kept), " ".join(kept)), i


def test_one_text_per_slice(docs):
    data = rows(7)
    cover = corpus.covered_words(data, s.MIN_WORDS)
    got = {r.doc_id: r.n_removed for r in s.suffix_dedup(docs(data).repartition(len(data))).collect()}
    assert got == {i: len(cover[i]) for i, _ in data}


def test_nulls_repeats_empty_and_other_columns(docs):
    t = " ".join(f"w{i}" for i in range(60))
    data = [(2, t, 1), (2, t, 1), (None, t, 2), (4, None, 3), (9, "x " + t, 4), (10, "short", 5)]
    got = s.suffix_dedup(docs(data, "doc_id long, text string, size int")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 60, 0), (2, 60, 0), (2, 60, 0), (4, 0, 0), (9, 61, 60), (10, 1, 0)]
    assert s.suffix_dedup(docs([])).count() == 0
