import random

import pytest

from riskloom.llm import line_dedup as d
from . import corpus


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    at = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            w = tuple(corpus.words(x))
            if len(w) >= d.EXACT_WORDS:
                at[w] = min(at.get(w, (i, k)), (i, k))
    first = sorted((p, w) for w, p in at.items())
    near = {w for k, (_, w) in enumerate(first) for _, v in first[:k] if max(len(v), len(w)) >= d.NEAR_WORDS and one_edit(v, w)}
    out = {}
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n"))
                if len(w := tuple(corpus.words(x))) < d.EXACT_WORDS or (w not in near and at[w] == (i, k))]
        out[i] = (t is not None and len(t.split("\n")) - len(kept) or 0, None if t is None else "\n".join(kept))
    return out


def lines(seed, n=50):
    rng = random.Random(seed)
    vocab = corpus.vocabulary(rng, 60)
    pool = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 20, 40]))] for _ in range(60)]
    for _ in range(60):
        w = list(rng.choice([x for x in pool if x]))
        p = rng.randrange(len(w))
        w[p:p + 1] = rng.choice([[], [rng.choice(vocab)], [w[p], rng.choice(vocab)]])
        pool.append(w)
    return [(i, "\n".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rows = lines(seed)
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_lines_removed, r.text) for r in d.line_dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_long_line_and_hot_template(docs):
    rows = [(i, f"page {i} of the very same long report of ours\n" + "w " * 3000 + str(i)) for i in range(60)]
    got = {r.doc_id: (r.n_lines_removed, r.text) for r in d.line_dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_nulls_repeats_empty_and_other_columns(docs):
    t = "one two three four five six seven eight\nx"
    rows = [(5, t, 1), (5, t, 1), (None, t, 2), (6, None, 3), (7, t.replace("four", "4"), 4), (8, "", 5)]
    df = docs(rows, "doc_id long, text string, line int").withColumnRenamed("line", "c0")
    got = sorted(map(tuple, d.line_dedup(df).collect()), key=str)
    assert got == sorted([(5, t, 1, 0), (5, t, 1, 0), (None, t, 2, 0), (6, None, 3, 0), (7, "x", 4, 1), (8, "", 5, 0)], key=str)
    assert d.line_dedup(docs([])).count() == 0


def test_plan_has_no_python(docs):
    plan = d.line_dedup(docs(lines(3, 10)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_only_the_dropped_lines_stay_stored(spark, docs):
    """Deletions outweigh the text: they must not stay on disk while the texts are joined, nor after the query."""
    import os

    from riskloom.llm.shared import _folder
    root = _folder(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert d.line_dedup(docs(lines(8))).count() == len(lines(8))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"dropped-lines"}
