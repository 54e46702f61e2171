import random

from riskloom.llm import decontaminate as d
from . import corpus


def lower(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in corpus.words(text)]


def make(seed=3):
    rng = random.Random(seed)
    vocab = corpus.vocabulary(rng, 900)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(6, 70))) for i in range(25)]
    docs = []
    for k in range(150):
        w = corpus.words(text(rng.randint(5, 150)))
        if k % 3 == 0:
            item = list(corpus.words(rng.choice(items)[1]))
            for _ in range(int(len(item) * rng.choice([0, 0, 0.05, 0.1]))):
                p, how = rng.randrange(len(item)), rng.randrange(3)
                item[p:p + 1] = [] if how == 0 else [rng.choice(vocab)] if how == 1 else [item[p], rng.choice(vocab)]
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((k, " ".join(w)))
    return items, docs


def test_equals_brute_force(docs, spark):
    items, rows = make()
    got = {(r.doc_id, r.item_id): r.edits for r in d.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        w = lower(t)
        for k, item in items:
            x = lower(item)
            e = corpus.word_edits(x, w)
            if e <= int(d.EDIT_RATE * len(x)):
                want[i, k] = e
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert {k for k, e in want.items() if e == 0} <= set(got)
    assert all(got[k] == want[k] for k in got)


def test_blocks_give_the_same_rows(docs, spark, monkeypatch):
    items, rows = make(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.contaminated(docs(rows), bench).collect()))
    monkeypatch.setattr(d, "BLOCK_WORDS", 200)
    assert sorted(map(tuple, d.contaminated(docs(rows), bench).collect())) == one


def test_nulls_short_items_and_empty_tables(docs, spark):
    bench = spark.createDataFrame([(1, "alpha Beta gamma"), (2, None), (3, " "), (None, "one two three four five six")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma y", 0), (2, None, 0), (None, "zero one two three four five six", 0), (4, "alpha beta x gamma", 0), (5, "", 0)]
    got = d.contaminated(docs(rows, "doc_id long, text string, edits int"), bench).collect()
    assert sorted((r.doc_id or -1, r.item_id or -1, r.edits) for r in got) == [(-1, -1, 0), (1, 1, 0)]
    assert d.contaminated(docs([]), bench).count() == 0
    assert d.contaminated(docs(["alpha beta gamma"]), bench.limit(0)).count() == 0
