import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import minhash
from riskloom.llm.components import components
from . import corpus


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    texts = corpus.corpus(seed)
    want = corpus.near_duplicates(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(texts)).collect()}
    assert got == want


def test_large_group_of_near_copies_is_whole(docs):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
    texts = []
    for k in range(150):
        w = list(base)
        for p in rng.choice(len(w), 5, replace=False):
            w[p] = f"z{k}_{p}"
        texts.append(" ".join(w))
    want = corpus.near_duplicates(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(texts)).collect()}
    assert got == want


def test_signature_is_the_least_rank_of_full_permutations():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 900)]
    got = minhash.super_minhash(sets, 16)
    for s, row in zip(sets, got):
        want = np.full(16, np.inf)
        for h in s:
            p = list(range(16))
            for j in range(16):
                u = minhash.mix64(np.array([h]) + minhash.salt(j + 1))
                k = j + int(minhash.mix64(u)[0] % np.uint64(16 - j))
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j + float(u[0] >> np.uint64(11)) * 2.0 ** -53)
        assert np.array_equal(row, want)


def test_nulls_repeats_empty_and_other_columns(spark, docs):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 2), (7, None, 3), (3, "A b c d E f", 4)]
    df = docs(rows, "doc_id long, text string, key int").withColumn("n", F.lit(1)).withColumn("rep", F.lit("x"))
    got = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [
        (-1, 2, -1, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (7, 0, 7, True)]
    assert minhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("per_task", [5, 1000])
def test_components_across_tasks(spark, per_task):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(links, "a long, b long").repartition(12)
    got = {r.node: r.component for r in components(df, per_task).collect()}
    want = corpus.components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != v}


def test_masks_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 50, 3000):
        a, b = (np.unique(rng.integers(0, 2 * n, n).astype(np.int64)) for _ in range(2))
        bits = np.bitwise_count((minhash.parity_mask(a) ^ minhash.parity_mask(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))
