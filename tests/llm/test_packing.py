import random

import pandas as pd
import pytest

from riskloom.llm import packing


def naive(pieces, capacity):
    """Exhaustive best fit over (size, source, cluster) in order: bin of each piece."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size
                and not (source is not None and source in b["src"]) and not (cluster is not None and cluster in b["dup"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "src": set(), "dup": set()})
        bins[k]["room"] -= size
        bins[k]["src"].add(source)
        bins[k]["dup"].add(cluster)
        out.append(k)
    return out


@pytest.mark.parametrize("n_sources", [5, 200])
def test_equals_exhaustive_best_fit(n_sources):
    rng = random.Random(n_sources)
    rows = pd.DataFrame([{"shard": 0, "doc_id": i, "n_words": rng.choice([0, rng.randint(1, 90), rng.randint(1, 400)]),
                          "source": None if rng.random() < .05 else "hot" if rng.random() < .3 else f"s{rng.randrange(n_sources)}",
                          "cluster": None if rng.random() < .2 else rng.randrange(150)} for i in range(600)])
    got = packing.pack_shard(rows, 100)
    assert got.groupby("doc_id")["n_words"].sum().to_dict() == rows.set_index("doc_id")["n_words"].to_dict()
    assert got.groupby("bin_id")["n_words"].sum().max() <= 100
    of = rows.set_index("doc_id")
    none = lambda x: None if pd.isna(x) else x
    pieces = [(n, none(of.source[d]), none(of.cluster[d])) for n, d in zip(got["n_words"], got["doc_id"])]
    assert list(got["bin_id"]) == naive(pieces, 100)


def test_whole_table_with_nulls_long_texts_and_clashing_names(spark):
    rows = [(1, "a " * 5000, "s", 1), (2, None, "s", 2), (None, "x y", None, 3), (4, "", "t", 4), (5, "q w e", "s", 5), (5, "q w e", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = packing.best_fit_packing(df).toPandas()
    assert sorted(got[got.doc_id == 1].n_words) == [904, 2048, 2048]
    assert got.groupby("bin_id").n_words.sum().max() <= 2048
    assert len(got) == 8 and got.n_words.sum() == 5008
    assert got[got.doc_id == 5].bin_id.nunique() == 2
    assert packing.best_fit_packing(df.limit(0)).count() == 0
    assert packing.best_fit_packing(df.drop("source")).count() == 8
