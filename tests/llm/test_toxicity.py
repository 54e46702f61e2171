import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import toxicity as tx

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BAD = ["nasty", "vile", "rotten"]


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, labelled):
    """Value of each text, and the threshold and scale, by dictionaries."""
    left = {True: defaultdict(set), False: defaultdict(set)}
    for text, toxic in labelled:
        w = words(text)
        for v, x in zip([None, *w], w):
            left[toxic][x].add(v)
    rest = {c: {w: len(s) - 1 for w, s in left[c].items() if len(s) > 1} for c in left}
    total = {c: sum(rest[c].values()) for c in rest}
    balance = total[True] / total[False]

    def price(w):
        return math.log((rest[True].get(w, 0) + tx.K) / (rest[False].get(w, 0) * balance + tx.K))
    value = [sum(map(price, words(t))) / (len(words(t)) + tx.PRIOR_WORDS) for t in docs]
    return value


def texts(seed=1, n=160):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéñ漢") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 30, 80, 200]))]
        bad = i % 4 == 0 and len(w) > 3
        if bad:
            for _ in range(max(2, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD).title())
        out.append((" ".join(x + rng.choice(["", "", ",", ".\n"]) for x in w), bad))
    return out + [(None, False), ("", True), (" .!\n", False), ("é" * 20_000, False), ("nasty " * 9000, True)]


@pytest.fixture()
def tables(spark):
    rows = texts()
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    learn = [(i, t, int(b)) for i, (t, b) in enumerate(rows) if i % 3 and i != 5]
    return rows, docs, spark.createDataFrame(learn, "doc_id long, text string, toxic int"), learn


@pytest.mark.parametrize("block,bucket", [(tx.BLOCK_WORDS, tx.BUCKET_BYTES), (300, 1000)])
def test_values_equal_brute_force(tables, monkeypatch, block, bucket):
    monkeypatch.setattr(tx, "BLOCK_WORDS", block)
    monkeypatch.setattr(tx, "BUCKET_BYTES", bucket)
    rows, docs, labelled, learn = tables
    got = tx.toxicity(docs, labelled).collect()
    want = brute([t for t, _ in rows], [(t, b == 1) for _, t, b in learn])
    key = lambda i: -1 if i is None else i
    have = {key(r.doc_id): r for r in got}
    assert len(got) == len(rows) == len(have)
    for i, v in enumerate(want):
        r = have[-1 if i == 5 else i]
        assert r.value == pytest.approx(v, abs=1e-6) and 0 <= r.score <= 1
    order = sorted(got, key=lambda r: r.value)
    assert all(a.score <= b.score for a, b in zip(order, order[1:]))


def test_threshold_is_the_best_f1(tables):
    rows, docs, labelled, learn = tables
    got = {r.doc_id: r for r in tx.toxicity(docs, labelled).collect()}
    at = Counter(round(got[i].value * tx.BINS) for i, _, _ in learn)

    def f1(pred):
        hit = sum(p and b for p, (_, _, b) in zip(pred, learn))
        return 2 * hit / (sum(pred) + sum(b for _, _, b in learn))
    best = max(f1([round(got[i].value * tx.BINS) >= t for i, _, _ in learn]) for t in at if t > 0)
    assert f1([got[i].score >= tx.THRESHOLD for i, _, _ in learn]) == pytest.approx(best)


def test_copies_and_repeats_add_no_evidence(spark):
    plain = [(i, f"a{i} words b{i} common here", 0) for i in range(30)]
    toxic = [(100 + i, f"x{i} vile y{i} words", 1) for i in range(10)]
    copies = [(200 + i, "odd one out", 1) for i in range(50)] + [(300, "echo " * 500, 1)]
    rows = spark.createDataFrame(plain + toxic + copies, "doc_id long, text string, toxic int")
    prices = {r.w: r.price for r in tx.fit(rows, 3).collect()}
    of = lambda w: prices.get(int(tx.tokens([w.encode()])[0].view(np.int64)[0]), 0.0)
    assert of("vile") > 1 and of("odd") == 0 and of("out") == 0
    assert of("echo") < math.log(1.5) and of("words") < of("vile")


def test_one_class_empty_tables_and_labels(spark, tables):
    _, docs, labelled, _ = tables
    assert {r.score for r in tx.toxicity(docs, labelled.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in tx.toxicity(docs, labelled.limit(0)).collect()} == {0.0}
    assert tx.toxicity(docs.limit(0), labelled).count() == 0
    twice = labelled.unionByName(labelled.withColumn("toxic", F.lit(None).cast("int")))
    a = {r.doc_id: r.score for r in tx.toxicity(docs, labelled).collect()}
    assert a == {r.doc_id: r.score for r in tx.toxicity(docs.withColumn("value", F.lit("x")), twice).collect()}


def test_query_contract(spark, sf_small):
    rows = tx.op13_toxicity(spark, sf_small).collect()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_accuracy(spark):
    """The documents of the test data that carry words found in toxic texts only, by labels the model did not see."""
    d = "/root/testdata/sf0.1"
    got = tx.op13_toxicity(spark, d).where("held_out").toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    t = docs.join(labels, "doc_id").select("doc_id", "toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    share = t.select("toxic", F.explode("w").alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 80 and b <= 1")
    has = t.select("doc_id", F.explode("w").alias("w")).join(share, "w").select("doc_id").distinct().toPandas()
    m = got.merge(t.select("doc_id").toPandas(), on="doc_id")
    truth = m.doc_id.isin(has.doc_id)
    assert m.predicted[truth].mean() > 0.75 and m.predicted[~truth].mean() < 0.03


def brute_pairs(docs, labelled, evidence):
    """Value of each text by dictionaries, with word pairs on top."""
    seen = {c: (defaultdict(set), defaultdict(set)) for c in (True, False)}
    for text, toxic in labelled:
        w = words(text)
        for u, v, x in zip([None, None, *w], [None, *w], w):
            seen[toxic][0][x].add(v)
            seen[toxic][1][v, x].add(u)
    rest = {c: [{k: len(s) - 1 for k, s in level.items() if len(s) > 1} for level in seen[c]] for c in seen}
    balance = [sum(rest[True][i].values()) / sum(rest[False][i].values()) for i in (0, 1)]

    def price(v, w):
        t, o = ([rest[c][i].get(k, 0) for i, k in enumerate((w, (v, w)))] for c in (True, False))
        r = math.sqrt((t[0] + tx.K) / (o[0] * balance[0] + tx.K))
        p = math.log((t[1] + tx.K * r) / (o[1] * balance[1] + tx.K / r))
        return p if abs(p) >= evidence else 0.0
    return [sum(price(v, w) for v, w in zip([None, *words(t)], words(t))) / (len(words(t)) + tx.PRIOR_WORDS) for t in docs]


@pytest.mark.parametrize("evidence", [0.0, 0.4])
@pytest.mark.parametrize("block,bucket", [(tx.BLOCK_WORDS, tx.BUCKET_BYTES), (300, 1000)])
def test_pair_values_equal_brute_force(tables, monkeypatch, block, bucket, evidence):
    monkeypatch.setattr(tx, "BLOCK_WORDS", block)
    monkeypatch.setattr(tx, "BUCKET_BYTES", bucket)
    rows, docs, labelled, learn = tables
    have = {r.doc_id: r for r in tx.toxicity(docs, labelled, order=2, evidence=evidence).collect()}
    want = brute_pairs([t for t, _ in rows], [(t, b == 1) for _, t, b in learn], evidence)
    words_only = brute([t for t, _ in rows], [(t, b == 1) for _, t, b in learn])
    assert len(have) == len(rows) and want != pytest.approx(words_only)
    for i, v in enumerate(want):
        assert have[None if i == 5 else i].value == pytest.approx(v, abs=1e-6)


def test_a_pair_of_ordinary_words_tells(spark):
    """All words are as frequent in either class; only the pairs are not."""
    rng = random.Random(3)
    fill = [f"f{i}" for i in range(40)]

    def text(bad):
        w = [rng.choice(fill) for _ in range(30)]
        for a in (["red fox", "old car"] * 2 if bad else ["red car", "old fox"] * 2):
            w.insert(rng.randrange(len(w)), a)
        return " ".join(w)
    rows = [(i, text(i % 2 == 0), int(i % 2 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = tx.toxicity(df, df.where("doc_id < 120"), order=2, evidence=0.7).where("doc_id >= 120").collect()
    assert sum((r.score >= tx.THRESHOLD) == (r.doc_id % 2 == 0) for r in got) >= 72


def test_query_finds_toxic_words_of_rare_languages(spark, tmp_path):
    """Few documents of one language, whose toxic words are their own; nothing but the labels of other documents tells."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        mark = "ab"[i % 6 == 0]
        vocab = [f"{mark}{k}" for k in range(60 if mark == "a" else 400)]
        bad = i % 5 == 0
        w = [rng.choice(vocab) for _ in range(80)]
        if bad:
            w[10:70:20] = [f"{mark}{rng.choice(BAD)}" for _ in range(3)]
        rows.append((i, " ".join(w), int(bad)))
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, b) for i, _, b in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in tx.op13_toxicity(spark, str(tmp_path)).collect()}
    held = [(got[i], b) for i, _, b in rows if got[i].held_out]
    assert len(got) == 900 and sum(r.predicted == b for r, b in held) >= 0.97 * len(held)


def brute_mixture(docs, labelled, k, pair_k, share):
    """Value of each text by dictionaries: every word and pair pays, mixture of the classes, normalised by the left word."""
    seen = {c: (defaultdict(set), defaultdict(set)) for c in (True, False)}
    for text, toxic in labelled:
        w = words(text)
        for u, v, x in zip([None, None, *w], [None, *w], w):
            seen[toxic][0][x].add((u, v))
            seen[toxic][1][v, x].add(u)
    rest = {c: [{a: len(s) - 1 for a, s in level.items() if len(s) > 1} for level in seen[c]] for c in seen}
    balance = [sum(rest[True][i].values()) / sum(rest[False][i].values()) for i in (0, 1)]

    def g(v, w):
        t, o = ([rest[c][i].get(a, 0) for i, a in enumerate((w, (v, w)))] for c in (True, False))
        r = math.sqrt((t[0] + k) / (o[0] * balance[0] + k))
        return 1 - share + share * (t[1] + pair_k * r) / (o[1] * balance[1] + pair_k / r)
    n = {a: rest[True][1].get(a, 0) + rest[False][1].get(a, 0) for c in rest for a in rest[c][1]}
    mean = sum(n[v, w] * g(v, w) for v, w in n) / sum(n.values())
    after = defaultdict(list)
    for v, w in n:
        after[v].append((n[v, w], g(v, w) / mean))
    z = {v: math.log((sum(a * b for a, b in x) + 1) / (sum(a for a, _ in x) + 1)) for v, x in after.items()}
    return [sum(math.log(g(v, w)) - z.get(w, 0.0) for v, w in zip([None, *words(t)], words(t))) / (len(words(t)) + tx.PRIOR_WORDS) for t in docs]


@pytest.mark.parametrize("block,bucket", [(tx.BLOCK_WORDS, tx.BUCKET_BYTES), (300, 1000)])
def test_mixture_prices_every_word_as_brute_force(tables, monkeypatch, block, bucket):
    monkeypatch.setattr(tx, "BLOCK_WORDS", block)
    monkeypatch.setattr(tx, "BUCKET_BYTES", bucket)
    rows, docs, labelled, learn = tables
    have = {r.doc_id: r for r in tx.toxicity(docs, labelled, order=2, k=1.0, pair_k=3.0, share=0.05).collect()}
    for i, v in enumerate(brute_mixture([t for t, _ in rows], [(t, b == 1) for _, t, b in learn], 1.0, 3.0, 0.05)):
        assert have[None if i == 5 else i].value == pytest.approx(v, abs=1e-6)


def test_query_leaves_no_word_out(spark, tmp_path):
    """Words that lean to a class by less than a factor of two decide, if there are many of them."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        rows.append((i, " ".join(rng.choice("abcdefgh"[:4] if rng.random() < (0.6 if bad else 0.4) else "efgh") + str(rng.randrange(6)) for _ in range(300)), int(bad)))
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, b) for i, _, b in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in tx.op13_toxicity(spark, str(tmp_path)).collect()}
    held = [(got[i], b) for i, _, b in rows if got[i].held_out]
    assert sum(r.predicted == b for r, b in held) >= 0.9 * len(held)
