import math
import random

import numpy as np

from riskloom.llm import lang_ppm as p


def slow_bits(model, lang, text):
    """Code length by walking the context tree byte by byte."""
    grams, n = model.counts[model.langs.index(lang)]
    seen = dict(zip(grams.tolist(), n.tolist()))
    tree = {}
    for g, c in seen.items():
        digits = []
        for _ in range(p.ORDER + 1):
            digits.append(g % p.ALPHABET)
            g //= p.ALPHABET
        digits = tuple(reversed(digits))
        for order in range(p.ORDER + 1):
            node = tree.setdefault(digits[p.ORDER - order:p.ORDER], {})
            node[digits[-1]] = node.get(digits[-1], 0) + c
    f = [int(x) for x in model.fold[np.frombuffer(p._PAD + text, np.uint8)]]
    bits = 0.0
    for i in range(p.ORDER, len(f)):
        for order in range(p.ORDER, -2, -1):
            if order < 0:
                bits += math.log2(p.ALPHABET)
                break
            node = tree.get(tuple(f[i - order:i]))
            if not node:
                continue
            t, q = sum(node.values()), len(node)
            if f[i] in node:
                bits += math.log2(t + q) - math.log2(node[f[i]])
                break
            bits += math.log2(t + q) - math.log2(q)
        if f[i] == p.ALPHABET - 1:
            bits += math.log2(model.rest)
    return bits


def test_table_gives_the_code_lengths_of_the_tree():
    rng = random.Random(1)
    make = lambda a, n: "".join(rng.choice(a) for _ in range(n)).encode()
    model = p.PPM({"x": [make("aabc é", 300), make("ab", 50)], "y": [make("bcdeÜ ", 300)]})
    texts = [b"a", make("abcé ", 70), make("Zq~bü", 40), b"", make("aabc", 200)]
    cost = model.table()
    got = p.code_lengths(model, cost, texts)
    want = [[slow_bits(model, x, t) for x in model.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-5, atol=200 / 1024)  # half a unit a byte


def test_slices_do_not_change_code_lengths(monkeypatch):
    model = p.PPM({"x": [b"hello world " * 9], "y": [b"hallo welt " * 9]})
    cost, texts = model.table(), [b"hello " * 50, b"", b"welt", b"hallo " * 33]
    want = p.code_lengths(model, cost, texts)
    monkeypatch.setattr(p, "_SPAN", 17)
    assert np.allclose(p.code_lengths(model, cost, texts), want)


def test_held_out_accuracy(spark, sf_small):
    out = p.op8_language_id(spark, sf_small)
    lang = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(lang, "doc_id").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert held[1] > 20 and held[0] > 0.97
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_nulls_letters_repeats_and_clashing_names(spark):
    rows = [(1, "the cat", "en", 1.0), (1, "the cat", "en", 1.0), (2, "der hund", "de", None), (3, None, "de", 0.0), (4, "12 34 !?", None, 0.0),
            (None, "der hund", None, 0.0), (6, "", "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = sorted(p.language_id(df, df).collect(), key=str)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 7 and by[1][0] == "en" and by[2][0] == by[None][0] == "de"
    assert by[3] == by[4] == by[6] == ("und", 0.0)
    none = p.language_id(df, df.where("false"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert p.language_id(df.limit(0), df).count() == 0


def test_models_with_equal_grams_and_other_counts_have_their_own_prices():
    a = p.PPM({"x": [b"ab ab ba"], "y": [b"cd"]})
    b = p.PPM({"x": [b"ab ab ba", b"ab ab ba"], "y": [b"cd"]})
    assert all(np.array_equal(m[0], n[0]) for m, n in zip(a.counts, b.counts)) and a.key != b.key
    assert np.array_equal(p._cost(a), a.table())
    assert np.array_equal(p._cost(b), b.table()) and not np.array_equal(p._cost(b), a.table())
    assert np.array_equal(p._cost(p.PPM({"x": [b"ab ab ba"], "y": [b"cd"]})), a.table())
