import random

from riskloom.llm import quality_rules as q
from . import corpus


def brute(text):
    w = corpus.words(text)
    lines = [x for x in (text or "").split("\n") if corpus.words(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_equals_brute_force(docs):
    rng = random.Random(2)
    texts = corpus.corpus(4) + ["# * $ % & | < >", "a\na\n\n \nb\na ", "w " * 5000, "  lead\x0b\x0cmid\rend  ", " x y"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (8, 9, 40, 200)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in q.quality_rules(docs(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_are_the_table(docs):
    good = "the cat and the dog were in a house that was on the hill and they had to go to it for a walk with us"
    texts = [good, good.replace("the", "###"), " ".join(["xylophonesandmore"] * 5 + [f"longlongword{i}" for i in range(20)])]
    rows = {r.doc_id: r for r in q.quality_rules(docs(texts)).collect()}
    assert rows[0].kept and rows[0].failed_rules == []
    assert not rows[1].kept and "symbols" in rows[1].failed_rules
    assert not rows[2].kept and {"long_words", "stop_words"} <= set(rows[2].failed_rules)
    none = q.quality_rules(docs(texts), rules=()).where("not base_failed and not kept")
    assert none.count() == 0


def test_filter_on_the_verdict_and_clashing_names(docs):
    df = docs([(1, "a b", 5), (None, None, 5), (1, "a b", 5)], "doc_id long, text string, n_words int")
    out = q.quality_rules(df)
    assert out.where("kept").count() == 0 and out.count() == 3
    assert q.quality_rules(df.limit(0)).count() == 0
    plan = out.where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
