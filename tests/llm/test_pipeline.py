"""Every stage against a brute-force version on its own input, and run() end to end."""

import random

import corpus_pipeline as cp
from riskloom.llm import decontaminate as dc
from . import corpus, test_line_dedup
from .test_decontaminate import lower

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, tmp_path):
    rng = random.Random(6)
    texts = [t for t in corpus.corpus(6, 70)]
    items = [(i, " ".join(corpus.words(corpus.corpus(50 + i, 8)[3] or "")[:40] or ["w"] * 12)) for i in range(4)]
    items = [(i, " ".join(f"{w}{i}" for w in t.split())) for i, t in items]
    texts += [f"{rng.choice(corpus.words(texts[0]) or ['x'])} before\n{items[i % 4][1]}\nafter {i}" for i in range(8)]
    texts += ["12 34", "!!!"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_on_their_own_input(spark, tmp_path):
    sf, items = table(spark, tmp_path)
    docs = cp.table(spark, sf, "documents")
    frames = [docs]
    for name, stage in cp.STAGES:
        frames.append(cp.written(stage(spark, frames[-1], sf), name))
    start, lang, lines, near, clean, packed = frames
    for f in frames[:-1]:
        assert f.columns == COLUMNS
    assert rows_of(lang) == [(i, t) for i, t in rows_of(start.where("text is not null")) if any(c.isalpha() for c in t)]
    before = rows_of(lang)
    want = {i: v for i, v in test_line_dedup.brute(before).items()}
    assert rows_of(lines) == sorted((i, t) for i, (n, t) in want.items() if n == 0 or corpus.words(t))
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    keep = corpus.near_duplicates(rows_of(lines))
    assert rows_of(near) == [(i, t) for i, t in rows_of(lines) if keep[i][2]]
    bad = {i for i, t in rows_of(near) for _, x in items
           if corpus.word_edits(lower(x), lower(t)) <= int(dc.EDIT_RATE * len(lower(x)))}
    assert bad and rows_of(clean) == [(i, t) for i, t in rows_of(near) if i not in bad]
    sizes = {i: len(corpus.words(t)) for i, t in rows_of(clean)}
    got = packed.toPandas()
    assert got.groupby("doc_id").n_words.sum().to_dict() == sizes


def test_run_gives_the_last_stage(spark, tmp_path):
    sf, _ = table(spark, tmp_path)
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start_word", "n_words", "bin_id", "slot"] and out.count() > 10


def test_empty_documents(spark, tmp_path):
    sf, _ = table(spark, tmp_path / "a")
    cp.table(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    cp.table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_contaminated_documents_without_id_go(spark, tmp_path):
    sf, items = table(spark, tmp_path)
    dirty, clean = f"before {items[0][1]} after", "nothing of that kind is in here"
    rows = [(None, dirty, 0), (None, dirty, 1), (None, clean, 2), (None, None, 3), (42, clean, 4), (7, dirty, 5)]
    docs = spark.createDataFrame([(i, t, None, None, n) for i, t, n in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.n_chars for r in cp.decontamination(spark, docs, sf).collect()) == [2, 3, 4]
