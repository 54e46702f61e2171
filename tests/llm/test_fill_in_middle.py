import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import fill_in_middle as fim


def brute(doc_id, text, units=list):
    text = text or ""
    u = units(text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(u)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{z}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{z}<M>{m}"


def texts():
    rng = random.Random(5)
    out = [None, "", "a", "é", "𝒳", "<", "<P", "x<S>y", "<M>", "<P><S><M>", "\n", "\x00a", "S>" * 30, "<P" * 30, "é" * 9]
    for k in range(150):
        out.append("".join(rng.choice("ab <>PSM\né𝒳漢") for _ in range(rng.randint(1, 60))))
    out += ["a" * 200_000, "é漢" * 40_000, "word " * 30_000 + "漢" * 70_000, "".join(rng.choice("aé漢𝒳") for _ in range(90_000))]
    return out


def test_equals_brute_force_and_restores(spark, docs):
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts())]
    out = fim.fill_in_middle(docs(rows)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(out.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, t) in zip(got, want, strict=True):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(i, t)
        assert r.back == (t or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_boundary_set_selects_every_border():
    rng = random.Random(6)
    raws = [b"", b"a" * 70_000, "漢".encode() * 50_000, ("a" * 900 + "é" * 900).encode() * 100,
            "".join(rng.choice("aé漢𝒳") for _ in range(70_000)).encode()]
    kinds = set()
    for raw in raws:
        want = [i for i in range(len(raw)) if raw[i] & 0xC0 != 0x80] + [len(raw)]
        b = fim.Boundaries(raw)
        kinds |= {type(c) for c in b.containers}
        assert len(b) == len(want) - 1
        picks = {0, len(want) - 1} | {rng.randrange(len(want)) for _ in range(300)}
        assert all(b.select(k) == want[k] for k in picks)
    lines = ("x" * 100 + "\n").encode() * 3000
    b = fim.Boundaries(lines, re.compile(r"[^\n]*\n"))
    kinds |= {type(c) for c in b.containers}
    assert len(b) == 3000 and [b.select(k) for k in (0, 1, 1500, 3000)] == [0, 101, 151500, 303000]
    assert kinds == {fim.Runs, fim.Array, fim.Bitmap}
    assert np.all(np.diff(b.before) > 0)


def test_words_as_units(docs):
    rows = [(i, t) for i, t in enumerate(["one two  three", "é 漢 x", "", "  lead", "tail  "])]
    units = lambda t: re.findall(r"\S+\s*|\s+", t)
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
           for r in fim.fill_in_middle(docs(rows), unit=r"\S+\s*|\s+").collect()}
    assert got == {i: brute(i, t, units) for i, t in rows}


def test_clashing_names_empty_table_and_plan(docs):
    df = docs([(1, "abc", 5, "x"), (1, "abc", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, n int, form string")
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", *fim.RESULT]
    rows = out.collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2].form == "plain" and rows[2].n == 0
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_query_equals_sql(spark, sf_small):
    got = [tuple(r) for r in fim.op12_fill_in_middle(spark, sf_small).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    assert got == con.execute(fim.ORACLE + " ORDER BY doc_id").fetchall()
