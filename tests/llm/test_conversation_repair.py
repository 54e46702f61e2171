import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(initial, must go, truncated) and the counts of one conversation's rows in order."""
    seen, out, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
        seen.add((role, text))
        if kind < 3:
            n[kind] += 1
        out.append((role[:1], kind < 2, kind == 2))
    return out, n


def brute_edits(symbols):
    """Cheapest (cost, audit, roles) by trying rows in order with every state, letters kept as strings."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def better(d, state, way):
        if state not in d or way[:2] < d[state][:2]:
            d[state] = way

    def insert(d):
        for _ in range(2):
            for st, (c, a, r) in list(d.items()):
                for x in after[st].replace("s", ""):
                    better(d, x, (c + 3, a + "I", r + ((x, None),)))
        return d
    for k, (init, go, cut) in enumerate(symbols):
        new = {}
        for st, (c, a, r) in insert(dict(best)).items():
            better(new, st, (c + 4, a + "D", r))
            if not go:
                for x in after[st]:
                    if x == init:
                        better(new, x, (c + 3 * cut, a + "K", r + ((x, k),)))
                    if x != "s":
                        better(new, x, (c + 3 + 3 * cut, a + "R", r + ((x, k),)))
        best = new
    done = insert(best)
    return min(done[s] for s in ("", "a") if s in done)


def exhaustive(symbols):
    """Every edit list of up to four inserts, for very short conversations."""
    n, best = len(symbols), None
    for ops in itertools.product("DKR", repeat=n):
        for gaps in itertools.product(range(3), repeat=n + 1):
            for reroles in itertools.product("ua", repeat=ops.count("R")):
                for ins in itertools.product("ua", repeat=sum(gaps)):
                    cost, audit, roles, re_, in_ = 0, "", "", list(reroles), list(ins)
                    for k in range(n + 1):
                        for _ in range(gaps[k]):
                            cost, audit, roles = cost + 3, audit + "I", roles + in_.pop(0)
                        if k < n:
                            init, go, cut = symbols[k]
                            op = ops[k]
                            if go and op != "D":
                                cost = 10 ** 6
                            audit += op
                            cost += {"D": 4, "K": 0, "R": 3}[op] + (3 if cut and op != "D" else 0)
                            if op != "D":
                                roles += init if op == "K" else re_.pop(0)
                    if GOOD.match(roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def brute(rows):
    """{conv: result of repair and the digest} for (conv, turn, role, text) rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        symbols, n = faults(mine)
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit, roles = brute_edits(symbols)
        pairs = [a[0] + b[0] for a, b in zip(symbols, symbols[1:])]
        ops = [x for x in audit if x != "D"]
        lines = []
        for op, (x, k) in zip(ops, roles, strict=True):
            role = mine[k][1] if op == "K" else {"u": "user", "a": "assistant"}[x]
            lines.append(f"{role}:{mine[k][2] if k is not None else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Hello.", "Why?", "cut off", "", " \t\n", "Yes!", "x.\n\n", "mid. end", "…", "é。"]
    out = []
    for c in range(n):
        turn = rng.randint(0, 3)
        for _ in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            row = (c if c != 7 else None, None if rng.random() < 0.07 else turn, role, rng.choice([*texts, None, f"t{rng.random()}."]))
            out += [row] * rng.choice([1, 1, 1, 2])
            turn += rng.choice([0, 1, 1, 1, 2])
    return out


def run(df):
    report = cr.repair(df)
    done = cr.digests(cr.repaired_turns(df, report))
    j = report.join(done, report.conv_id.eqNullSafe(done.conv_id), "left").drop(done.conv_id)
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256 or empty)
            for r in j.collect()}


def test_brute_force_is_right():
    kinds = [(i, g, t) for i in "suao" for g, t in ((False, False), (False, True), (True, False))]
    for n in (0, 1, 2):
        for symbols in itertools.product(kinds, repeat=n):
            assert brute_edits(symbols)[:2] == exhaustive(symbols)


def test_run_length_solution_equals_brute_force():
    rng = random.Random(3)
    kinds = [(i, g, t) for i in "suao" for g, t in ((False, False), (False, True), (True, False))]
    for _ in range(1500):
        symbols = [k for k in rng.choices(kinds, k=rng.randint(0, 9)) for _ in range(rng.choice([1, 1, 2, 5]))]
        runs = [(s, len(list(g))) for s, g in itertools.groupby(cr.symbol(*x) for x in symbols)]
        want = brute_edits(symbols)[:2]
        assert cr.solve(runs) == want
        cuts = sorted(rng.randint(0, len(symbols)) for _ in range(rng.randint(0, 4)))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)]) if b > a]
        tables = [cr.piece_table([(s, len(list(g))) for s, g in itertools.groupby(cr.symbol(*x) for x in p)]) for p in parts]
        ranks = [[sorted(set(a)).index(x) for x in a] for _, a in tables]
        cost, taken, q = cr.join_pieces([c for c, _ in tables], ranks)
        assert (cost, "".join(a[i] for (_, a), i in zip(tables, taken)) + cr.TAIL[q]) == want


def test_long_runs():
    symbols = [("u", False, False)] * 1000 + [("a", False, True)] * 777 + [("u", True, False)] * 513 + [("s", False, False)]
    runs = [(s, len(list(g))) for s, g in itertools.groupby(cr.symbol(*x) for x in symbols)]
    assert cr.solve(runs) == brute_edits(symbols)[:2]
    million = cr.solve([(cr.MUST_GO, 1_000_000), (cr.symbol("u", False, False), 2_000_000)])
    assert million[0] == 4_000_000 + 3_000_000 and len(million[1]) == 3_000_000


@pytest.mark.parametrize("parts", [1, 9])
def test_equals_brute_force(spark, parts):
    rows = conversations(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", "cut", f"{t}."])) for t in range(3000)]
    rows += [(5, 40, "user", "Same.")] * 500 + [(c, 0, "user", "Hi.") for c in range(10)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", None if c % 9 == 0 else f"Text {c}. Is it? {t}!") for c in range(60) for t in range(6)]
    rows += [(None, 1, None, "Null id."), (3, None, "user", "Null turn.")]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else " " if role is None else role
        want += [(c, t, role, text)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in cr.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    order = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_empty_table_extra_columns_and_gone_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "", 3), (1, 1, "user", "  ", 3)], SCHEMA + ", cost int")
    assert run(df)[1][-3:] == (8, "DD", hashlib.sha256(b"").hexdigest())
    assert cr.repair(df.limit(0)).count() == 0
    turns = cr.repaired_turns(df, cr.repair(df)).collect()
    assert [(r.at, r.edit) for r in turns] == [(0, "D"), (1, "D")]


def test_query_equals_sql(spark, sf_small):
    got = [tuple(r) for r in cr.op11_conversation_repair(spark, sf_small).orderBy("conv_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_small}/conversations.parquet'")
    assert got == con.execute(cr.ORACLE + " ORDER BY conv_id").fetchall()
    ids = spark.read.parquet(f"{sf_small}/conversations.parquet").agg(F.countDistinct("conv_id")).first()[0]
    assert len(got) == ids
