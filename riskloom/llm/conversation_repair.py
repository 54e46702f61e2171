"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation is empty or has roles ``s?(ua)+`` (by initial).  Per row:
Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank and
duplicate rows), Insert of an empty user or assistant turn 3; a truncated row that
stays adds 3.  Among the cheapest edit lists the ASCII-least string of initials
(D, I, K, R) wins.

Run-length dynamic programming.  A row is one of nine symbols (must go, or role
initial s/u/a/other with or without truncation); equal neighbours collapse into
runs.  What a symbol does to the costs of the four states (nothing yet, after s,
after u, after a) is a min-plus matrix; a run of length L is L's binary powers of
it, made once per worker.  Costs to go are carried backward over the runs, then
the choices are unrolled forward, halving long runs, and short stretches of a
run are remembered, so a run of a million rows costs some dozens of steps and
its own letters.

Spark's part: rows shrink to digests, equal rows combine before the shuffle, and
are range-partitioned by conversation and turn, so one conversation may span
many tasks.  A conversation inside one partition is solved there.  One that
crosses a border becomes one piece per partition: the costs and letters from each
state to each state; pieces join by the same min-plus product (at most as many
as partitions).  The letters of a piece with the same start never are a prefix of
one another (both end with a consumed row, and equal letters reach equal
states), so ranks decide ties between them.  Texts move once, to be edited and
hashed in order as a stream: a digest over a whole conversation is sequential by
nature, so a very long one is one task, but no group is held.

Cases: a null role or text reads as one space; null turns come first and do not
count for gaps, null ids are one conversation; rows of one turn come in order of
role and SHA-256 of the text, equal rows next to each other; a conversation
whose rows all go has an empty audit of Ds; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import WHITE, table
from .shared import text_batches, written

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
INF = 1 << 50
STATES = range(4)  # nothing yet, after s, after u, after a
AFTER = (2, 2, 3, 2)  # state after the user or assistant turn that may follow
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
END = (0, 2 * INSERT, INSERT, 0)
MUST_GO = 0
ROLE = {"s": 0, "u": 1, "a": 2}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_SHORT = 64

Vector = tuple[int, int, int, int]


def symbol(initial: str, gone: bool, truncated: bool) -> int:
    return MUST_GO if gone else 1 + 2 * ROLE.get(initial, 3) + truncated


def _moves(sym: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways to consume a row, in ASCII order."""
    out = [("D", DELETE, q)]
    if sym != MUST_GO:
        role, cut = (sym - 1) // 2, TRUNCATED * ((sym - 1) % 2)
        if role == 0 and q == 0:
            out.append(("K", cut, 1))
        if role == (2 if q == 2 else 1):
            out.append(("K", cut, AFTER[q]))
        out.append(("R", REROLE + cut, AFTER[q]))
    return out


def _inserted(v: Vector) -> Vector:
    """Costs to go when turns may be inserted first (three never pay: two come back to where they began)."""
    one = tuple(min(v[q], INSERT + v[AFTER[q]]) for q in STATES)
    return tuple(min(one[q], INSERT + one[AFTER[q]], INF) for q in STATES)


def _product(a, b):
    return tuple(tuple(min(min(a[q][k] + b[k][e] for k in STATES), INF) for e in STATES) for q in STATES)


def _times(m, v: Vector) -> Vector:
    return tuple(min(min(m[q][e] + v[e] for e in STATES), INF) for q in STATES)


@functools.lru_cache(maxsize=None)
def power(sym: int, k: int):
    """Transition of 2**k rows of one symbol: nine symbols, one matrix for each bit of a run length."""
    if k:
        half = power(sym, k - 1)
        return _product(half, half)
    columns = []
    for e in STATES:
        step = tuple(min((c for _, c, to in _moves(sym, q) if to == e), default=INF) for q in STATES)
        columns.append(_inserted(step))
    return tuple(zip(*columns))


def before_run(sym: int, n: int, v: Vector) -> Vector:
    """Costs to go before ``n`` rows of one symbol, from those after them."""
    k = 0
    while n >> k:
        if n >> k & 1:
            v = _times(power(sym, k), v)
        k += 1
    return v


@functools.lru_cache(maxsize=1 << 14)
def _stretch(sym: int, n: int, v: Vector, q: int) -> tuple[str, int]:
    """Letters of ``n`` rows of one symbol from state ``q``, and the state reached."""
    costs = [v]
    for _ in range(n):
        costs.append(_times(power(sym, 0), costs[-1]))
    letters = []
    for i in range(n, 0, -1):
        here, rest = costs[i], costs[i - 1]
        while True:
            moves = _moves(sym, q)
            delete = moves[0]
            if delete[1] + rest[q] == here[q]:
                letters.append("D")
                break
            if INSERT + here[AFTER[q]] == here[q]:
                letters.append("I")
                q = AFTER[q]
                continue
            letter, _, q = next(m for m in moves[1:] if m[1] + rest[m[2]] == here[q])
            letters.append(letter)
            break
    return "".join(letters), q


def _unroll_run(sym: int, n: int, v: Vector, q: int, out: list[str]) -> int:
    if n <= _SHORT:
        least = min(v)
        letters, q = _stretch(sym, n, tuple(min(x - least, INF) if x < INF else INF for x in v), q)
        out.append(letters)
        return q
    half = 1 << (n - 1).bit_length() - 1
    q = _unroll_run(sym, half, before_run(sym, n - half, v), q, out)
    return _unroll_run(sym, n - half, v, q, out)


def cheapest(runs: list[tuple[int, int]], end: Vector) -> list[tuple[int, str] | None]:
    """For each start state, cost and letters of the runs (symbol, length), given the costs after them."""
    after = [end]
    for sym, n in reversed(runs):
        after.append(before_run(sym, n, after[-1]))
    after.reverse()
    out: list[tuple[int, str] | None] = []
    for start in STATES:
        if after[0][start] >= INF:
            out.append(None)
            continue
        q, letters = start, []
        for (sym, n), v in zip(runs, after[1:]):
            q = _unroll_run(sym, n, v, q, letters)
        out.append((after[0][start], "".join(letters) + (TAIL[q] if end == END else "")))
    return out


@functools.lru_cache(maxsize=1 << 12)
def _whole(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    return cheapest(list(runs), END)[0]


def solve(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Least cost and audit of one whole conversation."""
    return _whole(tuple(runs)) if len(runs) <= _SHORT else cheapest(runs, END)[0]


def piece_table(runs: list[tuple[int, int]]) -> tuple[list[int], list[str]]:
    """Cost and letters from each state to each state (16 each; INF and "" where there is no way)."""
    costs, letters = [INF] * 16, [""] * 16
    for e in STATES:
        unit = tuple(0 if x == e else INF for x in STATES)
        for q, got in enumerate(cheapest(runs, unit)):
            if got:
                costs[4 * q + e], letters[4 * q + e] = got
    return costs, letters


def join_pieces(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int], int]:
    """Total cost, the table entry taken in each piece, and the state at the end."""
    after = [END]
    for c in reversed(costs):
        after.append(_times([c[4 * q:4 * q + 4] for q in STATES], after[-1]))
    after.reverse()
    q, taken = 0, []
    for c, rank, here, rest in zip(costs, ranks, after, after[1:]):
        ways = [4 * q + e for e in STATES if c[4 * q + e] + rest[e] == here[q]]
        best = min(ways, key=lambda i: rank[i])
        taken.append(best)
        q = best % 4
    return after[0][0], taken, q


# --- Spark -------------------------------------------------------------------

COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal"]
_PIECE = ("piece bigint, whole boolean, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "first_role string, last_role string, min_turn bigint, max_turn bigint, turns bigint, "
          "costs array<bigint>, audits array<string>")
_REPORT = "n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_TURNS = "at bigint, edit string, role string, text string"


def _schema(key: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key), *T.StructType.fromDDL(rest).fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


class _Piece:
    """The rows of one conversation seen in one partition, in order."""

    def __init__(self, conv):
        self.conv, self.runs = conv, []
        self.n = dict.fromkeys(COUNTS, 0)
        self.first = self.last = None
        self.low = self.high = None
        self.turns = 0

    def _run(self, sym: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == sym:
            self.runs[-1] = (sym, self.runs[-1][1] + n)
        elif n:
            self.runs.append((sym, n))

    def add(self, turn, role: str, n: int, blank: bool, late: bool, cut: bool) -> None:
        """``n`` equal rows; ``late`` if the same role and text came at an earlier turn."""
        c = self.n
        c["n_rows"] += n
        if self.last is None:
            self.first = role
        else:
            c["illegal"] += (self.last, role) not in LEGAL
        c["illegal"] += (n - 1) * ((role, role) not in LEGAL)
        self.last = role
        if blank:
            c["blank"] += n
        else:
            c["duplicate"] += n if late else n - 1
            c["truncated"] += cut and not late
        if blank or late:
            self._run(MUST_GO, n)
        else:
            self._run(symbol(role, False, cut), 1)
            self._run(MUST_GO, n - 1)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, piece: int, whole: bool) -> tuple:
        if whole:
            cost, audit = solve(self.runs)
            costs, audits = [cost], [audit]
        else:
            costs, audits = piece_table(self.runs)
        return (self.conv, piece, whole, *self.n.values(), self.first, self.last, self.low, self.high, self.turns, costs, audits)


def _pieces_of(schema: pa.Schema):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, whole, out = None, False, []  # the first and the last conversation may go on in other partitions
        for b in batches:
            for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row(part, whole))
                        whole = True
                    now = _Piece(conv)
                now.add(*row)
            if out:
                yield _batch(out, schema)
                out = []
        if now is not None:
            yield _batch([now.row(part, False)], schema)
    return pieces


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _joined(schema: pa.Schema):
    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["piece"])
        ranks = []
        for r in rows:
            order = {s: i for i, s in enumerate(sorted(set(r["audits"])))}
            ranks.append([order[s] for s in r["audits"]])
        cost, taken, q = join_pieces([r["costs"] for r in rows], ranks)
        audit = "".join(r["audits"][i] for r, i in zip(rows, taken)) + TAIL[q]
        n = {k: sum(r[k] for r in rows) for k in COUNTS}
        n["illegal"] += sum((a["last_role"], b["first_role"]) not in LEGAL for a, b in zip(rows, rows[1:]))
        dated = [r for r in rows if r["turns"]]
        turns = sum(r["turns"] for r in dated) - sum(a["max_turn"] == b["min_turn"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["max_turn"] - dated[0]["min_turn"] + 1 - turns if dated else 0
        one = (rows[0]["conv_id"], n["n_rows"], gaps, *(n[k] for k in COUNTS[1:]), cost, audit)
        return pa.Table.from_batches([_batch([one], schema)])
    return join


def _source(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    src = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                      space(role_col).alias("role"), space(text_col).alias("text"))
    return src.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _symbols(src: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text): how often, and its faults."""
    t = F.btrim("text", F.lit(WHITE))
    key = ["conv_id", "turn", "role", "digest"]
    light = src.select(*key, (t == "").alias("blank"), (~F.substring(t, -1, 1).isin(".", "!", "?")).alias("cut"))
    light = light.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # a struct orders null turns first, and min over it does not leave them out
    first = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return light.join(first, same).withColumn("late", F.struct("turn") > F.col("first")).drop("c", "r", "d", "first")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: faults, cost and audit (one letter per edit, in order)."""
    text_batches(rows.sparkSession)
    src = _source(rows, id_col, turn_col, role_col, text_col)
    key = src.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "digest"]
    ranged = _symbols(src).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", "turn", F.substring("role", 1, 1).alias("role"), "n", "blank", "late", "cut")
    schema = _schema(key, _PIECE)
    pieces = written(ranged.mapInArrow(_pieces_of(_arrow(schema)), schema), "conversation-pieces")
    report = _schema(key, _REPORT)
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = pieces.where("whole").select("conv_id", "n_rows", gaps, *COUNTS[1:], F.col("costs")[0].alias("cost"),
                                         F.col("audits")[0].alias("audit"))
    cut = pieces.where("not whole").groupBy("conv_id").applyInArrow(_joined(_arrow(report)), report)
    return whole.unionByName(cut)


def _edited(schema: pa.Schema):
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = None
        at = i = 0
        q = 0
        out: list[tuple] = []

        def turns(until_row: bool, role=None, text=None) -> None:
            """Inserts up to the next row, and the edit of that row."""
            nonlocal i, at, q
            while i < len(audit) and audit[i] == "I":
                out.append((conv, at, "I", "assistant" if q == 2 else "user", ""))
                q, i, at = AFTER[q], i + 1, at + 1
            if not until_row:
                return
            letter, i = audit[i], i + 1
            if letter == "R":
                role = "assistant" if q == 2 else "user"
            if letter != "D":
                q = 1 if q == 0 and letter == "K" and role[:1] == "s" else AFTER[q]
            out.append((conv, at, letter, role, text))
            at += 1
        for b in batches:
            for c, kind, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    if audit is not None:
                        turns(False)
                    conv, audit, at, i, q = c, text, 0, 0, 0
                else:
                    turns(True, role, text)
            if out:
                yield _batch(out, schema)
                out = []
        if audit is not None:
            turns(False)
        if out:
            yield _batch(out, schema)
    return edit


def repaired_turns(rows: DataFrame, report: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, edit, role, text): every edit with its turn, deleted ones included.

    The rows of a conversation are neighbours and in order; ``report`` is
    ``repair`` of the same rows.
    """
    src = _source(rows, id_col, turn_col, role_col, text_col)
    order = ["conv_id", "kind", "turn", "role", "digest"]
    heads = report.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    both = src.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")
    schema = _schema(src.schema["conv_id"].dataType, _TURNS)
    return both.mapInArrow(_edited(_arrow(schema)), schema)


def _hashed(schema: pa.Schema):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, out = None, None, []
        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if h is None or c != conv:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if out:
                yield _batch(out, schema)
                out = []
        if h is not None:
            yield _batch([(conv, h.hexdigest())], schema)
    return digest


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired_turns``, as a stream over its order."""
    schema = _schema(turns.schema["conv_id"].dataType, "repaired_sha256 string")
    return turns.where("edit <> 'D'").mapInArrow(_hashed(_arrow(schema)), schema)


# --- Query -------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a checksum of their place."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    out = rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(name("role")).alias("role"),
                                    text.alias("text"), F.when(k == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    bad = damaged(rows)
    report = written(repair(bad), "conversation-report")
    done = digests(repaired_turns(bad, report))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", *COUNTS[1:], "cost"]
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same in DuckDB SQL: checksum by bits, then one row at a time with cost and letters per state."""
    def put(state: str, letters: str, cost: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letters}}}"
    keep_u, keep_a = (f"CASE WHEN init = '{x}' THEN 'K' ELSE 'R' END" for x in "ua")
    cost_u, cost_a = (f"CASE WHEN init = '{x}' THEN 0 ELSE {REROLE} END + cut * {TRUNCATED}" for x in "ua")
    none = "{'c': 1000000000, 'a': ''}"
    gone = {q: put(f"e{q}", "'D'", str(DELETE)) for q in range(4)}
    fill = lambda q, ways: f"list_min([{gone[q]}, {', '.join(f'CASE WHEN go THEN {none} ELSE {w} END' for w in ways)}])"
    keep_s = f"CASE WHEN init = 's' THEN {put('e0', chr(39) + 'K' + chr(39), f'cut * {TRUNCATED}')} ELSE {none} END"
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
sums AS (
  SELECT k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(z AS BIGINT) for z in range(8)]),
      lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS d
  FROM (SELECT DISTINCT k FROM src)),
dmg AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src JOIN sums USING (k) WHERE d <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM dmg),
flt AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS bl, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS du,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS tr, substr(role, 1, 1) AS init FROM num),
r AS (
  SELECT conv_id, turn, i, role, text, init, bl, NOT bl AND du AS du, NOT bl AND NOT du AND tr AS tr, bl OR du AS go,
         CAST(NOT bl AND NOT du AND tr AS INT) AS cut, lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init AS pair FROM flt),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS s0, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}} AS s1,
         {{'c': CAST(1000000000 AS BIGINT), 'a': ''}} AS s2, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}} AS s3
  FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, i, {gone[0]}, {fill(1, [keep_s])}, {fill(2, [put(f'e{q}', keep_u, cost_u) for q in (0, 1, 3)])}, {fill(3, [put('e2', keep_a, cost_a)])}
  FROM (
    SELECT r.conv_id, r.i, r.init, r.go, r.cut, s0 AS e0, s1 AS e1,
           list_min([s2, {put('s0', "'I'", '3')}, {put('s1', "'I'", '3')}, {put('s3', "'I'", '3')}]) AS e2,
           list_min([s3, {put('s2', "'I'", '3')}, {put('s0', "'II'", '6')}, {put('s1', "'II'", '6')}]) AS e3
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1) e),
best AS (
  SELECT conv_id, list_min([s0, s3, {put('s2', "'I'", '3')}, {put('s1', "'II'", '6')}]) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM dp) x WHERE last = 1),
ops AS (SELECT conv_id, j, b.a[j] AS op FROM (SELECT conv_id, b, unnest(range(1, length(b.a) + 1)) AS j FROM best) x),
own AS (SELECT conv_id, j, op, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM ops),
kept AS (
  SELECT o.conv_id, o.j, o.op, r.role, r.text, row_number() OVER (PARTITION BY o.conv_id ORDER BY o.j) AS p,
         max(CASE WHEN o.op = 'K' AND r.init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS sys
  FROM own o LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = o.i AND o.op <> 'I' WHERE o.op <> 'D'),
sha AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (p - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM kept GROUP BY conv_id),
cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE bl) AS blank,
         count(*) FILTER (WHERE du) AS duplicate, count(*) FILTER (WHERE tr) AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
       coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN sha ON sha.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE = _oracle()
