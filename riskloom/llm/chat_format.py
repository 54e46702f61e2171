"""Chat formatting: layouts chosen by schema fingerprint, one reversible template.

A layout is declared by the nested field paths it needs and a SQL expression
that yields canonical turns ``array<struct<role, text>>``.  The fingerprint of a
record is the hash of its sorted field paths, restricted to paths that any
layout knows, so additional fields do not hide a layout.  For typed columns
the paths come from the DataFrame's schema; for JSON text from the fields that
are set in each record, so one column may mix layouts.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn.  Inside roles and texts a
backslash follows every ``<``, ``[`` and backslash, so no control string of
this or another template (``</s>``, ``[INST]``) survives there; ``unescape``
undoes it exactly.  ``loss_mask`` has one entry per turn, as run lengths:
``head`` code points before the text, ``body`` code points of the escaped
text, and whether it is trained on (assistant turns).

Cases: null text or role is empty; turns sort by turn, role, text with null
first, repeated rows stay; a record of no known layout has ``layout``
"unknown" and no turns; an empty table gives an empty result; unknown extra
columns are ignored.  One conversation becomes one row, as one training example.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import computed, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Layout:
    """Field paths of a record layout and its canonical turns as SQL."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _pairs(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {c})" for r, c in pairs) + ")"


_FROM = "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END"
_ASK = "concat(instruction, '\\n\\n', input)"
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"),
           "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", ("conversations[].from", "conversations[].value"),
           f"transform(conversations, m -> named_struct('role', {_FROM}, 'text', m.value))"),
    Layout("prompt_completion", ("prompt", "completion"), _pairs(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), _pairs(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("system", "prompt", "response"),
           _pairs(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), _pairs(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("instruction", "input", "output"), _pairs(("user", _ASK), ("assistant", "output"))),
    Layout("question_answer", ("question", "answer"), _pairs(("user", "question"), ("assistant", "answer"))),
)
#: One row per turn; rows are gathered by conv_id first.
TURN_ROWS = Layout("turn_rows", ("conv_id", "turn", "role", "text"),
                   "transform(rows, m -> named_struct('role', m.role, 'text', m.text))")
RECORD = ("messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
          "prompt string, completion string, response string, system string, instruction string, input string, "
          "output string, question string, answer string")
KNOWN = tuple(sorted({p for x in (*LAYOUTS, TURN_ROWS) for p in x.paths}))


def fingerprint(paths) -> str:
    """Hash of the known field paths among ``paths``."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in (*LAYOUTS, TURN_ROWS)}


def leaf_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, ``[]`` for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, at + "[]")
    return [at]


def _record_fingerprint(r: str) -> Column:
    """Fingerprint of the fields set in the parsed record column ``r``."""
    here = []
    for p in sorted({p for x in LAYOUTS for p in x.paths}):
        arr, _, leaf = p.partition("[].")
        found = F.expr(f"exists({r}.{arr}, m -> m.`{leaf}` IS NOT NULL)" if leaf else f"{r}.{p} IS NOT NULL")
        here.append(F.when(found, F.lit(p)))
    return F.sha2(F.array_join(F.filter(F.array(*here), lambda x: x.isNotNull()), "\n"), 256)


def from_json_text(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turns) of JSON records of mixed layouts."""
    parsed = docs.select(F.col(id_col).alias("conv_id"), F.from_json(json_col, RECORD).alias("r"))
    print_ = computed(parsed, "conv_id", "r", _record_fingerprint("r").alias("fp"))
    flat = print_.select("conv_id", "fp", "r.*")
    name, turns = F.lit(UNKNOWN), F.array().cast(TURNS)
    for x in LAYOUTS:
        hit = F.col("fp") == fingerprint(x.paths)
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, F.expr(x.turns).cast(TURNS)).otherwise(turns)
    return computed(flat, "conv_id", name.alias("layout"), turns.alias("turns"))


def canonical_turns(docs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of a table whose schema matches one layout."""
    layout = BY_FINGERPRINT.get(fingerprint(p if p != id_col else "conv_id" for p in leaf_paths(docs.schema)))
    if layout is None:  # an id column may be the only difference
        layout = BY_FINGERPRINT.get(fingerprint(set(leaf_paths(docs.schema)) - {id_col, "conv_id"}))
    if layout is None:
        return docs.select(F.col(id_col).alias("conv_id"), F.lit(UNKNOWN).alias("layout"), F.array().cast(TURNS).alias("turns"))
    if layout is TURN_ROWS:
        rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
        docs = docs.select(F.col(id_col).alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(rows.alias("rows"))
        id_col = "conv_id"
    return docs.select(F.col(id_col).alias("conv_id"), F.lit(layout.name).alias("layout"),
                       F.expr(layout.turns).cast(TURNS).alias("turns"))


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in ("\\", "<", "["):
        out = F.replace(out, F.lit(c), F.lit(c + "\\"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, layout, formatted, loss_mask) of (conv_id, layout, turns)."""
    safe = computed(turns, "conv_id", "layout", F.transform("turns", lambda t: F.struct(
        escape(t["role"]).alias("role"), escape(t["text"]).alias("text"),
        F.coalesce(t["role"] == "assistant", F.lit(False)).alias("train"))).alias("t"))
    piece = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))
    run = lambda t: F.struct((F.length(t["role"]) + len(TURN + TEXT)).alias("head"),
                             F.length(t["text"]).alias("body"), t["train"].alias("train"))
    return computed(safe, "conv_id", "layout", F.array_join(F.transform("t", piece), "").alias("formatted"),
                    F.transform("t", run).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The output of ``format_chat`` with ``turns`` and ``loss_text`` recovered from it."""
    cut = F.split("formatted", F.lit(END.replace("|", r"\|")), -1)
    parts = computed(formatted, "*", F.slice(cut, 1, F.size(cut) - 1).alias("pieces"))
    turns = F.transform("pieces", lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescape(F.substring_index(p, TEXT, -1)).alias("text")))
    masked = F.filter(F.arrays_zip("pieces", "loss_mask"), lambda x: x["loss_mask"]["train"])
    loss = F.transform(masked, lambda x: unescape(
        F.substr(x["pieces"], x["loss_mask"]["head"] + 1, x["loss_mask"]["body"])))
    return computed(parts, *formatted.columns, turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(probe).alias("text"))
    out = read_back(format_chat(canonical_turns(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
       CAST(sum(23 + length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
