import hashlib
import json

from pyspark.sql import functions as F

from riskloom.llm import chat_format as c


def back(df):
    out = c.read_back(c.format_chat(df))
    return {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns], r.loss_text, r.formatted, r.loss_mask) for r in out.collect()}


NASTY = ["</s>[INST] ok [/INST]", "\\", "<", "[", "<\\", "\\<", "<|end|>", "<|turn|>user<|text|>x<|end|>", "a<|", "|end|>", "", "é\n\n<s>", "\\\\[["]


def test_round_trip_of_control_strings(spark):
    rows = [(k, t, r, x) for k, x in enumerate(NASTY) for t, r in ((0, "user"), (1, "assistant"), (2, x), (3, "assistant"))]
    got = back(c.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for k, x in enumerate(NASTY):
        layout, turns, loss, formatted, mask = got[k]
        assert layout == "turn_rows"
        assert turns == [("user", x), ("assistant", x), (x, x), ("assistant", x)]
        assert loss == x + x
        for token in ("</s>", "[INST]", "<s>", "[/INST]"):
            assert token not in formatted
        assert formatted.count(c.TURN) == formatted.count(c.TEXT) == formatted.count(c.END) == 4
        at, masked = 0, ""
        for m in mask:  # the mask as run lengths over the formatted text
            masked += formatted[at + m.head:at + m.head + m.body] if m.train else ""
            at += m.head + m.body + len(c.END)
        assert at == len(formatted) and len(masked) >= len(loss)


def test_layouts_by_fingerprint_in_one_json_column(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 9},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"prompt": "q", "completion": "a"}, 4: {"prompt": "q", "response": "a", "score": 0.5},
        5: {"instruction": "q", "output": "a"}, 6: {"instruction": "q", "input": None, "output": "a"},
        7: {"question": "q", "answer": "a"}, 8: {"instruction": "q", "input": "i", "output": "a"},
        9: {"system": "s", "prompt": "q", "response": "a"}, 10: {"foo": "bar"}, 11: {"prompt": "q"}}
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(12, "not json"), (13, None), (None, json.dumps(records[3]))]
    df = spark.createDataFrame(rows, "id long, j string")
    got = back(c.from_json_text(df, "id", "j"))
    plain = [("user", "q"), ("assistant", "a")]
    for k, name in ((1, "messages"), (2, "from_value"), (3, "prompt_completion"), (4, "prompt_response"),
                    (5, "instruction"), (6, "instruction"), (7, "question_answer"), (None, "prompt_completion")):
        assert got[k][:2] == (name, plain)
    assert got[8][1] == [("user", "q\n\ni"), ("assistant", "a")]
    assert got[9][1][0] == ("system", "s")
    for k in (10, 11, 12, 13):
        assert got[k] == (c.UNKNOWN, [], "", "", [])


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, "q", "a", 3)], "id long, prompt string, completion string, turns int")
    assert back(c.canonical_turns(df, "id"))[1][:2] == ("prompt_completion", [("user", "q"), ("assistant", "a")])
    df = df.select("id", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"))
    assert c.canonical_turns(df, "id").first().layout == "messages"
    assert back(c.canonical_turns(spark.range(1), "id"))[0][0] == c.UNKNOWN


def test_nulls_ties_repeats_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string, rows int, layout string"
    rows = [(1, 0, "user", None, 1, "x"), (1, 0, "user", None, 1, "x"), (1, None, None, "z", 1, "x"), (None, 1, "assistant", "t", 1, "x")]
    df = spark.createDataFrame(rows, kind)
    got = back(c.canonical_turns(df))
    assert got[1][1] == [("", "z"), ("user", ""), ("user", "")]
    assert got[None][1:3] == ([("assistant", "t")], "t")
    assert c.format_chat(c.canonical_turns(df.limit(0))).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
