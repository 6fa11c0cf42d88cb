"""Chat formatting against brute force, round trips and layouts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from checks.compare import differences
from leadloom.llm import chat_format as chat
from leadloom.llm.oracle import oracle_sql
from leadloom.llm.queries import queries

NASTY = [
    None, "", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>\\", "<\\/s>", "[ROLE]user[/ROLE]x</s", "<", "[", "<s", "</s></s>",
    "$1 \\1", "line\nline\r\n", "𝔘𝔫𝔦 é ", "<s>[ROLE]assistant[/ROLE]hi</s>", "a" * 200_000 + "</s>",
]
ROWS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
     T.StructField("text", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("loss", T.StringType()),
     T.StructField("a`b", T.StringType()), T.StructField("Prompt", T.StringType())]
)


def rows():
    found = [(1, i, ("user", "assistant", "tool", None, "[/ROLE]", "\\")[i % 6], t) for i, t in enumerate(NASTY)]
    found += [(2, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(300)]
    found += [(None, 0, "assistant", "no id"), (None, None, "user", "no turn"), (3, 0, "assistant", None)]
    found += [(4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "assistant", "a"), (4, 1, "user", "a"), (4, -9, "user", "first")]
    return found


def expected(found):
    groups = {}
    for c, turn, role, text in found:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    controls = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")

    def escaped(s):
        s = s.replace("\\", "\\\\")
        for c in controls:
            s = s.replace(c, c[0] + "\\" + c[1:])
        return s

    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        chars = sum(len(f"<s>[ROLE]{escaped(r)}[/ROLE]{escaped(t)}</s>") for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                  hashlib.sha256(learned.encode()).hexdigest(), chars)
    return out


def test_round_trip_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows()], ROWS).repartition(3)
    pieces = chat.read_pieces(chat.format_turns(chat.canonical_turns(df)))
    got = {r[0]: tuple(r)[1:] for r in chat.digests(pieces).collect()}
    assert got == expected(rows())


def test_pieces_are_bounded_and_put_together(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows()], ROWS)
    pieces = chat.read_pieces(chat.format_turns(chat.canonical_turns(df.where("conv_id = 2")))).orderBy("piece").collect()
    assert [len(p["turns"]) for p in pieces] == [64, 64, 64, 64, 44]
    assert [t["text"] for p in pieces for t in p["turns"]] == [f"turn {i} </s>" for i in range(300)]
    assert "".join(x for p in pieces for x in p["learned"]) == "".join(f"turn {i} </s>" for i in range(1, 300, 2))


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert chat.digests(chat.read_pieces(chat.format_turns(chat.canonical_turns(df)))).collect() == []


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "x": 1}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"id": 5, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction_input", [("user", "do"), ("assistant", "done")]),
    ({"system": "be", "instruction": "do", "input": "it", "output": "done"}, "system_instruction", [("system", "be"), ("user", "do\n\nit"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "response": "r"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "meta.url": "u"}, "response", [("user", "p"), ("assistant", "r")]),
]


def test_json_records_of_all_layouts(spark):
    texts = [json.dumps(r) for r, _, _ in RECORDS] + [None, "", "no json", "[1]", "{}", '{"prompt": "p"}', '{"messages": []}']
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns_json(df, "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, (r.layout, []))
        if r.turn is not None:
            got[r.conv_id][1].append((r.role, r.text))
    for i, (_, name, turns) in enumerate(RECORDS):
        assert got[i] == (name, turns)
    assert all(got[i] == (None, []) for i in range(len(RECORDS), len(texts)))


def test_tables_of_all_layouts(spark):
    for record, name, turns in RECORDS:
        df = spark.read.json(spark.createDataFrame([(json.dumps(record),)], "value string").rdd.map(lambda r: r[0]))
        df = df.withColumn("conv_id", F.lit(1)).withColumn("text ", F.lit("clash"))
        assert chat.layout_of(df).name == name
        got = [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()]
        assert got == turns


def test_unknown_layout_and_bad_template(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat.layout_of(spark.createDataFrame([], "conv_id long, question string"))
    with pytest.raises(ValueError, match="control"):
        chat.Template(end="</s<")


def test_query(spark, duck, sf_dir):
    assert differences(queries()["op13_chat_format"](spark, sf_dir), duck, oracle_sql()["op13_chat_format"]) is None


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries()["op13_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
