"""JSON records with fields beside those of their layout, and records of no layout."""

import json

from pagewright.llm import chat

ASKED = [("user", "hi"), ("assistant", "ho")]
MESSAGES = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]


def turns_of(spark, records):
    df = spark.createDataFrame([(r if r is None or isinstance(r, str) else json.dumps(r),) for r in records], "j string")
    out = df.select(chat.turns_of_json(chat.F.col("j")).alias("t"), chat.layout_of_json(chat.F.col("j")).alias("l")).collect()
    return df, [r.t and [(t.role, t.text) for t in r.t] for r in out], [r.l for r in out]


def test_foreign_fields_do_not_hide_a_layout(spark):
    records = [{"messages": MESSAGES, "prompt": "x"}, {"messages": MESSAGES, "text": "x", "output": None},
               {"prompt": "hi", "completion": "ho", "role": "r"}, {"instruction": "hi", "output": "ho"},
               {"instruction": "hi", "output": "ho", "input": None}, {"question": "hi", "answer": "ho", "input": "x"},
               {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}], "answer": "x"},
               {"prompt": "hi", "completion": "ho", "messages": "none"}, {"prompt": "hi", "completion": "ho", "messages": [1, None]}]
    _, got, layouts = turns_of(spark, records)
    assert got == [ASKED] * len(records)
    assert layouts == ["messages", "messages", "prompt", "instruction", "instruction", "question", "exchanges", "prompt", "prompt"]


def test_elements_are_all_looked_at(spark):
    first = {"messages": [{"role": "system"}, *MESSAGES]}
    extra = {"instruction": "hi", "input": "more", "output": "ho", "prompt": "p"}
    _, got, _ = turns_of(spark, [first, extra])
    assert got == [[("system", ""), *ASKED], [("user", "hi\nmore"), ("assistant", "ho")]]


def test_records_of_no_layout_are_counted(spark):
    df, got, _ = turns_of(spark, [{"prompt": "hi"}, {"prompt": "x"}, {"messages": [{"role": "user"}]}, "broken", None, "[1]",
                                  {"messages": MESSAGES}])
    assert got == [None] * 6 + [ASKED]
    counts = {(r.layout, r.paths): r.n for r in chat.layout_counts(df, "j").collect()}
    assert counts == {("messages", None): 1, (None, "prompt"): 2, (None, "messages messages[].role"): 1, (None, None): 3}


def test_tables_without_the_optional_field(spark):
    df = spark.createDataFrame([(1, "hi", "ho", "x"), (2, None, "", None)], "id long, instruction string, output string, extra string")
    rows = [tuple(r) for r in chat.turn_rows(df).orderBy("conv_id", "turn").collect()]
    assert rows == [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", ""), (2, 1, "assistant", "")]
