import json

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import chat

MARKS = st.lists(
    st.sampled_from(["\\", "#", "##", "###", "### ", "</turn>", "</turn>\n", "</tur", "n>", "\n", ":", ": ", "a", "é", "👍", "assistant"]), max_size=12
).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(MARKS | st.just("assistant"), MARKS), max_size=6))
def test_round_trip(turns):
    formatted, mask = chat.format_text(turns)
    assert chat.read_text(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"prompt": "q", "completion": "a", "system": "s"},
        {"instruction": "i", "input": "x", "output": "a"},
        {"instruction": "i", "input": "", "output": "a"},
        {"question": "q", "answer": "a", "context": "c"},
        {"messages": [{"turn": 2, "role": "assistant", "text": "a"}, {"turn": 1, "role": "user", "text": "q"}]},
        {"what": {"is": ["this"]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(50, "{broken"), (51, None)], "k long, record string")
    done = chat.format_records(df, "k")
    got = {r.k: r for r in chat.read_back(done, "k").collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] if r.turns is not None else None for k, r in got.items()}
    plain = [("user", "q"), ("assistant", "a")]
    assert turns[0] == turns[1] == turns[2] == turns[7] == plain
    assert turns[3] == [("system", "s"), *plain]
    assert turns[4] == [("user", "i\n\nx"), ("assistant", "a")] and turns[5] == [("user", "i"), ("assistant", "a")]
    assert turns[6] == [("user", "c\n\nq"), ("assistant", "a")]
    assert turns[8] is turns[50] is turns[51] is None
    errors = {r.k: r.error for r in done.collect()}
    assert errors[8] == "no layout for: what.is[]:text" and errors[50] and errors[51] and errors[0] is None


def test_rows_of_turns(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (2, None, "user", "first"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, record string")
    done = chat.format_records(chat.records_of_rows(df), "conv_id")
    got = {r.conv_id: r for r in chat.read_back(done, "conv_id").collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", said), ("assistant", said)] and got[1].loss_texts == [said]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "first"), ("", "")] and got[2].loss_texts == []
    assert got[3].loss_texts == ["a", "a"] and len(got[None].turns) == 1
    assert chat.records_of_rows(df.limit(0)).count() == 0
