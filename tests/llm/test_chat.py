import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldflow.llm import chat

T = chat.Template()
SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "\\", "\\\\", "\\h", "\\\\h###", "####", "</turn></turn>", "\n</turn>\n", ": ", "", None, "a: b\\", "\\t</turn>\\"]


def read(spark, rows):
    return chat.read_back(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()


def plain_state(roles):
    state = "start"
    for role in roles:
        state = chat.MOVES.get(state, {}).get(role, "rejected")
    return state


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool: x", "### user", "", None, "a\\"]
    rows = [(c, t, rng.choice(roles), rng.choice(NASTY)) for c in range(150) for t in range(rng.randrange(1, 7))]
    for r in read(spark, rows):
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in own]
        assert r.loss_text == "".join(text for _, role, text in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.n_turns == len(own) and r.state == plain_state([x[1] for x in own])
        assert r.valid == (r.state in ("asked", "answered"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="\\#</turn>: ht\n", max_size=30)), min_size=1, max_size=8))
def test_round_trip_of_any_text(spark, turns):
    (r,) = read(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])
    assert [(x.role, x.text) for x in r.turns] == turns
    assert r.formatted.count("</turn>") == len(turns)


def test_ties_nulls_and_extra_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.withColumns({"turns": F.lit(1), "segments": F.lit(2), "formatted": F.lit("f"), "a.b": F.lit(0)})
    by_id = {r.conv_id: r for r in chat.read_back(chat.format_chats(wide)).collect()}
    assert [x.text for x in by_id[1].turns] == ["s", "a", "b", "", ""]
    assert by_id[1].state == "rejected" and by_id[None].state == "asked"
    assert by_id[None].loss_text == "" and len(by_id[None].turns[0].text) == 100_000
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("roles, state", [("u", "asked"), ("su", "asked"), ("sua", "answered"), ("s", "briefed"), ("a", "rejected"), ("uu", "rejected"), ("uas", "rejected")])
def test_machine(spark, roles, state):
    names = {"u": "user", "a": "assistant", "s": "system"}
    (r,) = read(spark, [(1, i, names[x], "t") for i, x in enumerate(roles)])
    assert r.state == state


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
