import json

import pytest

from recallgrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, json int"
TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", None]}}, "additionalProperties": False}}


@pytest.mark.parametrize(("value", "text"), [({"b": 1.0, "a": [None, True, "é\n\""]}, '{"a":[null,true,"é\\n\\""],"b":1}'), (1e-7, "1e-7"), (0.000001, "0.000001"), (1.5e300, "1.5e+300"), (1e21, "1e+21"), (-0.25, "-0.25"), ({"\U0001f600": 1, "￿": 2}, '{"\U0001f600":1,"￿":2}')])
def test_canonical_json(value, text):
    assert chat.canonical(value) == text and json.loads(text) == value


@pytest.mark.parametrize(("value", "text"), [(9007199254740993, "9007199254740992"), (9007199254740993.0, "9007199254740992"), (-7, "-7"), (0, "0"), (-0.0, "0"), (1.2345678901234568e20, "123456789012345680000"), (10**21, "1e+21"), (True, "true"), (10**20, "100000000000000000000")])
def test_whole_numbers_are_doubles(value, text):
    assert chat.canonical(value) == text


def test_numbers_beyond_a_double_are_refused():
    for value in (10**400, -(10**400), float("inf")):
        with pytest.raises(ValueError):
            chat.canonical(value)


def test_violations():
    s = TOOLS["add"]
    assert chat.violations({"a": 2, "b": "x"}, s) == []
    assert chat.violations({"a": -1, "b": "y", "c": 0}, s) == ["/a: minimum", "/b: enum", "/c: additional"]
    assert chat.violations({"b": None}, s) == ["/a: required"] and chat.violations({"a": True}, s) == ["/a: type"] and chat.violations([], s) == ["/: type"]
    assert chat.violations({"a": 2.0}, s) == []


def test_links_order_and_errors(spark):
    rows = [
        (1, 0, "user", "hi", None, None, 0),
        (1, 1, "assistant", None, [("c1", "add", '{"a": 1}'), ("c2", "add", "not json"), ("c1", "sub", "{}")], None, 0),
        (1, 2, "user", "wait", None, None, 0),
        (1, 3, "tool", "second", None, "c2", 0),
        (1, 4, "tool", "first", None, "c1", 0),
        (1, 5, "tool", "again", None, "c1", 0),
        (1, 6, "tool", "orphan", None, "c9", 0),
        (2, 4, "tool", "other conversation", None, "c1", 0),
        (None, 1, "tool", None, None, "c1", 0),
        (3, 0, None, None, [(None, None, None)], None, 0),
    ]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    assert len(got) == len(rows)
    order = [(r["turn"], r["linked"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["anchor_turn"], r["slot"], r["turn"]))]
    assert order == [(0, None), (1, None), (4, True), (3, True), (5, True), (2, None), (6, False)]
    call = next(r for r in got if (r["conv_id"], r["turn"]) == (1, 1))
    assert (call["n_calls"], call["n_answered"], call["errors"]) == (3, 3, ["c2: arguments are not an object", "c1: unknown tool"])
    assert json.loads(call["json"])["tool_calls"][0] == {"id": "c1", "type": "function", "function": {"name": "add", "arguments": {"a": 1}}}
    assert next(r for r in got if r["conv_id"] == 2)["linked"] is False
    assert next(r for r in got if r["conv_id"] == 3)["json"] == '{"content":null,"role":null,"tool_calls":[{"function":{"arguments":{}},"type":"function"}]}'
    assert chat.formatted(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


BAD = ['{"a":1e999}', '{"a":' + "9" * 400 + "}", '{"a":"\\ud800"}', '{"a":' + "[" * 5000 + "]" * 5000 + "}", '{"a":' * 101 + "1" + "}" * 101, '{"a":NaN}', '{"a":' + "9" * 5000 + "}"]


def test_arguments_beyond_canonical_json(spark):
    rows = [(i, 0, "assistant", None, [("c", "add", text), None], None, 0) for i, text in enumerate(BAD)]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()}
    for i, text in enumerate(BAD):
        assert (got[i]["n_calls"], got[i]["errors"]) == (1, ["c: arguments are not an object"])
        assert json.loads(got[i]["json"])["tool_calls"][0]["function"]["arguments"] == text
    assert chat.parsed('{"a":"\\ud83d\\ude00"}') == {"a": "\U0001f600"} and chat.parsed('{"a":' * 100 + "1" + "}" * 100)


def test_results_that_call_keep_their_turn(spark):
    rows = [
        (1, 0, "tool", "answers a later call", [("x", "add", "{}")], "y", 0),
        (1, 1, "assistant", None, [("y", "add", "{}")], None, 0),
        (1, 2, "tool", "answers and calls", [("z", "add", "{}")], "w", 0),
        (1, 3, "tool", "end", None, "x", 0),
        (1, 4, "tool", "end", None, "z", 0),
        (2, 0, "assistant", None, [("w", "add", "{}")], None, 0),
        (2, 1, "tool", "answers and calls", [("v", "add", "{}")], "w", 0),
        (2, 2, "user", "u", None, None, 0),
        (2, 3, "tool", "end", None, "v", 0),
    ]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    order = lambda c: [(r["turn"], r["linked"]) for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: (r["anchor_turn"], r["slot"], r["turn"]))]
    assert order(1) == [(0, False), (3, True), (1, None), (2, False), (4, True)]
    assert order(2) == [(0, None), (1, True), (3, True), (2, None)]


def test_schemas_with_unknown_types():
    with pytest.raises(ValueError, match="unknown types"):
        chat.known_schema({"properties": {"a": {"items": {"type": "tuple"}}}})


def test_report_on_plain_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a" * 1300), (1, 2, "user", None), (2, 0, "assistant", "")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2]["linked"] and got[1, 2]["anchor_turn"] == 1 and got[1, 1]["n_errors"] == 1 and got[2, 0]["n_errors"] == 2
