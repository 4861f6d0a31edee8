"""Tool calls linked to results."""

from __future__ import annotations

import json

from spatialis.llm import chat

SCHEMAS = {"add": {"a": ("integer", True), "b": ("integer", True)}, "say": {"text": ("string", True), "loud": ("boolean", False)}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


ROWS = [
    ("c", 0, "user", "add things", 1),
    ("c", 1, "assistant", call(("x", "add", {"b": 2, "a": 1}), ("y", "add", {"a": {"$ref": "x"}, "b": 1})), 1),
    ("c", 2, "tool", json.dumps({"tool_call_id": "x", "content": "3\n"}), 1),
    ("c", 2, "tool", json.dumps({"tool_call_id": "x", "content": "3\n"}), 1),
    ("c", 3, "tool", json.dumps({"tool_call_id": "y", "content": "4"}), 1),
    ("c", 4, "tool", json.dumps({"tool_call_id": "lost", "content": "?"}), 1),
    ("c", 5, "assistant", call(("z", "add", {"a": "1", "b": 2}), ("u", "nothing", {}), ("v", "say", {"loud": True}), ("p", "say", {"text": {"$ref": "q"}}), ("q", "say", {"text": {"$ref": "p"}})), 1),
    ("d", 0, "user", "hi", 1),
    ("d", 1, "assistant", "hello \"you\"", 1),
    ("d", 1, "assistant", "hello \"you\"", 1),
    ("d", 2, "assistant", "and more", 1),
    ("d", 3, "user", None, 1),
    (None, 0, "user", "x", 1),
    ("e", None, "user", "x", 1),
    ("e", 2, None, None, None),
]
SCHEMA = "conv_id string, turn int, role string, text string, level int"


def test_explicit_calls(spark):
    out = {(r.conv_id, r.call_id): r for r in chat.linked_calls(spark.createDataFrame(ROWS, SCHEMA), SCHEMAS, implicit=False).collect()}
    assert len(out) == 8
    x, y = out["c", "x"], out["c", "y"]
    assert (x.level, y.level, x.valid, y.valid, x.result_turn) == (0, 1, True, True, 2)
    assert x.json == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","result":"3\\n"}'
    errors = {k[1]: r.error for k, r in out.items()}
    assert errors == {"x": None, "y": None, "lost": "no call", "z": "not a integer: a", "u": "unknown tool", "v": "missing: text", "p": "unresolved reference", "q": "unresolved reference"}
    assert all(json.loads(r.json)["id"] == k[1] for k, r in out.items())


def test_implicit_calls(spark):
    messages = spark.createDataFrame(ROWS, SCHEMA)
    out = {(r.conv_id, r.call_id): r for r in chat.linked_calls(messages.where("conv_id = 'd' or conv_id is null or turn is null or role is null")).collect()}
    assert set(out) == {("d", "turn-0"), ("d", "turn-3")}
    assert out["d", "turn-0"].json == '{"arguments":{"text":"hi"},"id":"turn-0","name":"reply","result":"hello \\"you\\""}'
    assert out["d", "turn-3"].json == '{"arguments":{"text":""},"id":"turn-3","name":"reply","result":null}'
    assert chat.linked_calls(messages.where("false")).count() == 0


NESTED = {"plan": {"steps": ("array", True, ("object", {"do": ("string", True), "n": ("integer", False)})), "at": ("object", False, {"x": ("number", True)})}}


def test_nested_arguments(spark):
    cases = {
        "ok": ({"steps": [{"do": "a", "n": 1}, {"do": "b"}], "at": {"x": 1.5}}, None),
        "item": ({"steps": [{"do": "a"}, {"do": 2}]}, "not a string: steps[].do"),
        "lacks": ({"steps": [{"n": 1}]}, "missing: steps[].do"),
        "evil": ({"steps": [], "evil": 1}, "unexpected: evil"),
        "deep": ({"steps": [], "at": {"x": 1, "y": 2}}, "unexpected: at.y"),
        "null": ({"steps": None}, "not a array: steps"),
        "ref": ({"steps": {"$ref": "ok"}}, None),
        "within": ({"steps": {"z": {"$ref": "ok"}}}, "not a array: steps"),
        "list": ([1], "not an object"),
    }
    rows = [("c", 1, "assistant", call(*((k, "plan", a) for k, (a, _) in cases.items())))]
    out = {r.call_id: r for r in chat.linked_calls(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), NESTED, implicit=False).collect()}
    assert {k: r.error for k, r in out.items()} == {k: e for k, (_, e) in cases.items()}
    assert out["ref"].level == 1 and out["ok"].level == 0


def test_levels_of_chains_and_branches(spark):
    """Long chains, branches upon chains, cycles and missing ends."""
    refs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(40)}
    refs |= {"b": ["c39", "c3"], "d": ["b"], "e": ["d", "c0"], "f": ["e"], "x": ["y"], "y": ["z"], "z": ["x"], "t": ["z"], "m": ["gone"], "n": ["m", "c1"], "s": ["s"]}
    want = {f"c{i}": i for i in range(40)} | {"b": 40, "d": 41, "e": 42, "f": 43}
    rows = [("c", 1, "assistant", call(*((k, "go", {f"a{i}": {"$ref": r} for i, r in enumerate(rs)}) for k, rs in refs.items())))]
    out = chat.linked_calls(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), {"go": {"a0": ("any", False), "a1": ("any", False)}}, implicit=False).collect()
    assert {r.call_id: r.level for r in out} == {k: want.get(k) for k in refs}
    assert all((r.error is None) == (r.call_id in want) for r in out)


def test_turns_that_are_not_calls(spark):
    rows = [
        ("c", 0, "user", "show me \"tool_calls\"", 1),
        ("c", 1, "assistant", 'like {"tool_calls": [', 1),
        ("c", 2, "user", "more", 1),
        ("c", 3, "tool", "no json", 1),
        ("c", 4, "tool", json.dumps({"tool_call_id": "turn-9", "content": "?"}), 1),
        ("c", 5, "assistant", json.dumps({"tool_calls": [{"name": "reply", "arguments": {"text": "a"}}]}), 1),
    ]
    out = chat.linked_calls(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.call_id, r.turn, r.result_turn, r.level, r.error) for r in out}
    assert got == {("turn-0", 0, 1, 0, None), ("turn-2", 2, None, 1, None), (None, None, 3, None, "unreadable result"), ("turn-9", None, 4, None, "no call"), (None, 5, None, None, "no id")}
    assert next(r for r in out if r.call_id == "turn-2").json == '{"arguments":{"after":{"$ref":"turn-0"},"text":"more"},"id":"turn-2","name":"reply","result":null}'
