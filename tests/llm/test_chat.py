from __future__ import annotations

import random

from tessera.llm import chat


def levels(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    return {(r.conv_id, r.call_id): r.level for r in chat.topological_levels(df).collect()}


def brute(rows):
    deps = {(c, i): [(c, d) for d in ds] for c, i, ds in rows}

    def level(k, seen=()):
        if k in seen:
            return None
        found = [level(d, (*seen, k)) for d in set(deps[k]) if d in deps]
        return None if None in found else 1 + max(found, default=-1)

    return {k: level(k) for k in deps}


def test_levels_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, f"n{i}", [f"n{j}" for j in range(i) if rng.random() < 0.25]) for c in (1, 2) for i in range(9)]
    rows += [(3, f"n{i}", [f"n{i - 1}"] if i else ["unknown"]) for i in range(20)]
    assert levels(spark, rows) == brute(rows)


def test_cycles_get_no_level(spark):
    rows = [(1, "a", ["b"]), (1, "b", ["a"]), (1, "c", ["a", "d"]), (1, "d", [])]
    assert levels(spark, rows) == {(1, "a"): None, (1, "b"): None, (1, "c"): None, (1, "d"): 0}


def test_link_validate_and_canonical(spark):
    calls = '[{"id":"x","name":"f","arguments":"{\\"b\\":2,\\"a\\":\\"é\\"}","depends_on":[]},{"id":"y","name":"g","arguments":"no json","depends_on":["zz"]}]'
    messages = spark.createDataFrame([(1, 0, calls), (2, 0, None)], "conv_id long, turn int, tool_calls string")
    results = spark.createDataFrame([(1, 1, "x", "ok"), (1, 2, "w", None)], "conv_id long, turn int, call_id string, content string")
    schemas = spark.createDataFrame([("f", "a", "string", True, 1.0, 5.0), ("f", "c", "integer", True, None, None)], "name string, field string, type string, required boolean, least double, most double")
    got = {r.call_id: r for r in chat.link_tool_calls(messages, results, schemas).collect()}
    assert got["x"].canonical == '{"arguments":{"a":"é","b":2},"id":"x","name":"f","result":"ok"}'
    assert got["x"].violations == ["missing:c", "unknown:b"] and got["x"].status == "linked" and got["x"].level == 0
    assert got["y"].status == "no_result" and got["y"].violations == ["dependency:zz", "no_schema"]
    assert got["w"].status == "orphan_result" and got["w"].violations is None


def test_empty(spark):
    messages = spark.createDataFrame([], "conv_id long, turn int, tool_calls string")
    results = spark.createDataFrame([], "conv_id long, turn int, call_id string, content string")
    schemas = spark.createDataFrame([], "name string, field string, type string, required boolean, least double, most double")
    assert chat.link_tool_calls(messages, results, schemas).count() == 0


def test_every_message_has_a_row(spark):
    call = '{"id":"x","name":"f","arguments":"{}"}'
    rows = [
        (1, 0, f"[{call}]"), (1, 5, f"[{call}]"), (1, 5, f"[{call}]"), (1, 6, '[{"id":"x","name":"g","arguments":"{}"}]'),
        (1, 7, '[{"id":"y"'), (1, 8, '[{"name":"f"}]'), (1, 9, "[]"), (1, 10, None), (None, 1, f"[{call}]"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn int, tool_calls string")
    results = spark.createDataFrame([(1, 1, "x", "ok"), (1, 2, "x", "late"), (1, 3, None, "lost"), (None, 3, "x", "lost")], "conv_id long, turn int, call_id string, content string")
    schemas = spark.createDataFrame([("f", "a", "string", False, None, None)], "name string, field string, type string, required boolean, least double, most double")
    got = sorted((r.status, r.turn, r.n_calls, r.n_results, r.level) for r in chat.link_tool_calls(messages, results, schemas).collect())
    assert got == sorted([
        ("linked", 0, 4, 2, 0), ("duplicate_call", 5, 2, 0, None), ("duplicate_call", 6, 1, 0, None), ("malformed", 7, 1, 0, None), ("null_id_call", 8, 1, 0, None),
        ("no_calls", 9, 1, 0, None), ("no_calls", 10, 1, 0, None), ("null_id_call", 1, 1, 0, None), ("duplicate_result", 2, 0, 1, None), ("null_id_result", 3, 0, 1, None), ("null_id_result", 3, 0, 1, None),
    ])
    rules = chat.validate(spark.createDataFrame([("f", '{"b":1}')], "name string, arguments string"), schemas, broadcast_rows=0)
    assert rules.first().violations == ["unknown:b"]
