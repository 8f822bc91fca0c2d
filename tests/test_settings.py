import json

import pytest

from spanloom.operators.settings import settings_difference, settings_items

DEEP = {"a": {"b": {"c": {"d": {"e": 1}}}}}
HOOKS = {"hooks": {"Stop": [{"hooks": [{"command": "x", "args": ["y"]}, {"type": "prompt"}]}, {"matcher": "M", "hooks": [{"command": "x"}]}]}}
CASES = [
    (DEEP, DEEP, set()),
    (DEEP, {"a": {"b": {"c": {"d": {"e": 2}}}}}, {("a.b.c.d.e", "different", None)}),
    (DEEP, {"a": {"b": 5}}, {("a.b.c.d.e", "missing", None)}),
    ({"a": 1}, {"a": {"b": 1}}, {("a", "different", None)}),
    ({"a": None}, {"a": None}, set()),
    ({"model": "m", "x": {"model": "m"}}, {}, {("x.model", "missing", None)}),
    ({"env": {"KEY": "secret", "SAME": "1"}}, {"env": {"KEY": "other", "SAME": "1"}}, {("env.KEY", "different", None)}),
    ({"p": {"allow": ["b", "a", 1, "a"]}}, {"p": {"allow": ["a"]}}, {("p.allow", "missing", "b"), ("p.allow", "missing", "1")}),
    ({"p": ["a"]}, {"p": "a"}, {("p", "missing", "a")}),
    (HOOKS, HOOKS, set()),
    (HOOKS, {"hooks": {"Stop": [{"hooks": [{"command": "x"}]}]}}, {("hooks.Stop", "missing", "x y"), ("hooks.Stop", "missing", '{"type":"prompt"}'), ("hooks.Stop[M]", "missing", "x")}),
    ({"bindings": [{"context": "Chat", "bindings": {"meta+x": "a", "k": "b"}}]}, {"bindings": [{"context": "Other", "bindings": {}}, {"context": "Chat", "bindings": {"k": "c"}}]}, {("bindings[Chat].meta+x", "missing", None), ("bindings[Chat].k", "different", None)}),
    ({}, {"a": 1}, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [(i, json.dumps(a), json.dumps(b)) for i, (a, b, _) in enumerate(CASES)] + [(100, "{bad", "{}"), (101, " ", "{}"), (102, None, None), (103, '{"a":1}', "[1"), (104, "[1]", "{}")]
    frame = spark.createDataFrame(texts, "k int, old string, own string")
    rows = settings_difference(settings_items(frame, "k", "old"), settings_items(frame, "k", "own"), "k").collect()
    return [(r.k, r.path, r.state, r.value) for r in rows]


def test_differences(found):
    for i, (_, _, want) in enumerate(CASES):
        assert sorted(map(repr, (r[1:] for r in found if r[0] == i))) == sorted(map(repr, want)), i


def test_broken_and_empty(found):
    assert sorted(r for r in found if r[0] >= 100) == [(100, "", "broken", None), (103, "a", "missing", None), (104, "", "broken", None)]


def test_no_side_is_broadcast(spark, capsys):
    """Spark takes parsed texts to be as small as the column they come from; rows without a key meet nothing."""
    frame = spark.createDataFrame([(1, '{"a":1,"b":["x"]}', '{"a":2}'), (None, '{"a":1}', '{"a":1}')], "k int, old string, own string")
    lost = settings_difference(settings_items(frame, "k", "old"), settings_items(frame, "k", "own"), "k")
    assert sorted(map(tuple, lost.collect()), key=repr) == [(1, "a", "different", None), (1, "b", "missing", "x"), (None, "a", "missing", None)]
    lost.explain()
    assert "Broadcast" not in capsys.readouterr().out
