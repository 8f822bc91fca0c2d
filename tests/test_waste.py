"""Classes of waste and shares of tools on transcripts whose numbers are known."""

import json

import pytest

from spanloom.functions.money import price_schema
from spanloom.operators import waste
from spanloom.sources.transcripts import records

RULES = waste.Rules(meter=r"^context: \d+k", links=r"^(links of `|map of links|`[^`]+` is covered by links)")
CODE = "mcp__code__"


def call(id, win, *blocks, **more):
    return {"type": "assistant", "cwd": "/p", "message": {"id": id, "model": "large-5", "usage": {"input_tokens": win, "output_tokens": 0}, "content": list(blocks)}} | more


def use(id, name, **args):
    return {"type": "tool_use", "id": id, "name": name, "input": args}


def result(id, chars=0, error=False, kind=None, content=None):
    block = {"type": "tool_result", "tool_use_id": id, "is_error": error, "content": "x" * chars if content is None else content}
    return {"type": "user", "cwd": "/p", "message": {"content": [block]}} | ({"toolDenialKind": kind} if kind else {})


def meta(content, source=None):
    return {"type": "user", "isMeta": True, "sourceToolUseID": source, "message": {"content": content}}


def hook(text):
    return {"type": "attachment", "attachment": {"type": "hook_additional_context", "content": [text.ljust(400, ".")]}}


def prompt(content):
    return {"type": "user", "message": {"content": content}}


def refs(*names):
    return [{"type": "tool_reference", "tool_name": n} for n in names]


TEXT = [{"type": "text", "text": "x" * 400}]
SESSION = [
    call("c0", 1000, use("u1", "Read", file_path="/p/a.ts")), result("u1", 10, True, "permission-rule"),
    call("c1", 1000, use("u2", "Read", file_path="/p/a.ts")), result("u2", 400),
    call("c2", 1000, use("u3", "Read", file_path="/p/a.ts"), use("u4", CODE + "nope")), result("u3", 400), result("u4", 20, True),
    call("c3", 1000, use("u5", "Edit", file_path="/p/a.ts"), use("u6", "Read", file_path="/p/a.ts"), use("u17", "Write", file_path="/p/c.ts")), result("u5", 10), result("u6", 400), result("u17", 10, True, "user-rejected"),
    call("c4", 1000, use("u7", "Bash", command="npm test"), use("u8", "ToolSearch", query="select:A"), use("u18", "Bash", command="false")), result("u7", 24_000), result("u8", content=refs("A")), result("u18", 40, True),
    call("c5", 1000, use("u9", "ToolSearch", query="select:A,B"), use("u10", CODE + "read", file="b.mjs")), result("u9", content=refs("A", "B")), result("u10", 12_000),
    call("c6", 1000, use("u11", "Skill", skill="review"), use("u19", CODE + "search", query="x")), result("u11", 20), meta(TEXT, "u11"), result("u19", 10_000),
    call("c7", 1000, use("u12", "Skill", skill="review")), result("u12", 20), meta(TEXT, "u12"),
    hook("context: 91k tokens"), hook("map of links `docs/x.md`"), hook("links of `docs/x.md`, items"), hook("`src/b.ts` is covered by links `docs/x.md`"),
    call("c8", 1000, {"type": "text", "text": "done"}), meta("Stop hook feedback:\nno menu."),
    call("c9", 200_000, use("u13", "Skill", skill="handoff")), call("c10", 210_000, {"type": "text", "text": "plan"}),
    call("c11", 1000, use("u14", CODE + "read", file="b.mjs")), result("u14", 12_000),
    call("c12", 1000, use("u15", CODE + "read", file="/p/b.mjs"), use("u16", CODE + "read", file="b.mjs", if_digest="d"), use("u20", CODE + "context", task="x")), result("u15", 12_000), result("u16", 40), result("u20", 400),
    call("c13", 1000, {"type": "text", "text": "end"}),
]
EMPTY = [{"type": "text", "text": "count: 0\n\n"}]
SEARCHES = [
    call("r0", 1000, use("g1", CODE + "search", query="retryPolicy")), result("g1", content=EMPTY),
    call("r1", 1000, use("g2", "Bash", command="grep -rn retry src")), result("g2", 4000),
    call("r2", 1000, use("g3", "Grep", pattern="retry"), use("g4", "mcp__docs__search", query="retry")), result("g3", 4000), result("g4", 400),
    call("r3", 1000, use("g5", "Bash", command="grep -rn retry lib")), result("g5", 400),
    call("r4", 1000, use("g6", CODE + "search", query="RETRY_MAX", literal=True)), result("g6", content=EMPTY),
    call("r5", 1000, use("g7", "Bash", command="grep -rn RETRY_MAX --include=*.ts src")), result("g7", 400),
    call("r6", 1000, use("g8", "Bash", command="grep -rn RETRY_MAX docs/setup.md")), result("g8", 4000),
    call("r7", 1000, use("g9", CODE + "search", query="retry")), result("g9", 400),
    call("r8", 1000, use("g10", "Grep", pattern="retry", glob="*.yml")), result("g10", 400),
    call("r10", 1000, use("g11", CODE + "search", query="retryLimit")), result("g11", content=EMPTY),
    call("r11", 1000, use("g12", "Bash", command="node t.mjs | grep FAIL")), result("g12", 4000),
    call("r12", 1000, use("g13", "Bash", command="grep -c FAIL /tmp/t.out")), result("g13", 4000),
    call("r13", 1000, use("g14", "mcp__docs__search", query="retryPolicy"), use("g15", "mcp__docs__search", query="RETRY_MAX", path_include=["docs"]), use("g16", "mcp__docs__search", query="retry policy")), result("g14", 400), result("g15", 400), result("g16", 400),
    call("r9", 1000, {"type": "text", "text": "end"}),
]
PARTS = [
    prompt("mend it"), call("m1", 1000, use("t1", "Read")), call("m1", 1000, use("t2", "Read")), result("t1", 1), result("t2", 1), call("m2", 1000, use("t3", "Read")), result("t3", 1), call("m3", 1000, {"type": "text", "text": "ready"}),
    prompt("<command-name>/model</command-name>"), prompt("<local-command-stdout>Set model</local-command-stdout>"), meta("caveat"), prompt([{"type": "text", "text": "more"}]), call("m4", 1000, {"type": "text", "text": "yes"}),
    {"type": "assistant", "message": {"model": "<synthetic>", "usage": {"input_tokens": 9}, "content": [use("s", "Read")]}}, call("side", 5, use("s2", "Read"), isSidechain=True),
]


@pytest.fixture(scope="module")
def stream(spark):
    lines = [(s, "p", i, json.dumps(r)) for s, rs in (("waste", SESSION), ("search", SEARCHES), ("parts", PARTS)) for i, r in enumerate(rs)]
    lines += [("parts", "p", 99, "{broken")]
    prices = spark.createDataFrame([(0, "large", 5.0, 25.0, 0.5, 6.25, 10.0)], price_schema())
    return waste.items(records(spark.createDataFrame(lines, "session string, project string, pos long, line string").repartition(3)), prices, RULES)


def test_classes(stream):
    got = {r.cls: (r.n, r.tok, round(r.usd, 6)) for r in waste.waste(stream, RULES).where("session = 'waste'").collect()}
    carry = lambda tok, left: tok * (6.25 + (left - 1) * 0.5) / 1e6
    assert got == {
        "deny": (1, 1000, 0.005), "error": (1, 1000, 0.005), "stop": (1, 200_000, 1.0), "reread": (2, 3800, round(carry(100, 8) + carry(3000, 1), 6)), "fullread": (2, 21_000, round(carry(3000, 5) + carry(3000, 2), 6)),
        "bigbash": (1, 6000, round(carry(1000, 6), 6)), "toolsearch": (1, 0, 0.0), "skill": (1, 300, round(carry(100, 3), 6)), "meter": (1, 300, round(carry(100, 3), 6)), "links": (3, 900, round(3 * carry(100, 3), 6)), "handoff": (1, 50_000, 0.025),
    }
    assert set(got) == set(waste.CLASSES)


def test_repeats_and_missing(stream):
    assert [tuple(r) for r in waste.repeats(stream).collect()] == [("waste", 1)]
    got = {(r.session, r.what): (r.n, r.tok) for r in waste.missing(stream, RULES).collect()}
    assert got == {("waste", "digest"): (1, 3000), ("waste", "wide"): (1, 2500), ("waste", "context"): (1, 0), ("search", "documents"): (2, 3000), ("search", "exact"): (1, 0)}


def test_shares(stream):
    got = {r.session: r for r in waste.session_shares(stream, RULES).collect()}
    parts = got["parts"]
    assert (parts.turns, parts.asks, parts.tooled, parts.multi, parts.deny, parts.ctx, parts.out, parts.read, parts.model) == (4, 2, 2, 1, 0, 4000, 0, 3, "large-5")
    assert (got["waste"].turns, got["waste"].deny, got["waste"].code, got["waste"].edit, got["waste"].bash) == (14, 1, 7, 2, 2)
    assert (got["search"].grep, got["search"].docs, got["search"].code) == (8, 4, 4)


def test_one_call_is_charged_once_and_ends_of_sessions_cost_nothing(spark):
    rows = [call("a", 10, use("x", "Read"), use("y", "Read")), result("x", 1, True), result("y", 1, True), call("b", 20, use("z", "Read")), result("z", 1, True)]
    lines = spark.createDataFrame([("s", "p", i, json.dumps(r)) for i, r in enumerate(rows)], "session string, project string, pos long, line string")
    none = spark.createDataFrame([], price_schema())
    assert [tuple(r) for r in waste.waste(waste.items(records(lines), none)).collect()] == [("s", "error", 3, 20, 0.0)]
    assert waste.waste(waste.items(records(lines.where("false")), none)).collect() == []


def test_tasks_grow_with_the_events(spark, tmp_path, monkeypatch):
    """The stream is dealt into as many tasks as its events ask for, and comes out so for its readers."""
    from spanloom.plans import waste as plans

    monkeypatch.setattr(plans, "EVENTS_OF_TASK", 100)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert plans.stream(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-events // 100) > 4
