"""Keyed session decisions: known sequences, plain loops over events, and state that shrinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_streams import streamed

from spanloom.operators import order
from spanloom.plans import sessions as plans
from spanloom.plans.tables import events
from spanloom.streaming import sessions
from spanloom.streaming.states import LEVELS

SF = "/root/testdata/sf0.001"
NOON = datetime(2024, 1, 1, 12)


def at(minutes):
    return NOON + timedelta(minutes=minutes)


# --- attempts

E, P, X = ("edit", ""), ("pass", "tsc"), ("fail", "tsc")
ATTEMPTS = {
    "three with edits": ([X, E, X, E, X, E, X], [(4, 3)]),
    "repeats without an edit do not count": ([X, X, X, E, X], []),
    "a third real attempt": ([X, X, X, E, X, E, X], [(6, 3)]),
    "a pass begins anew": ([X, E, X, E, P, X], []),
    "commands count apart": ([X, E, ("fail", "test"), E, X, E, ("fail", "test")], []),
    "an interrupted one does not count": ([X, E, X, E, ("skip", "tsc"), ("skip", "tsc")], []),
    "once for a session": ([X, E, X, E, X, P, X, E, X, E, X], [(4, 3)]),
}


def test_attempts_as_stream_and_as_windows(spark, tmp_path):
    rows = [(name, at(i), i, kind, command, True) for name, (some, _) in ATTEMPTS.items() for i, (kind, command) in enumerate(some)]
    rows += [("not told to this model", at(i), i, kind, command, False) for i, (kind, command) in enumerate(ATTEMPTS["three with edits"][0])]
    schema = "key string, at timestamp, ord int, kind string, command string, hints boolean"
    want = sorted((name, at(i), "tsc", n) for name, (_, found) in ATTEMPTS.items() for i, n in found)
    assert streamed(spark, tmp_path, rows, schema, sessions.attempts) == want
    kind = F.col("kind")
    found = order.attempts(spark.createDataFrame(rows, schema), ["key"], ["at", "ord"], "command", kind == "edit", kind == "pass", kind == "fail")
    first = found.where("counted and failures >= 3 and hints").groupBy("key").agg(F.min(F.struct("at", "command", "failures")).alias("f")).select("key", "f.*")
    assert sorted(map(tuple, first.collect())) == want


# --- marks

DAY = 24 * 60
GATE = {"needs": ["standards", "security"], "reads": "diff", "changes": ["edit", "standards"]}


def gate_rows(steps):
    return [("s", at(t), i, None if name == "?" else name, name == "?") for i, (t, name) in enumerate(steps)]


@pytest.mark.parametrize(
    ("steps", "want", "more"),
    [
        ([(0, "?"), (1, "standards"), (2, "?"), (3, "security"), (4, "?"), (5, "diff"), (6, "?"), (7, "edit"), (8, "?"), (9, "diff"), (10, "?")], ["standards", "security", "diff", None, "diff", None], {}),
        ([(0, "standards"), (0, "security"), (1, "diff"), (2, "standards"), (3, "?"), (3, "diff"), (4, "?")], ["diff", None], {}),
        ([(0, "standards"), (6 * DAY, "security"), (6 * DAY, "diff"), (8 * DAY, "?")], ["standards"], {}),
        ([(0, "standards"), (6 * DAY, "security"), (6 * DAY, "diff"), (8 * DAY, "?"), (13 * DAY + 1, "?")], [None, "standards"], {"together": True}),
    ],
)
def test_commit_gate(spark, tmp_path, steps, want, more):
    got = streamed(spark, tmp_path, gate_rows(steps), "key string, at timestamp, ord int, mark string, asks boolean", lambda s: sessions.commit_gate(s, **GATE, **more))
    asked = [at(t) for t, name in steps if name == "?"]
    assert got == [("s", t, m is None, m) for t, m in zip(asked, want)]


def state_rows(spark, path, name):
    return [(r.key.key, r.user_map_key.name) for r in spark.read.format("statestore").option("stateVarName", name).load(path).collect()]


def test_each_mark_lives_its_own_time(spark, tmp_path):
    """Later batches move the watermark: entries go one by one, the rest of the session stays."""
    schema = "key string, at timestamp, ord int, mark string, asks boolean"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def batch(rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = sessions.commit_gate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), needs=["a"], keep=60 * 60_000)
            query.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
            return sorted(state_rows(spark, f"{tmp_path}/state", "marks"))

        assert batch([("s", at(0), 0, "a", False), ("s", at(50), 1, "b", False), ("t", at(0), 2, "a", False)]) == [("s", "a"), ("s", "b"), ("t", "a")]
        assert ("s", "b") in batch([("u", at(75), 0, "x", False)])
        batch([("u", at(90), 0, "x", False)])
        left = batch([("u", at(100), 0, "y", False)])
        assert left == [("s", "b"), ("u", "x"), ("u", "y")]
        batch([("v", at(500), 0, "z", False)])
        assert batch([("v", at(520), 0, "z", False)]) == [("v", "z")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# --- notices

SOFT, HAND, HARD = 105_000, 160_000, 240_000
NOTES = {
    "quiet": ([40_000, "prompt", "step"], []),
    "soft with work": (["work", SOFT, "prompt", "step", "prompt", "prompt"], [("level", "soft"), ("request", "soft"), ("request", "soft")]),
    "levels over each other": (["work", SOFT, "prompt", HAND, "prompt", "step", "prompt", "prompt", HARD, "prompt", "prompt", "prompt", HAND, "prompt", SOFT, "prompt"],
                               [("level", "soft"), ("request", "hand"), ("request", "hand"), ("request", "hand"), ("level", "hard"), ("level", "hard"), ("level", "hard")]),
    "hard at once": ([300_000, "prompt"], [("level", "hard")]),
    "hand without work": ([HAND, "prompt", "prompt"], [("level", "hand"), ("request", "hand")]),
    "first hand at a prompt with work": (["work", HAND, "prompt"], [("request", "hand")]),
    "hand at a step": (["work", HAND, "step", "step", "prompt"], [("level", "hand"), ("request", "hand")]),
    "hard grows": ([HARD, "step", HARD + 15_000, "step", HARD + 22_000, "step", "prompt"], [("level", "hard")] * 3),
    "work after idle": ([HAND, "step", "step", "work", "step", "step"], [("level", "hand")] * 2),
    "soft is not told again for work": ([SOFT, "step", "work", "step"], [("level", "soft")]),
    "stops": ([SOFT, "stop", HAND, "stop", "stop", "work", "stop", "stop", HARD, "stop", "stop"], [("stop", "hand"), ("stop", "hand"), ("stop", "hard"), ("stop", "hard")]),
    "stop with work": (["work", HAND, "stop", "stop"], [("stop", "hand")]),
}


def noted(spark, tmp_path, rows):
    schema = "key string, at timestamp, ord int, tokens long, kind string"
    return streamed(spark, tmp_path, rows, schema, lambda s: sessions.context_notes(s.where("kind is null"), s.where("kind is not null")))


def test_context_notes(spark, tmp_path):
    rows = [(name, at(i), i, x if isinstance(x, int) else None, None if isinstance(x, int) else x) for name, (some, _) in NOTES.items() for i, x in enumerate(some)]
    rows += [("next day", at(0), 0, HAND, None), ("next day", at(1), 1, None, "prompt"), ("next day", at(2 * DAY), 2, None, "step")]
    got = {}
    for key, _, what, level, _ in noted(spark, tmp_path, rows):
        got.setdefault(key, []).append((what, level))
    assert got.pop("next day") == [("level", "hand")] * 2
    assert {k: v for k, v in got.items()} == {k: v for k, (_, v) in NOTES.items() if v}


def test_context_notes_equal_a_plain_loop(spark):
    kinds = {"click": "prompt", "view": "step", "purchase": "work", "signup": "stop"}
    want, state = [], {}
    for r in events(spark, SF).orderBy("ts", "event_id").collect():
        s = state.setdefault(r.user_id, {})
        for kind in ("usage", kinds.get(r.event_type)):
            if s.get("at") is not None and r.ts - s["at"] > timedelta(days=1):
                s = state[r.user_id] = {"tokens": s["tokens"]}
            if kind == "usage":
                s["tokens"] = int(r.value // 1) * 3000 or s.get("tokens", 0)
                continue
            stage = next((n for n, least in LEVELS if s["tokens"] >= least), None)
            rank = {None: 0, "soft": 1, "hand": 2, "hard": 3}
            if kind == "work" and not s.get("worked"):
                s.update(worked=True, at=r.ts)
            if kind in (None, "work") or stage is None:
                continue
            seen, worked = s.get("stage"), s.get("worked", False)
            if kind == "stop":
                if stage == "hard" or (stage == "hand" and s.get("stopped") != "worked" and not (s.get("stopped") == "idle" and not worked)):
                    if stage == "hand":
                        s.update(stopped="worked" if worked else "idle", at=r.ts)
                    want.append((str(r.user_id), r.ts, "stop", stage, s["tokens"]))
                continue
            ask = kind == "prompt" and seen != "hard" and ((worked or seen == "hand") if stage == "hand" else seen == "soft")
            again = stage == seen == "hard" and (kind == "prompt" or s["tokens"] - s["told"] >= 20_000)
            if seen and rank[seen] >= rank[stage] and not ask and not again and not (worked and s["idle"] and rank[seen] >= 2):
                continue
            s.update(stage=stage, told=s["tokens"], idle=not worked, at=r.ts)
            want.append((str(r.user_id), r.ts, "request" if ask else "level", stage, s["tokens"]))
    assert len(want) > 50
    assert sorted(map(tuple, plans.stream_context_notes(spark, SF).collect())) == sorted(want)
