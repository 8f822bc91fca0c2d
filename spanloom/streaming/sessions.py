"""Keyed decisions with more than one value for each session: marks that each live their own time, attempts by command with edits between, notices from prompts and usage.

Rows of a key are taken in order of ``at`` and, where there is one, ``ord``. Every entry of a map
goes when its own time is over, by event-time timers; a session's other entries stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.streaming.states import DAY, LEVELS, run


def in_order(rows: Iterator[pd.DataFrame]) -> list:
    frames = [r for r in rows if len(r)]
    if not frames:
        return []
    whole = pd.concat(frames)
    return list(whole.sort_values(["at", *(c for c in ("ord",) if c in whole)], kind="stable").itertuples(index=False))


def millis(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class Timed(StatefulProcessor):
    """One event-time timer for a key, at the end of what lives shortest."""

    def wake(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Marks(Timed):
    """Marks of a session, each with its last time; a row that ``asks`` is allowed if all of ``needs`` live and ``reads`` is later than each of ``changes``.

    A mark lives ``keep`` milliseconds from its own last time, or with ``together`` from the
    session's last mark. ``missing`` names the first thing that is not there.
    """

    def __init__(self, needs: Sequence[str] = (), reads: str | None = None, changes: Sequence[str] = (), keep: int = 7 * DAY, together: bool = False):
        self.needs, self.reads, self.changes, self.keep, self.together = tuple(needs), reads, tuple(changes), keep, together

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getMapState("marks", "name string", "at long")

    def ends(self, held: dict[str, int]) -> dict[str, int]:
        last = max(held.values(), default=0)
        return {k: (last if self.together else t) + self.keep for k, t in held.items()}

    def prune(self, held: dict[str, int], now: int) -> dict[str, int]:
        ends = self.ends(held)
        return {k: t for k, t in held.items() if ends[k] >= now}

    def read(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.marks.iterator()} if self.marks.exists() else {}

    def write(self, before: dict[str, int], now: dict[str, int]) -> None:
        for name in before.keys() - now.keys():
            self.marks.removeKey((name,))
        for name, at in now.items():
            if before.get(name) != at:
                self.marks.updateValue((name,), (at,))
        self.wake(min(self.ends(now).values()) + 1 if now else None)

    def missing(self, held: dict[str, int]) -> str | None:
        for name in self.needs:
            if name not in held:
                return name
        if self.reads is not None and held.get(self.reads, 0) <= max((held.get(c, 0) for c in self.changes), default=0):
            return self.reads
        return None

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        before = self.read()
        held, out = dict(before), []
        for row in in_order(rows):
            held = self.prune(held, millis(row.at))
            if row.asks:
                lacks = self.missing(held)
                out.append((key[0], row.at, lacks is None, lacks))
            if isinstance(row.mark, str):
                held[row.mark] = millis(row.at)
        self.write(before, held)
        yield pd.DataFrame(out, columns=["key", "at", "allowed", "missing"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.read()
        self.write(before, self.prune(before, expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())


class Attempts(Timed):
    """A hint at the ``most``-th failure of one command with an edit before each but the first, once for each session.

    Rows: kind (edit, pass, fail, skip), command, hints (whether a hint would be given now). A
    failure without an edit since the last one of its command does not count; a pass begins anew.
    Commands and sessions are forgotten after ``keep`` milliseconds without a row.
    """

    def __init__(self, most: int = 3, keep: int = DAY):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "edits long, hinted boolean")
        self.checks = handle.getMapState("checks", "command string", "fails int, edits long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        edits, hinted = self.session.get() if self.session.exists() else (0, False)
        before = {k[0]: tuple(v) for k, v in self.checks.iterator()} if self.checks.exists() else {}
        held, out, last = dict(before), [], None
        for row in in_order(rows):
            last = row
            if hinted or row.kind == "skip":
                continue
            if row.kind == "edit":
                edits += 1
            elif row.kind == "pass":
                held.pop(row.command, None)
            else:
                fails, then = held.get(row.command, (0, None))
                if then != edits:
                    held[row.command] = (fails + 1, edits)
                    if fails + 1 >= self.most and row.hints:
                        hinted = True
                        out.append((key[0], row.at, row.command, fails + 1))
        if hinted:
            held = {}  # nothing is said after the hint
        for command in before.keys() - held.keys():
            self.checks.removeKey((command,))
        for command, value in held.items():
            if before.get(command) != value:
                self.checks.updateValue((command,), value)
        self.session.update((edits, hinted))
        if last is not None:
            self.wake(millis(last.at) + self.keep)
        yield pd.DataFrame(out, columns=["key", "at", "command", "failures"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.clear()
        if self.checks.exists():
            self.checks.clear()
        return iter(())


class Context(Timed):
    """Notices of a session from two streams: usage (``tokens``), and what happens: prompt, step, work, stop.

    A level is told once, a higher one over it. At a prompt the hardest level is told every time,
    and below it a new request (``request``): at soft from the second prompt on, at hand in a
    session with work at once, without work from the second prompt on. At a step the hardest
    level is told again after ``step`` more tokens. Work that begins after a hand or hard was told
    to a session without it lets the level be told once more. A stop is held back (``stop``) at hard
    always, at hand once and once again after work. All is forgotten ``keep`` after the last change.
    """

    def __init__(self, levels=LEVELS, step: int = 20_000, keep: int = DAY):
        self.levels, self.step, self.keep = levels, step, keep
        self.rank = {name: k for k, (name, _) in enumerate(reversed(levels), 1)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.usage = handle.getValueState("usage", "tokens long")
        self.told = handle.getValueState("told", "level string, tokens long, idle boolean, worked boolean, stopped string, at long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        tokens = self.usage.get()[0] if self.usage.exists() else 0
        level, at_tokens, idle, worked, stopped, at = self.told.get() if self.told.exists() else (None, 0, None, False, None, None)
        out = []
        for row in in_order(rows):
            now = millis(row.at)
            if at is not None and now - at > self.keep:
                level, at_tokens, idle, worked, stopped, at = None, 0, None, False, None, None
            if row.kind == "usage":
                tokens = int(row.tokens) or tokens
                continue
            stage = next((n for n, least in self.levels if tokens >= least), None)
            if row.kind == "work":
                if not worked:
                    worked, at = True, now
                continue
            if stage is None:
                continue
            top, rank = self.levels[0][0], self.rank
            if row.kind == "stop":
                given = stage != top and (rank[stage] < 2 or stopped == "worked" or (stopped == "idle" and not worked))
                if not given:
                    if stage != top:
                        stopped, at = "worked" if worked else "idle", now
                    out.append((key[0], row.at, "stop", stage, tokens))
                continue
            prompt = row.kind == "prompt"
            request = prompt and level != top and ((worked or level == "hand") if stage == "hand" else level == "soft")
            again = stage == top and level == top and (prompt or tokens - at_tokens >= self.step)
            begun = worked and idle is True and level is not None and rank[level] >= 2
            if level is not None and rank[level] >= rank[stage] and not (request or again or begun):
                continue
            out.append((key[0], row.at, "request" if request else "level", stage, tokens))
            level, at_tokens, idle, at = stage, tokens, not worked, now
        self.usage.update((tokens,))
        if at is not None:
            self.told.update((level, at_tokens, idle, worked, stopped, at))
            self.wake(at + self.keep + 1)
        yield pd.DataFrame(out, columns=["key", "at", "what", "level", "tokens"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.told.clear()
        self.usage.clear()
        return iter(())


def commit_gate(stream: DataFrame, **rule) -> DataFrame:
    """Rows: key, at, mark (or null), asks."""
    return run(stream, Marks(**rule), "key string, at timestamp, allowed boolean, missing string")


def attempts(stream: DataFrame, **rule) -> DataFrame:
    """Rows: key, at, kind, command, hints."""
    return run(stream, Attempts(**rule), "key string, at timestamp, command string, failures int")


def context_notes(usage: DataFrame, happened: DataFrame, **rule) -> DataFrame:
    """``usage``: key, at, ord, tokens. ``happened``: key, at, ord, kind. Usage at the same place comes first."""
    both = usage.select("key", "at", (F.col("ord") * 2).alias("ord"), F.lit("usage").alias("kind"), "tokens").unionByName(happened.select("key", "at", (F.col("ord") * 2 + 1).alias("ord"), "kind", F.lit(0).cast("long").alias("tokens")))
    return run(both, Context(**rule), "key string, at timestamp, what string, level string, tokens long")
