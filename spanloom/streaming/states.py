"""Keyed decisions over event streams: threshold notices, a circuit breaker, failure streaks, show-once marks.

Each is a processor over rows of one key in event-time order within a batch; state lives in
the state store and goes when a key has been still for its time to live. Rows later than the
watermark are dropped. All take streams with ``key`` (string) and ``at`` (timestamp).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
LEVELS = (("hard", 220_000), ("hand", 150_000), ("soft", 100_000))


def by_time(rows: Iterator[pd.DataFrame]) -> list:
    frames = [r for r in rows if len(r)]
    return list(pd.concat(frames).sort_values("at", kind="stable").itertuples(index=False)) if frames else []


class Expiring(StatefulProcessor):
    """State that a timer clears, set anew by each batch of a key."""

    live = DAY

    def renew(self, rows: list) -> None:
        if rows:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(rows[-1].at.timestamp() * 1000) + self.live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Notices(Expiring):
    """A notice when ``tokens`` first reaches a level, each time at the hardest, and again after ``step`` more tokens."""

    def __init__(self, levels=LEVELS, step: int = 20_000):
        self.levels, self.step = levels, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("told", "level string, tokens long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        level, last = self.state.get() if self.state.exists() else (None, 0)
        names = [n for n, _ in reversed(self.levels)]
        out = []
        rows = by_time(rows)
        self.renew(rows)
        for row in rows:
            now = next((n for n, least in self.levels if row.tokens >= least), None)
            if now is None:
                level, last = None, 0
                continue
            higher = level is None or names.index(now) > names.index(level)
            if higher or now == self.levels[0][0] or row.tokens >= last + self.step:
                out.append((key[0], row.at, now, int(row.tokens)))
                level, last = now, int(row.tokens)
        if level is None:
            self.state.clear()
        else:
            self.state.update((level, last))
        yield pd.DataFrame(out, columns=["key", "at", "level", "tokens"])


class Breaker(Expiring):
    """The first call is blocked; one within ``seconds`` of it passes. The time is that of the first call and is not renewed."""

    def __init__(self, seconds: float = 180):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first", "at timestamp")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        anchor = pd.Timestamp(self.state.get()[0]) if self.state.exists() else None
        out = []
        rows = by_time(rows)
        self.renew(rows)
        for row in rows:
            passes = anchor is not None and (row.at - anchor).total_seconds() <= self.seconds
            if not passes:
                anchor = row.at
            out.append((key[0], row.at, not passes))
        if anchor is not None:
            self.state.update((anchor.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["key", "at", "blocked"])


class Streaks(Expiring):
    """A hint at the ``most``-th failure in a row (``failed``), once; a success ends the run."""

    def __init__(self, most: int = 3):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", "n int, told boolean")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        n, told = self.state.get() if self.state.exists() else (0, False)
        out = []
        rows = by_time(rows)
        self.renew(rows)
        for row in rows:
            n = n + 1 if row.failed else 0
            if n >= self.most and not told:
                told = True
                out.append((key[0], row.at, n))
        self.state.update((n, told))
        yield pd.DataFrame(out, columns=["key", "at", "failures"])


class Handoffs(Expiring):
    """A session sets a pending handoff of its project; another session takes it once, within ``hours``; the same one drops it."""

    def __init__(self, hours: float = 12):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "session string, at timestamp")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        out = []
        rows = by_time(rows)
        self.renew(rows)
        for row in rows:
            if row.sets:
                held = (row.session, row.at.to_pydatetime())
            elif held is not None:
                fresh = (row.at - pd.Timestamp(held[1])).total_seconds() <= self.hours * 3600
                if held[0] != row.session and fresh:
                    out.append((key[0], row.at, held[0], row.session))
                held = None
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)
        yield pd.DataFrame(out, columns=["key", "at", "from_session", "to_session"])


def run(stream: DataFrame, processor: StatefulProcessor, schema: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("at", late).groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def notices(stream: DataFrame, **rule) -> DataFrame:
    return run(stream, Notices(**rule), "key string, at timestamp, level string, tokens long")


def breaker(stream: DataFrame, **rule) -> DataFrame:
    return run(stream, Breaker(**rule), "key string, at timestamp, blocked boolean")


def failure_streaks(stream: DataFrame, **rule) -> DataFrame:
    return run(stream, Streaks(**rule), "key string, at timestamp, failures int")


def handoffs(stream: DataFrame, **rule) -> DataFrame:
    return run(stream, Handoffs(**rule), "key string, at timestamp, from_session string, to_session string")


def show_once(stream: DataFrame, marks: list[str], days: int = 2) -> DataFrame:
    """The first row of each combination of marks; later ones within the watermark go. Rows later than it are dropped."""
    return stream.withWatermark("at", f"{days} days").dropDuplicatesWithinWatermark(marks)


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by key and window; rows later than the watermark are dropped."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "key").agg(F.count("*").alias("n")).select("key", F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended as Parquet."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
