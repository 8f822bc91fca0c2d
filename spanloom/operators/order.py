"""Order-dependent logic as windows: segments, repeated reads, charges to later calls, gaps, streaks, handoffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.shared import written


def ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def segments(calls: DataFrame, by: list[str], order: list[str], window: str = "win") -> DataFrame:
    """seg: a new one begins where the window falls below half of the one before. left: calls to its end, this one too."""
    w = ordered(by, order)
    fell = F.coalesce((F.col(window) < F.lag(window).over(w) / 2).cast("int"), F.lit(0))
    cut = calls.withColumn("_fell", fell).withColumn("seg", F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")
    ahead = ordered([*by, "seg"], order).rowsBetween(0, Window.unboundedFollowing)
    return cut.withColumn("left", F.count("*").over(ahead))


def rereads(events: DataFrame, by: list[str], order: list[str], target: str, is_edit: Column, is_read: Column) -> DataFrame:
    """Reads with again (read before without an edit of the target since) and last_edit (no later edit)."""
    own = events.where(is_edit | is_read).withColumns({"_edit": is_edit.cast("int"), "_read": is_read})
    w = ordered([*by, target], order)
    epoch = F.sum("_edit").over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.coalesce(F.sum("_edit").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    marked = own.withColumns({"epoch": epoch, "later_edits": later}).where("_read").drop("_edit", "_read")
    nth = F.row_number().over(ordered([*by, target, "epoch"], order))
    return marked.withColumn("again", nth > 1)


def charge_next(calls: DataFrame, events: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """Events of kind next, each with the window and cost of the call after; a call is charged once, to the first event."""
    following = calls.select(*by, (F.col("i") - 1).alias(at), F.col("win").alias("tok"), "usd")
    nth = F.row_number().over(ordered([*by, at], ["event_id"]))
    joined = events.withColumn("_nth", nth).join(following, [*by, at], "left")
    pay = lambda c: F.when(F.col("_nth") == 1, F.coalesce(c, F.lit(0))).otherwise(0)
    return joined.withColumns({"tok": pay("tok"), "usd": pay("usd")}).drop("_nth")


def charge_carry(calls: DataFrame, events: DataFrame, by: list[str], write: Column, read: Column, at: str = "at") -> DataFrame:
    """Events of kind carry: their tokens are written once and read again by each later call of the segment; dropped without a later call."""
    following = calls.select(*by, (F.col("i") - 1).alias(at), "left")
    joined = events.join(following, [*by, at])
    return joined.withColumn("carried", F.col("tok") * F.col("left")).withColumn("usd", (F.col("tok") * write + F.col("tok") * (F.col("left") - 1) * read) / 1e6)


def denied_repeats(events: DataFrame, by: list[str], order: list[str], denied: Column, same: list[str]) -> DataFrame:
    """Events that follow a denied one at once and equal it."""
    w = ordered(by, order)
    equal = F.lag(denied).over(w)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    return events.withColumn("repeat", F.coalesce(equal, F.lit(False)))


def open_gaps(events: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column, key: str) -> DataFrame:
    """gap: the key of the last opening event, if none has closed it since."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(opens, F.struct(F.lit(True).alias("open"), F.col(key).alias("k"))).when(closes, F.struct(F.lit(False).alias("open"), F.col(key).alias("k")))
    last = F.last(mark, ignorenulls=True).over(w)
    return events.withColumn("_last", last).withColumn("gap", F.when(F.col("_last.open"), F.col("_last.k"))).drop("_last")


def streaks(events: DataFrame, by: list[str], order: list[str], fails: Column) -> DataFrame:
    """Runs of failures: number of the run and place in it."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((~fails).cast("int")).over(w)
    return events.withColumns({"fails": fails, "run": run}).where("fails").withColumn("streak", F.row_number().over(ordered([*by, "run"], order))).drop("fails")


def attempts(events: DataFrame, by: list[str], order: list[str], command: str, is_edit: Column, is_pass: Column, is_fail: Column) -> DataFrame:
    """Failures of a command with their number since its last pass, and counted: those without an edit since the one before have that one's number and are not counted.

    Two counters make the islands: passes of the command, and edits of the whole group.
    """
    past = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    own = events.withColumns({"_edits": F.sum(is_edit.cast("int")).over(past), "_fail": is_fail, "_pass": is_pass}).where("_fail or _pass")
    run = F.sum(F.col("_pass").cast("int")).over(ordered([*by, command], order).rowsBetween(Window.unboundedPreceding, 0))
    failed = own.withColumn("_run", run).where("_fail")
    nth = F.row_number().over(ordered([*by, command, "_run", "_edits"], order))
    return failed.withColumns({"failures": F.dense_rank().over(ordered([*by, command, "_run"], ["_edits"])), "counted": nth == 1}).drop("_edits", "_run", "_fail", "_pass")


def first_and_last(lines: DataFrame, by: list[str], order: str, head: int = 40, tail: int = 120) -> DataFrame:
    """The first and last lines, with how many are left out between."""
    w = Window.partitionBy(*by)
    n = F.row_number().over(w.orderBy(order))
    total = F.count("*").over(w)
    own = lines.withColumns({"_n": n, "_total": total})
    return own.where((F.col("_n") <= head) | (F.col("_n") > F.col("_total") - tail)).withColumn("omitted", F.greatest(F.col("_total") - head - tail, F.lit(0))).drop("_n", "_total")


def handoff_edges(exits: DataFrame, starts: DataFrame, keys: list[str], seconds: float = 10, slot: str = "ts") -> DataFrame:
    """Each exit (session, ts) with the nearest start of another session of equal keys within ``seconds``.

    Times are cut into slots of that length. In a slot, the last start before each exit comes with the last
    one of another session than that; both stand for all before them. A slot lends its first and last
    starts, of two sessions each, to those beside it. So no exit meets more than four starts, however close they lie.
    """
    width = int(seconds * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in [*keys, "_s", "_t"]))
    rows = lambda df, is_exit: df.select(*keys, F.col("session").alias("_s"), micros(slot).alias("_t"), F.lit(is_exit).alias("_exit")).where(there).distinct().withColumn("_cell", F.floor(F.col("_t") / width))
    left, right = rows(exits, 1), rows(starts, 0)
    in_cell = Window.partitionBy(*keys, "_cell")
    early, late = in_cell.orderBy("_t", "_s"), in_cell.orderBy(F.col("_t").desc(), "_s")
    for name, w in (("_early", early), ("_late", late)):
        first = F.first("_s").over(w)
        before = F.first(F.when(F.col("_other") != 0, 1), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        right = right.withColumn("_other", (F.col("_s") != first).cast("int")).withColumn(name, (F.row_number().over(w) == 1) | ((F.col("_other") == 1) & before.isNull())).drop("_other")
    lent = right.where("_early").withColumn("_cell", F.col("_cell") - 1).unionByName(right.where("_late").withColumn("_cell", F.col("_cell") + 1))
    every = left.unionByName(right.unionByName(lent).drop("_early", "_late"))
    start = F.when(F.col("_exit") == 0, F.struct("_t", "_s"))
    for side, time in (("_b", F.col("_t")), ("_a", F.col("_t").desc())):  # starts of a time stand before its exits, the least session last
        w = in_cell.orderBy(time, "_exit", F.col("_s").desc())
        past = F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        every = every.withColumn(side, past)
        turn = F.when((F.col("_exit") == 0) & (F.col(f"{side}._s") != F.col("_s")), F.col(side))
        every = every.withColumn(f"{side}_other", F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = lambda c: F.when((F.col(f"{c}._s") != F.col("_s")) & (F.abs(F.col(f"{c}._t") - F.col("_t")) <= width), F.struct(F.abs(F.col(f"{c}._t") - F.col("_t")).alias("gap"), F.col(f"{c}._t").alias("u"), F.col(f"{c}._s").alias("child")))
    best = every.where("_exit = 1").withColumn("b", F.array_min(F.array_compact(F.array(*(near(c) for c in ("_b", "_b_other", "_a", "_a_other"))))))
    return best.where("b is not null").select(*keys, F.col("_s").alias("parent"), F.col("_t").alias("exit_us"), F.col("b.child").alias("child"), F.col("b.gap").alias("gap_us"))


def chain_ends(edges: DataFrame, most: int = 50) -> DataFrame:
    """parent, last and hops: edges (parent, child; one child each) followed to their end, for ``most`` hops, or to the last link before one that was there already.

    The way of each parent, at most ``most`` links, doubles in each round; a round joins only the
    ways that can still grow, and its rows are written before the next one reads them twice.
    """
    joined = F.slice(F.concat("way", F.coalesce("more", F.array().cast("array<long>"))), 1, most)
    nth = F.filter(F.sequence(F.lit(1), F.size("way")), lambda i: (F.get("way", i - 1) == F.col("parent")) | (F.array_position("way", F.get("way", i - 1)) < i))
    first = F.array_min(nth)
    cut = F.when(first.isNull(), F.col("way")).otherwise(F.slice("way", 1, first - 1))
    step = edges.where("parent != child").select(F.col("parent").cast("long").alias("parent"), F.array(F.col("child").cast("long")).alias("way"), F.lit(True).alias("open"))
    full = 1
    while full < most:
        step = written(step, "ways")
        onward = step.select(F.col("parent").alias("_at"), F.col("way").alias("more"))
        grown = step.where("open").withColumn("_at", F.element_at("way", -1)).join(onward, "_at", "left").select("parent", joined.alias("way"))
        full = min(2 * full, most)
        grown = grown.select("parent", "way", first.isNotNull().alias("_back"), cut.alias("_cut")).select("parent", F.col("_cut").alias("way"), (~F.col("_back") & (F.size("way") == full)).alias("open"))
        step = step.where("not open").unionByName(grown)
    return step.select("parent", F.element_at("way", -1).alias("last"), F.size("way").alias("hops"))


def level(tokens: Column, soft: int = 100_000, hand: int = 150_000, hard: int = 220_000) -> Column:
    return F.when(tokens >= hard, "hard").when(tokens >= hand, "hand").when(tokens >= soft, "soft")
