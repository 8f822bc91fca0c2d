"""Reports on sessions, files and links: parts of a transcript, periods, worst cases, pruning, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def tail(rows: DataFrame, keys: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    """The whole rows within the last ``most`` bytes of each group; of a longer group the row that the cut falls on goes."""
    own = rows.withColumn("_size", size)
    w = Window.partitionBy(*keys).orderBy(*order)
    behind = F.sum("_size").over(w.rowsBetween(0, Window.unboundedFollowing))
    every = F.sum("_size").over(Window.partitionBy(*keys))
    return own.withColumns({"_behind": behind, "_every": every}).where((F.col("_every") <= most) | (F.col("_behind") < most)).drop("_size", "_behind", "_every")


def head(rows: DataFrame, keys: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    """The whole rows within the first ``most`` bytes of each group."""
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_before", before).where(F.col("_before") <= most).drop("_before")


def log_tail(lines: DataFrame, keys: list[str], order: Column, size: Column, limit: int, keep: int) -> DataFrame:
    """The last ``keep`` lines of each log of more than ``limit`` bytes; other logs whole."""
    own = lines.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc())))
    own = own.withColumn("_size", F.sum(size).over(Window.partitionBy(*keys)))
    return own.where((F.col("_size") <= limit) | (F.col("_n") <= keep)).drop("_n", "_size")


def occupancy(tokens: Column, window: int = 1_000_000) -> Column:
    return F.floor(100 * tokens / window + 0.5).cast("long")


def latest_usage(rows: DataFrame, key: str, order: Column, own: Column, tokens: Column, window: int = 1_000_000) -> DataFrame:
    """key, tokens, percent: the last row of the main chain that used any tokens."""
    last = rows.where(own & (tokens > 0)).groupBy(key).agg(F.max_by(tokens, order).alias("tokens"))
    return last.withColumn("percent", occupancy(F.col("tokens"), window))


def unanswered(rows: DataFrame, key: str, order: Column, closes: Column, answers: Column) -> DataFrame:
    """key and place of the last closing row that no answer follows."""
    last = rows.groupBy(key).agg(F.max(F.when(closes, order)).alias("place"), F.max(F.when(answers, order)).alias("_after"))
    return last.where("place is not null and (_after is null or _after < place)").drop("_after")


def last_turn(rows: DataFrame, key: str, order: str, prompt: Column) -> DataFrame:
    """The rows from each group's last prompt on, with ``_prompt``, its place; groups without a prompt whole."""
    place = F.max(F.when(prompt, F.col(order))).over(Window.partitionBy(key))
    return rows.withColumn("_prompt", place).where(F.col("_prompt").isNull() | (F.col(order) >= F.col("_prompt")))


def period_start(now: Column, days: int, today: bool = False) -> Column:
    """The start of the session time zone's day, or so many times 86,400 seconds back."""
    return F.date_trunc("day", now) if today else F.timestamp_micros(F.unix_micros(now) - days * DAY * 1_000_000)


def in_period(ledger: DataFrame, since: Column, project: str = "") -> DataFrame:
    """Sessions that ended since then, whose project, as it is written, holds ``project``; in order of their end."""
    return ledger.where(F.col("ended").isNotNull() & (F.col("ended") >= since) & F.col("project").contains(project)).orderBy("ended", "session")


def multi_calls(calls: DataFrame, response: list[str], session: str, tool: Column) -> DataFrame:
    """session, tooled (responses with a tool call) and multi (with several)."""
    each = calls.groupBy(*response).agg(F.count_if(tool).alias("_n"))
    return each.groupBy(session).agg(F.count_if(F.col("_n") > 0).alias("tooled"), F.count_if(F.col("_n") > 1).alias("multi"))


def worst_of_class(lost: DataFrame) -> DataFrame:
    """Of (session, class, tok, usd): class, tok, usd and the session that lost most, of equals the smallest."""
    return lost.groupBy("class").agg(F.sum("tok").alias("tok"), F.sum("usd").alias("usd"), F.max_by("session", F.struct("usd", -F.col("session"))).alias("worst"))


def top_class(lost: DataFrame) -> DataFrame:
    """session and the class it lost most in, of equals the first by name."""
    first = F.min_by("class", F.struct(-F.col("usd"), F.col("class")))
    return lost.where("usd > 0").groupBy("session").agg(first.alias("class"))


def worst_sessions(lost: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sessions with the most usd, and of these the ones with any tok."""
    each = lost.groupBy("session").agg(F.sum("tok").alias("tok"), F.sum("usd").alias("usd"))
    return each.orderBy(F.desc("usd"), "session").limit(k).where("tok > 0")


def missing_calls(rows: DataFrame, session: str, flags: dict[str, Column]) -> DataFrame:
    """name, calls and sessions with any, for each flag; one pass and one row a session in between."""
    each = rows.groupBy(session).agg(*(F.count_if(c).alias(n) for n, c in flags.items()))
    sums = each.agg(*(F.struct(F.sum(n).alias("calls"), F.count_if(F.col(n) > 0).alias("sessions")).alias(n) for n in flags))
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}.calls").alias("calls"), F.col(f"{n}.sessions").alias("sessions")) for n in flags)))
    return sums.select(one.alias("r")).select("r.*")


def commit_allowed(rows: DataFrame, key: str, order: Column, diff: Column, edit: Column, review: Column) -> DataFrame:
    """key and allowed: whether the last diff stands after the last edit and the last loading of the review rules."""
    last = lambda c: F.max(F.when(c, order))
    each = rows.groupBy(key).agg(last(diff).alias("_d"), F.greatest(last(edit), last(review)).alias("_e"))
    return each.select(key, F.coalesce(F.col("_d") > F.col("_e"), F.col("_d").isNotNull()).alias("allowed"))


def not_loaded(required: Column, loaded: Column) -> Column:
    return F.array_sort(F.array_except(required, loaded))


def with_implied(grants: Column, implied: dict[str, str]) -> Column:
    """The grants and those that they imply (one step, as given)."""
    more = [F.when(F.array_contains(grants, a), F.lit(b)) for a, b in sorted(implied.items())]
    return F.array_sort(F.array_union(grants, F.array_compact(F.array(*more))))


def union_by_key(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one of the first table that has them, within a table the least."""
    rest = [c for c in tables[0].columns if c not in keys]
    every = None
    for k, t in enumerate(tables):
        own = t.select(*keys, F.struct(F.lit(k).alias("_k"), *rest).alias("_r"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(*keys).agg(F.min("_r").alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def rarest(sides: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` literals with the fewest sides, by name among equals."""
    return sides.orderBy("sides", "literal").limit(k)


def expired(files: DataFrame, days: dict[str, int], now: Column, keep: list[str]) -> Column:
    """Whether a file of a pruned folder is older than its folder's days; ``keep`` lists paths that never go."""
    most = F.coalesce(*(F.when(F.col("folder") == f, F.lit(n)) for f, n in sorted(days.items())))
    return most.isNotNull() & (F.col("mtime") < now - most * DAY) & ~F.col("path").isin(keep)


def prune_report(files: DataFrame, days: dict[str, int], now: Column, keep: list[str]) -> DataFrame:
    """folder, files and bytes that are due."""
    return files.where(expired(files, days, now, keep)).groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def pruned(files: DataFrame, days: dict[str, int], now: Column, keep: list[str]) -> DataFrame:
    """What stays."""
    return files.where(~F.coalesce(expired(files, days, now, keep), F.lit(False)))


def last_of_folder(paths: DataFrame, path: str = "path") -> DataFrame:
    """folder, files and the last name, of each folder."""
    folder, name = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return paths.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.max(name).alias("last"))


def oversized(prompt: Column, paste: int, plan: Column, longest: int, heading: str, stale: str) -> tuple[Column, Column]:
    """What is refused: a prompt by its length, a plan for stacking snapshots or by its length; null if nothing."""
    stacked = (F.regexp_count(plan, F.lit(rf"(?m)^{heading}")) > 1) | plan.rlike(stale)
    return F.when(F.length(prompt) > paste, "long"), F.when(stacked, "stacked").when(F.length(plan) > longest, "long")


def names_word(text: Column, word: str) -> Column:
    """Whether the text has the word whole: letters, digits, _ and - do not border it; ё counts as е."""
    plain = lambda c: F.translate(F.lower(c), "ё", "е")
    return plain(text).rlike(rf"(^|[^\p{{L}}\p{{N}}_-])\Q{word.lower().replace('ё', 'е')}\E([^\p{{L}}\p{{N}}_-]|$)")


def last_report(log: Column) -> Column:
    """Of a log's text the JSON that stands last on lines of its own, else an error with the last line that is not blank, cut to its last 200 characters."""
    tail = F.regexp_extract(log, r"(?s)^(?:.*\n)?(\{.*)$", 1)
    report = F.try_parse_json(F.nullif(tail, F.lit("")))
    lines = F.filter(F.split(log, r"\r?\n"), lambda x: F.trim(x) != "")
    last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
    error = F.when(last == "", "empty log").otherwise(F.substring(last, F.greatest(F.length(last) - 199, F.lit(1)), F.lit(200)))
    return F.struct(F.to_json(report).alias("report"), F.when(report.isNull(), error).alias("error"))


def both_ways(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key and side: what is listed but absent, and what is present but not listed."""
    absent, extra = listed.select(key).distinct(), present.select(key).distinct()
    return absent.join(extra, key, "left_anti").withColumn("side", F.lit("absent")).unionByName(extra.join(absent, key, "left_anti").withColumn("side", F.lit("unlisted")))


def merged_reports(reports: DataFrame) -> DataFrame:
    """Counters add up."""
    return reports.agg(*(F.sum(c).alias(c) for c in reports.columns))


def main_and_sub(main: DataFrame, sub: DataFrame, session: str) -> DataFrame:
    """session, messages of both kinds together, and subagents: transcripts with any message."""
    both = main.withColumn("_agent", F.lit(None).cast("long")).unionByName(sub.withColumnRenamed("agent", "_agent"))
    return both.groupBy(session).agg(F.count("*").alias("messages"), F.countDistinct("_agent").alias("subagents"))


def first_seen(rows: DataFrame, path: str, ts: str) -> DataFrame:
    return rows.groupBy(path).agg(F.min(ts).alias("first_seen"))
