"""Token and cost ledgers of sessions, shares of tool groups, reports and monthly rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.money import cost, ledger_writes, month_key, priced
from spanloom.functions.text import percent, skill_name

SYNTHETIC = "<synthetic>"


def wins(df: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    """One row of each key: the last or the first in order. Null keys are one key."""
    window = Window.partitionBy(*keys).orderBy(*(c.desc() if last else c for c in order))
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def answers(records: DataFrame, last: bool) -> DataFrame:
    """Model calls of a session, one for each message id (else uuid)."""
    calls = records.where("type = 'assistant' and usage is not null").withColumn("call", F.coalesce("message_id", "uuid"))
    return wins(calls, ["session", "call"], [F.col("pos")], last)


def ledger(records: DataFrame, prices: DataFrame) -> DataFrame:
    """session, model and its tokens, messages, cost (4 places) and priced; the last record of a message counts, side chains too."""
    five, hour = ledger_writes(F.col("usage"))
    calls = answers(records, last=True).withColumns({"write_5m": five, "write_1h": hour})
    sums = calls.groupBy("session", "model").agg(
        F.sum(F.coalesce("usage.input_tokens", F.lit(0))).alias("input"),
        F.sum(F.coalesce("usage.output_tokens", F.lit(0))).alias("output"),
        F.sum(F.coalesce("usage.cache_read_input_tokens", F.lit(0))).alias("cache_read"),
        F.sum("write_5m").alias("write_5m"),
        F.sum("write_1h").alias("write_1h"),
        F.count("*").alias("messages"),
    )
    money = F.round(cost(*(F.col(c) for c in ("input", "output", "cache_read", "write_5m", "write_1h"))), 4)
    return priced(sums, prices).withColumn("cost", money).drop("price")


def session_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("session").agg(F.round(F.sum("cost"), 4).alias("cost"), F.bool_and("priced").alias("priced"), F.sum("messages").alias("messages"))


def tool_counts(blocks: DataFrame) -> DataFrame:
    """session, tool, calls over all tool_use blocks."""
    return blocks.where("kind = 'tool_use'").groupBy("session", "tool").agg(F.count("*").alias("calls"))


def skill_counts(blocks: DataFrame, tool: str = "Skill") -> DataFrame:
    name = skill_name(F.get_json_object("input", "$.skill"))
    return blocks.where((F.col("kind") == "tool_use") & (F.col("tool") == tool)).select("session", name.alias("skill")).where("skill is not null").groupBy("session", "skill").agg(F.count("*").alias("calls"))


def context_sources(blocks: DataFrame) -> DataFrame:
    """session, tool, path (of reads), calls, chars of results; results without a call are of 'unknown'."""
    uses = blocks.where("kind = 'tool_use'").select("session", F.col("use_id").alias("answers"), "tool", F.get_json_object("input", "$.file_path").alias("path"))
    results = blocks.where("kind = 'tool_result'").select("session", "answers", "chars")
    joined = results.join(uses.dropDuplicates(["session", "answers"]), ["session", "answers"], "left")
    tool = F.coalesce("tool", F.lit("unknown"))
    return joined.groupBy("session", tool.alias("tool"), F.when(tool == "Read", F.col("path")).alias("path")).agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"))


def main_chain(records: DataFrame) -> DataFrame:
    """Without side chains and synthetic answers."""
    return records.where(~F.coalesce("isSidechain", F.lit(False)) & ~F.coalesce(F.col("model") == SYNTHETIC, F.lit(False)))


def by_period(sessions: DataFrame, cutoff: str, sums: list[str], start: str = "start", project: str = "project") -> DataFrame:
    """Sums by project and period, and by period over all projects (project null), before and after an ISO cutoff."""
    own = sessions.withColumn("period", F.when(F.col(start) >= F.lit(cutoff), "after").otherwise("before"))
    grouped = own.groupingSets([[F.col(project), F.col("period")], [F.col("period")]], F.col(project), F.col("period"))
    return grouped.agg(F.grouping(project).cast("int").alias("all_projects"), F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in sums))


def shares(df: DataFrame, part: str, whole: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, percent(F.col(part), F.col(whole)))


def rollup(rows: DataFrame, earlier: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Months of rows that ended before a time, merged with ``earlier`` months; and the rows that stay.

    Both sides are summed by month, so doing it again changes nothing.
    """
    old = rows.where(F.col("ended") < before)
    stay = rows.where(F.col("ended").isNull() | (F.col("ended") >= before))
    months = old.select(month_key(F.col("ended")).alias("month"), F.lit(1).cast("long").alias("sessions"), "cost")
    merged = months.unionByName(earlier.select("month", "sessions", "cost")).groupBy("month").agg(F.sum("sessions").alias("sessions"), F.round(F.sum("cost"), 4).alias("cost"))
    return merged, stay


def nearest_root(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Each path with the longest root above it: its parents are exploded and joined by equality."""
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.select(path, F.explode(parents).alias("root"))
    found = each.join(roots.select("root").distinct(), "root").groupBy(path).agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(found, path, "left")


def start_cost(records: DataFrame, layer: Column, tokens: Column) -> DataFrame:
    """session, layer, tokens of what stands before the first real answer."""
    answer = F.when((F.col("type") == "assistant") & ~F.coalesce(F.col("model") == SYNTHETIC, F.lit(False)), F.col("pos"))
    first = F.min(answer).over(Window.partitionBy("session"))
    own = records.withColumns({"_first": first, "layer": layer, "_tokens": tokens}).where("_first is not null and pos < _first and layer is not null")
    return own.groupBy("session", "layer").agg(F.sum("_tokens").alias("tokens"))
