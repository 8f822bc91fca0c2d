"""Verdicts on events: tables of rules, and the merge of several checks' verdicts into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITY = {"deny": 3, "ask": 2, "update": 1, "context": 0}

#: Commands by what they risk: level, category and pattern, the first that matches counts.
COMMAND_RULES = [
    ("deny", "irreversible", r"\brm\s+(-[a-zA-Z]*\s+)*-[a-zA-Z]*[rf][a-zA-Z]*\s+(/|~|\$HOME)(\s|$)"),
    ("deny", "secret", r"\b(cat|less|head|tail|grep|jq)\b[^|;&]*(\.env(?!\.(example|sample|template))\b|id_(rsa|ed25519)\b|\.pem\b|credentials\.json\b)"),
    ("deny", "pipe-to-shell", r"\b(curl|wget)\b[^|;&]*\|\s*(sudo\s+)?(ba|z|da)?sh\b"),
    ("ask", "push", r"\bgit\s+push\b"),
    ("ask", "history", r"\bgit\s+(reset\s+--hard|clean\s+-[a-z]*f|rebase|filter-branch)\b"),
    ("ask", "database", r"(?i)\b(drop|truncate)\s+(table|database|schema)\b|\bpg_dump\b|\bmysqldump\b"),
    ("ask", "publish", r"\b(npm|pnpm|yarn)\s+publish\b|\b(docker|podman)\s+push\b|\bterraform\s+(apply|destroy)\b|\bkubectl\s+(apply|delete)\b"),
    ("ask", "upload", r"\bcurl\b[^|;&]*(\s-d\b|\s--data|\s-F\b|\s-T\b|\s-X\s*(POST|PUT|PATCH|DELETE))"),
    ("ask", "environment", r"(^|[;&|]\s*)(env|printenv|set)\s*($|[;&|])"),
]


def command_verdict(command: Column) -> Column:
    """level and category of a command line; null if no rule matches."""
    tests = [F.when(command.rlike(p), F.struct(F.lit(level).alias("level"), F.lit(name).alias("category"))) for level, name, p in COMMAND_RULES]
    return F.coalesce(*tests)


def merge(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """One verdict for each event: deny before ask before update before context; reasons of that level in the order of the checks."""
    rank = reduce(lambda c, kv: c.when(F.col("level") == kv[0], kv[1]), PRIORITY.items(), F).otherwise(-1)
    ranked = verdicts.withColumn("_rank", rank)
    top = ranked.groupBy(*by).agg(F.max("_rank").alias("_top"), F.collect_list(F.struct("ord", "_rank", "level", "reason")).alias("all"))
    own = F.filter(F.array_sort("all"), lambda x: x["_rank"] == F.col("_top"))
    return top.select(*by, F.get(own, F.lit(0))["level"].alias("level"), F.array_join(F.transform(own, lambda x: x["reason"]), "; ").alias("reasons"))


def tool_group(tool: Column, command: Column, groups: dict[str, list[str]]) -> Column:
    """The group of a tool by name; a shell command that searches counts as grep."""
    search = command.rlike(r"(^|[\s|;&(])(grep|rg|ag|find)(\s|$)")
    named = [F.when(tool.isin(names), F.lit(g)) for g, names in groups.items()]
    return F.coalesce(F.when((tool == "Bash") & search, "grep").when(tool == "Bash", "bash"), *named)
