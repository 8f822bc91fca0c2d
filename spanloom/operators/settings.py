"""Settings texts of any depth as rows, and what one side has that the other lacks.

Rows are parsed in Arrow batches, one text at a time, and dealt out once, by key and path; both sides
meet there in one sorted join. No parsed side is broadcast: Spark takes it to be as small as its texts' column.

Cases: empty, blank and null texts are the empty object; texts that are no JSON objects give one row
of kind ``broken``. Repeated members of an array count once; other columns are not read.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The section that a program keeps itself, at the top level alone.
OWN_SECTION = "model"
ITEMS = "array<struct<path:string,kind:string,value:string>>"


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def hook_items(events: dict):
    """A hook is known by its event, its matcher, and its command with arguments, or by all of itself."""
    for event, groups in events.items():
        for group in groups if isinstance(groups, list) else []:
            group = group if isinstance(group, dict) else {}
            place = f"hooks.{event}" + (f"[{group['matcher']}]" if "matcher" in group else "")
            for hook in group["hooks"] if isinstance(group.get("hooks"), list) else []:
                command = isinstance(hook, dict) and hook.get("command")
                yield place, "member", " ".join(map(str, [command, *(hook.get("args") or [])])) if command else hook if isinstance(hook, str) else compact(hook)


def items(value, path: str = ""):
    """path, kind and value: members of arrays, scalars (``env`` for those of that section), and what holds others."""
    if path:
        yield path, "holder" if isinstance(value, (dict, list)) else "scalar", compact(value)
    if isinstance(value, dict):
        for name, inner in value.items():
            if path == "" and name == OWN_SECTION:
                continue
            if path == "" and name == "hooks" and isinstance(inner, dict):
                yield from hook_items(inner)
            elif path == "" and name == "env" and isinstance(inner, dict):
                yield from ((f"env.{k}", "scalar", compact(v)) for k, v in inner.items())
            else:
                yield from items(inner, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        if value and all(isinstance(x, dict) and isinstance(x.get("context"), str) for x in value):
            for x in value:
                yield from items(x.get("bindings"), f"{path}[{x['context']}]") if "bindings" in x else ()
        else:
            yield from ((path, "member", x if isinstance(x, str) else compact(x)) for x in value)


def parsed(text: str | None) -> list[tuple[str, str, str | None]]:
    try:
        value = json.loads(text) if text and text.strip() else {}
    except ValueError:
        value = None
    return list(items(value)) if isinstance(value, dict) else [("", "broken", None)]


def settings_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, kind (member, scalar, holder or broken) and value of each row's settings."""

    @F.pandas_udf(ITEMS)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [dict(zip(("path", "kind", "value"), x)) for x in parsed(t)])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that both sides of a difference are dealt out alike
    found = df.select(key, F.explode(run(F.col(text).cast("string"))).alias("i")).select(key, "i.*")
    return found.repartition(parts, key, "path").distinct()


def settings_difference(old: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """key, path, state and value of what the items ``old`` hold and ``own`` lack: members are missing, scalars missing or different. The values of scalars, which may be secret, are not shown."""
    theirs = own.where("kind != 'broken'").select(F.col(key).alias("_key"), F.col("path").alias("_path"), F.col("kind").alias("_kind"), F.col("value").alias("_own")).hint("merge")
    member = F.expr("kind = 'member' and _kind = 'member' and value = _own")
    scalar = F.expr("kind = 'scalar' and _kind in ('scalar', 'holder')")
    met = old.where("kind != 'holder'").join(theirs, (F.col(key) == F.col("_key")) & (F.col("path") == F.col("_path")) & (member | scalar), "left")
    lost = met.where("_own is null or kind = 'scalar' and _own != value")
    state = F.when(F.col("kind") == "broken", "broken").when(F.col("_own").isNull(), "missing").otherwise("different")
    return lost.select(key, "path", state.alias("state"), F.when(F.col("kind") == "member", F.col("value")).alias("value"))
