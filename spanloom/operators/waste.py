"""What needless calls of a session cost, by class, and how its calls are shared among tools.

A transcript becomes one stream of items in order: calls of the model, uses of tools, their
results, prompts, notes of the host and texts that hooks put in. Two clocks run over it: the number
of the call at which a tool was used (what its text costs counts from there), and the segment
in which its result arrives (what the model still holds; a call whose window is less than half
of the one before begins a new one). All state is a window over the stream: of a session, of a
segment, of a path or name within it.

Cases: broken lines are gone before (``transcripts.records``). Records of side chains do not
count, nor do synthetic answers. A result without a use is of the tool ``unknown`` at the call
before it. Charges need a later call; without one an event counts with no tokens. Models
without a price cost nothing. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.money import cost, priced, waste_writes
from spanloom.functions.text import utf16_length
from spanloom.operators.usage import SYNTHETIC
from spanloom.shared import written


@dataclass(frozen=True)
class Rules:
    """Names of tools, texts of hooks, and sizes in tokens."""

    read: str = "Read"
    code_read: str = "mcp__code__read"
    code_search: str = "mcp__code__search"
    code_context: str = "mcp__code__context"
    doc_search: str = "mcp__docs__search"
    edits: tuple[str, ...] = ("Edit", "Write", "NotebookEdit", "mcp__code__edit")
    schemas: str = "ToolSearch"
    skill: str = "Skill"
    hand_over: str = "handoff"
    code_prefix: str = "mcp__code__"
    no_group: str = r"__(session_start|session_end|record_)"
    meter: str = r"^context: \d+k"
    links: str = r"^links of "
    stop: str = "Stop hook feedback:"
    big_shell: int = 5000
    full_read: int = 2000
    wide_search: int = 2000
    hand_over_at: int = 150_000


CHARS_PER_TOKEN = 4
CLASSES = ("deny", "error", "stop", "reread", "fullread", "bigbash", "toolsearch", "skill", "meter", "links", "handoff")
GROUPS = ("code", "docs", "read", "grep", "bash", "edit")

#: What counts as a search in a shell command, a search of files, code, documents, an empty search.
SEARCH = r"(^|[\s|;&(])(grep|rg|ag|find)(\s|$)"
FILE_SEARCH = r"(^|[;&(]|\|\|)\s*(\w+=\S*\s+)*(git\s+grep|grep|rg|ag|find)(\s|$)"
CODE_FILE = r"\.(m?[jt]sx?|c[jt]s|py|rs|go|java|kt|rb|php|cs|swift|c|cc|cpp|h|hpp|sh)$"
DOC_FILE = r"\.(mdx?|json|ya?ml|toml|ini|env|sql|txt|conf)\b|Dockerfile|docker-compose|\.gitlab-ci|\.github/"
EMPTY_SEARCH = r"(^|\n)count: 0\n"

ITEM = {
    "sub": "int", "item": "string", "id": "string", "call": "string", "tool": "string", "input": "string", "path": "string", "tok": "long", "error": "boolean", "denied": "boolean", "rejected": "boolean",
    "empty": "boolean", "note": "string", "win": "long", "out": "long", "usd": "double", "model": "string", "hour": "boolean", "read_rate": "double", "write_rate": "double",
}
PLACE = ["pos", "sub"]


def _item(**given: Column) -> Column:
    return F.struct(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in ITEM.items()))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def plain(v: Column) -> Column:
    """A text, or the texts of an array's strings and blocks, one behind the other."""
    part = lambda b: F.coalesce(F.when(_is(b, "STRING"), _get(b, "")).otherwise(_get(b, "text")), F.lit(""))
    return F.when(_is(v, "STRING"), _get(v, "")).when(_is(v, "ARRAY"), F.array_join(F.transform(_get(v, "", "array<variant>"), part), "")).otherwise("")


def tokens(text: Column) -> Column:
    return F.floor(utf16_length(text) / CHARS_PER_TOKEN + F.lit(0.5)).cast("long")


def field(name: str, of: str = "input") -> Column:
    return F.get_json_object(F.col(of), f"$.{name}")


def filled(c: Column) -> Column:
    """Whether a value of JSON, as text, is neither absent nor empty."""
    return F.coalesce(~c.isin("", "[]", "false", "0", "null"), F.lit(False))


def session_window(*by: str):
    return Window.partitionBy("session", *by).orderBy(*PLACE)


def items(records: DataFrame, prices: DataFrame, rules: Rules = Rules(), parts: int | None = None) -> DataFrame:
    """The stream: session, pos, sub and the columns of ITEM, with at (number of the last call, -1 before the first) and seg; written to the shared folder.

    ``records``: of ``transcripts.records``, with cwd. ``tool``, ``input`` and ``path`` of a
    result or of a skill's text are those of the use it answers, and so is its at. ``parts``: into how
    many tasks the sessions are dealt, here and by all that read the stream; a number that grows
    with the records keeps a task's memory, where Spark goes by the size of what it has packed.
    """
    dealt = lambda df: df if parts is None else df.repartition(parts, "session")
    records = dealt(records)
    own = priced(records.where(~F.coalesce("isSidechain", F.lit(False))), prices)
    own = own.withColumn("_cwd", F.last("cwd", ignorenulls=True).over(Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumns({"_call": F.coalesce("message_id", "uuid"), "_real": (F.col("type") == "assistant") & _is(F.col("content"), "ARRAY") & ~F.coalesce(F.col("model") == SYNTHETIC, F.lit(False))})
    billed = F.coalesce(F.col("_real") & F.col("usage").isNotNull(), F.lit(False))
    own = own.withColumn("_billed", billed).withColumn("_first", F.row_number().over(Window.partitionBy("session", "_call", "_billed").orderBy("pos")) == 1)

    n = lambda c: F.coalesce(F.col(f"usage.{c}"), F.lit(0))
    short, hour = waste_writes(F.col("usage"))
    call = _item(
        sub=F.lit(-1), item=F.lit("call"), call=F.col("_call"), win=n("input_tokens") + n("cache_read_input_tokens") + n("cache_creation_input_tokens"), out=n("output_tokens"),
        usd=cost(F.col("usage.input_tokens"), F.col("usage.output_tokens"), F.col("usage.cache_read_input_tokens"), short, hour), model=F.col("model"), hour=hour > 0,
        read_rate=F.col("price.cache_read"), write_rate=F.when(hour > 0, F.col("price.cache_write_1h")).otherwise(F.col("price.cache_write_5m")),
    )
    found = F.filter(F.transform(_get(F.col("content"), "", "array<variant>"), lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: _get(x["b"], "type").isin("tool_use", "tool_result"))

    def use(x: Column) -> Column:
        b = x["b"]
        long = F.coalesce(_get(b, "input.file_path"), _get(b, "input.notebook_path"), _get(b, "input.file"), _get(b, "input.path"))
        under = F.coalesce(F.startswith(long, F.concat("_cwd", F.lit("/"))), F.lit(False))
        path = F.when(under, F.substring(long, F.length("_cwd") + 2, F.length(long))).otherwise(long)
        return _item(sub=x["i"], item=F.lit("use"), id=_get(b, "id"), call=F.col("_call"), tool=_get(b, "name"), input=F.to_json(_get(b, "input", "variant")), path=path)

    def result(x: Column) -> Column:
        b = x["b"]
        content, error = _get(b, "content", "variant"), F.coalesce(_get(b, "is_error", "boolean"), F.lit(False))
        raw = F.when(_is(content, "STRING"), _get(content, "")).otherwise(F.to_json(content))
        denied = error & (F.coalesce(F.col("toolDenialKind") == "permission-rule", F.lit(False)) | F.coalesce(raw.contains("hook error"), F.lit(False)))
        text = plain(content)
        return _item(sub=x["i"], item=F.lit("result"), id=_get(b, "tool_use_id"), tok=tokens(text), error=error, denied=denied, rejected=F.col("toolDenialKind").isNotNull(), empty=text.rlike(EMPTY_SEARCH))

    of_kind = lambda k: F.filter(found, lambda x: _get(x["b"], "type") == k)
    said, added = plain(F.col("content")), plain(F.try_variant_get("attachment", "$.content", "variant"))
    is_prompt = ~_is(F.col("content"), "ARRAY") | (F.size(of_kind("tool_result")) == 0)
    note = F.when(said.startswith(rules.stop), "stop")
    hook = F.when(added.rlike(rules.meter), "meter").when(added.rlike(rules.links), "links")
    is_hook = (F.col("type") == "attachment") & (F.try_variant_get("attachment", "$.type", "string") == "hook_additional_context")
    meta, user = F.coalesce("isMeta", F.lit(False)), F.col("type") == "user"
    each = (
        F.when(F.col("_real"), F.concat(F.filter(F.array(call), lambda _: F.col("_billed") & F.col("_first")), F.transform(of_kind("tool_use"), use)))
        .when(user & meta, F.array(_item(sub=F.lit(0), item=F.lit("meta"), id=F.col("sourceToolUseID"), tok=tokens(said), note=note)))
        .when(user & is_prompt, F.array(_item(sub=F.lit(0), item=F.lit("prompt"))))
        .when(user, F.transform(of_kind("tool_result"), result))
        .when(is_hook, F.array(_item(sub=F.lit(0), item=F.lit("hook"), tok=tokens(added), note=hook)))
    )
    stream = own.select("session", "pos", F.explode(each).alias("i")).select("session", "pos", "i.*")
    past = session_window().rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("win", ignorenulls=True).over(session_window().rowsBetween(Window.unboundedPreceding, -1))
    stream = stream.withColumns({"at": F.sum((F.col("item") == "call").cast("int")).over(past) - 1, "_fell": F.coalesce((F.col("win") < before / 2).cast("int"), F.lit(0))})
    stream = stream.withColumn("seg", F.sum("_fell").over(past)).drop("_fell")
    answered = F.last(F.when(F.col("item") == "use", F.struct("tool", "input", "path", "at")), ignorenulls=True).over(session_window("id").rowsBetween(Window.unboundedPreceding, -1))
    replies = F.col("item").isin("result", "meta") & F.col("id").isNotNull()
    stream = stream.withColumn("_of", F.when(replies, answered))
    unknown = F.when(F.col("item") == "result", "unknown")
    at = F.when(F.col("item") == "result", F.coalesce("_of.at", "at")).otherwise(F.col("at"))
    return dealt(written(stream.withColumns({"tool": F.coalesce("tool", "_of.tool", unknown), "input": F.coalesce("input", "_of.input"), "path": F.coalesce("path", "_of.path"), "at": at}).drop("_of"), "items"))


def calls(stream: DataFrame) -> DataFrame:
    """session, i (from 0), seg, win, usd, rates, hour, and left: calls to the end of the segment, this one too."""
    own = stream.where("item = 'call'").withColumnRenamed("at", "i")
    return own.withColumn("left", F.count("*").over(Window.partitionBy("session", "seg").orderBy("i").rowsBetween(0, Window.unboundedFollowing))).select("session", "i", "seg", "win", "usd", "read_rate", "write_rate", "left")


def _events(rows: DataFrame, cls: str | Column, kind: str, tok: Column | None = None) -> DataFrame:
    name = F.lit(cls) if isinstance(cls, str) else cls
    return rows.select("session", *PLACE, "at", name.alias("cls"), F.lit(kind).alias("kind"), (F.lit(None) if tok is None else tok).cast("long").alias("tok"))


def reads(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Results of reads: again (the same stretch of the path, in the segment, without an edit between), whole (much code at once) and later (edits of the path to the segment's end)."""
    edit = (F.col("item") == "use") & F.col("tool").isin(*rules.edits)
    read = (F.col("item") == "result") & ~F.col("error") & F.col("tool").isin(rules.read, rules.code_read) & ~filled(field("if_digest"))
    own = stream.where(F.col("path").isNotNull() & (F.col("path") != "") & (edit | read)).withColumn("_edit", edit.cast("int"))
    on_path = session_window("seg", "path")
    own = own.withColumns({"_epoch": F.sum("_edit").over(on_path.rowsBetween(Window.unboundedPreceding, 0)), "later": F.coalesce(F.sum("_edit").over(on_path.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))}).where("_edit = 0")
    mode = F.coalesce(field("mode"), F.lit("full"))
    own = own.withColumns({"_mode": mode, "_stretch": F.to_json(F.array(*(field(k) for k in ("offset", "limit", "lines", "graph_root"))))})
    nth = F.row_number().over(Window.partitionBy("session", "seg", "path", "_epoch", "tool", "_mode", "_stretch").orderBy(*PLACE))
    whole = (F.col("tool") == rules.code_read) & F.col("_mode").isin("full", "map") & F.col("path").rlike(CODE_FILE) & (F.col("tok") > rules.full_read)
    return own.withColumn("again", nth > 1).withColumn("whole", ~F.col("again") & whole).drop("_edit", "_epoch", "_mode", "_stretch")


def _again(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose ``name`` was there before in their segment."""
    return rows.withColumn("_nth", F.row_number().over(session_window("seg", name))).where("_nth > 1").drop("_nth")


def waste_events(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """session, place, at, cls, kind (next: the call after is for nothing; carry: tokens that later calls carry; self; count) and tok."""
    result = (F.col("item") == "result") & ~F.col("error")
    failed = (F.col("item") == "result") & F.col("error")
    read = reads(stream, rules)
    query = F.coalesce(field("query"), F.lit(""))
    listed = F.filter(F.transform(F.split(F.substring(query, 8, 1 << 20), ","), F.trim), lambda x: x != "")
    names = F.array_distinct(F.when(query.startswith("select:"), listed).otherwise(F.array(F.concat(F.lit("?"), query))))
    loaded = stream.where(result & (F.col("tool") == rules.schemas)).withColumn("_name", F.explode(names))
    given = stream.where((F.col("item") == "meta") & (F.col("tool") == rules.skill)).withColumn("_name", field("skill"))
    is_over = (F.col("item") == "use") & (F.col("tool") == rules.skill) & (field("skill") == rules.hand_over)
    handed = F.coalesce(F.max(is_over).over(session_window("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    large = stream.where((F.col("item") == "call") | is_over).withColumn("_handed", handed).where((F.col("item") == "call") & ~F.col("_handed") & (F.col("win") > rules.hand_over_at))
    parts = [
        _events(stream.where(failed & F.col("denied")), "deny", "next"),
        _events(stream.where(failed & ~F.col("denied") & ~F.col("rejected") & (F.col("tool") != "Bash")), "error", "next"),
        _events(stream.where("item = 'meta' and note = 'stop'"), "stop", "next"),
        _events(read.where("again"), "reread", "carry", F.col("tok")),
        _events(read.where("whole and later = 0"), "fullread", "carry", F.col("tok")),
        _events(stream.where(result & (F.col("tool") == "Bash") & (F.col("tok") > rules.big_shell)), "bigbash", "carry", F.col("tok") - rules.big_shell),
        _events(_again(loaded, "_name").dropDuplicates(["session", *PLACE]), "toolsearch", "count"),
        _events(_again(given, "_name"), "skill", "carry", F.col("tok")),
        _events(stream.where("item = 'hook' and note is not null"), F.col("note"), "carry", F.col("tok")),
        _events(large, "handoff", "self", F.col("win") - rules.hand_over_at),
    ]
    return reduce(DataFrame.unionByName, parts)


def charged(events: DataFrame, of: DataFrame) -> DataFrame:
    """session, cls, n, tok, usd: what the events cost by the calls after them."""
    own = of.select("session", F.col("i").alias("_i"), F.col("read_rate").alias("_self"))
    then = of.select("session", (F.col("i") - 1).alias("at"), F.col("win").alias("_win"), F.col("usd").alias("_usd"), "left", "read_rate", "write_rate")
    met = events.join(then, ["session", "at"], "left").join(own.withColumnRenamed("_i", "at"), ["session", "at"], "left")
    first = F.row_number().over(Window.partitionBy("session", "at", "kind").orderBy(*PLACE)) == 1
    met = met.withColumn("_first", first)
    pays, zero = (F.col("kind") == "next") & F.col("_first"), F.lit(0)
    tok = F.when(F.col("kind") == "self", F.col("tok")).when(pays, F.col("_win")).when(F.col("kind") == "carry", F.col("tok") * F.col("left"))
    carried = F.col("tok") * (F.col("write_rate") + (F.col("left") - 1) * F.col("read_rate")) / 1e6
    usd = F.when(F.col("kind") == "self", F.col("tok") * F.col("_self") / 1e6).when(pays, F.col("_usd")).when(F.col("kind") == "carry", carried)
    return met.groupBy("session", "cls").agg(F.count("*").alias("n"), F.sum(F.coalesce(tok, zero)).alias("tok"), F.sum(F.coalesce(usd, F.lit(0.0))).alias("usd"))


def waste(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return charged(waste_events(stream, rules), calls(stream))


def repeats(stream: DataFrame) -> DataFrame:
    """session and n: uses that follow a denied one at once and equal it."""
    own = stream.where("item = 'use' or denied").withColumn("_last", F.lag(F.struct("item", "tool", "input")).over(session_window()))
    same = (F.col("_last.item") == "result") & F.col("_last.tool").eqNullSafe(F.col("tool")) & F.col("_last.input").eqNullSafe(F.col("input"))
    return own.where(same & (F.col("item") == "use")).groupBy("session").agg(F.count("*").alias("n"))


def missing(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """session, what, n, tok: reads without a digest, wide searches, whole contexts, searches of files after an empty search, exact words asked of documents."""
    result, use = (F.col("item") == "result") & ~F.col("error"), F.col("item") == "use"
    no_paths = ~filled(field("path_include"))
    mark = F.when(result & (F.col("tool") == rules.code_search), F.struct(F.col("empty").alias("open"), filled(field("literal")).alias("literal"), *PLACE))
    mark = mark.when(use & (F.col("tool") == rules.doc_search), F.struct(F.lit(False).alias("open"), F.lit(False).alias("literal"), *PLACE))
    gap = F.last(mark, ignorenulls=True).over(session_window("seg").rowsBetween(Window.unboundedPreceding, -1))
    command = F.coalesce(field("command"), F.lit(""))
    greps = F.col("tool").isin("Grep", "Glob") | ((F.col("tool") == "Bash") & command.rlike(SEARCH) & command.rlike(FILE_SEARCH) & ~command.rlike(r"\s/tmp/"))
    skipped = use & greps & F.col("_gap.open") & (~F.col("_gap.literal") | F.col("input").rlike(DOC_FILE))
    gaps = stream.withColumn("_gap", gap).withColumn("_skipped", F.coalesce(skipped, F.lit(False)))
    gaps = gaps.where("id is not null or _skipped").withColumn("_of", F.last(F.when(use, F.col("_skipped")), ignorenulls=True).over(session_window("id").rowsBetween(Window.unboundedPreceding, -1)))
    query = F.coalesce(field("query"), F.lit(""))
    exact = ~query.rlike(r"\s") & query.rlike("_|[a-z][A-Z]")
    many, total = F.count("*").alias("n"), F.sum("tok").alias("tok")
    per = lambda rows, what, *agg: rows.groupBy("session").agg(*agg).withColumn("what", F.lit(what)).select("session", "what", "n", "tok")
    none = F.lit(0).cast("long").alias("tok")
    chains = gaps.where("_skipped").groupBy("session").agg(F.countDistinct("_gap").alias("n")).join(gaps.where("item = 'result' and _of").groupBy("session").agg(total), "session", "left")
    return reduce(
        DataFrame.unionByName,
        [
            per(reads(stream, rules).where(F.col("again") & (F.col("tool") == rules.code_read)), "digest", many, total),
            per(stream.where(result & (F.col("tool") == rules.code_search) & no_paths & (F.col("tok") > rules.wide_search)), "wide", many, total),
            per(stream.where(use & (F.col("tool") == rules.code_context)), "context", many, none),
            per(stream.where(use & (F.col("tool") == rules.doc_search) & exact & no_paths), "exact", many, none),
            chains.select("session", F.lit("documents").alias("what"), "n", F.coalesce("tok", F.lit(0)).alias("tok")),
        ],
    )


def tool_group(rules: Rules = Rules()) -> Column:
    tool, command = F.col("tool"), F.coalesce(field("command"), F.lit(""))
    return (
        F.when(tool.startswith(rules.code_prefix), F.when(~tool.rlike(rules.no_group), "code")).when(tool == rules.doc_search, "docs").when(tool == rules.read, "read").when(tool.isin("Grep", "Glob"), "grep")
        .when(tool.isin("Edit", "Write"), "edit").when(tool == "Bash", F.when(command.rlike(SEARCH), "grep").otherwise("bash"))
    )


def session_shares(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each session with a call: model, turns, asks (prompts that got an answer), tooled and multi (answers with a tool, with several), deny, ctx, out, and uses of each group."""
    own = stream.where("item in ('call', 'prompt')").withColumn("_before", F.lag("item").over(session_window()))
    asked = own.where("item = 'call'").groupBy("session").agg(
        F.max_by("model", F.struct(*PLACE)).alias("model"), F.count("*").alias("turns"), F.count_if(F.coalesce(F.col("_before") == "prompt", F.lit(True))).alias("asks"), F.sum("win").alias("ctx"), F.sum("out").alias("out")
    )
    used = stream.where("item = 'use'").groupBy("session", "call").agg(F.count("*").alias("_n"), *(F.count_if(tool_group(rules) == g).alias(g) for g in GROUPS))
    used = used.groupBy("session").agg(F.count("*").alias("tooled"), F.count_if(F.col("_n") > 1).alias("multi"), *(F.sum(g).alias(g) for g in GROUPS))
    denied = stream.where("denied").groupBy("session").agg(F.count("*").alias("deny"))
    whole = asked.join(used, "session", "left").join(denied, "session", "left")
    return whole.select("session", "model", "turns", "asks", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tooled", "multi", "deny")), "ctx", "out", *(F.coalesce(g, F.lit(0)).alias(g) for g in GROUPS))
