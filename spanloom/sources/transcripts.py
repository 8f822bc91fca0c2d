"""Session logs: JSON lines, one file for each session, one folder for each project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import trim_space

USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,"
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>"
)
FIELDS = {
    "type": "string", "timestamp": "string", "uuid": "string", "cwd": "string", "slug": "string", "planContent": "string", "isSidechain": "boolean", "isMeta": "boolean", "toolDenialKind": "string", "sourceToolUseID": "string",
}


def lines(spark: SparkSession, path: str, least_bytes: int = 0) -> DataFrame:
    """session, project, pos and line of ``path``/project/session.jsonl, of files of ``least_bytes`` or more."""
    read = spark.read.text(f"{path}/*/*.jsonl").select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start")
    kept = read.where(F.col("file_size") >= least_bytes)
    place = F.struct("file_block_start", F.monotonically_increasing_id())
    parts = F.split("file_path", "/")
    return kept.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("session"),
        F.coalesce(F.nullif(F.element_at(parts, -2), F.lit("")), F.lit("~")).alias("project"),
        place["col2"].alias("pos"),
        F.col("value").alias("line"),
    )


def records(lines: DataFrame) -> DataFrame:
    """Parsed records with session, project and pos; lines that are no JSON objects are left out. Content stays a variant."""
    parsed = lines.withColumn("v", F.try_parse_json("line")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    get = lambda p, t: F.try_variant_get("v", f"$.{p}", t)
    usage = F.from_json(F.to_json(get("message.usage", "variant")), USAGE)
    return parsed.select(
        *(c for c in lines.columns if c != "line"),
        *(get(n, t).alias(n) for n, t in FIELDS.items()),
        get("message.id", "string").alias("message_id"),
        get("message.model", "string").alias("model"),
        usage.alias("usage"),
        get("message.content", "variant").alias("content"),
        get("attachment", "variant").alias("attachment"),
    )


def blocks(records: DataFrame) -> DataFrame:
    """Blocks of records whose content is an array, with their place: kind, id, name, input (JSON), answers, is_error, chars."""
    own = records.where("schema_of_variant(content) like 'ARRAY%'")
    exploded = own.select("*", F.expr("posexplode(cast(content as array<variant>))").alias("block_no", "b"))
    get = lambda p, t: F.try_variant_get("b", f"$.{p}", t)
    return exploded.select(
        *(c for c in records.columns if c != "content"),
        "block_no",
        get("type", "string").alias("kind"),
        get("id", "string").alias("use_id"),
        get("name", "string").alias("tool"),
        F.to_json(get("input", "variant")).alias("input"),
        get("tool_use_id", "string").alias("answers"),
        F.coalesce(get("is_error", "boolean"), F.lit(False)).alias("is_error"),
        content_chars(get("content", "variant")).alias("chars"),
        get("text", "string").alias("text"),
    )


def content_chars(content: Column) -> Column:
    """Length of a text, or of all texts of an array of blocks; 0 for anything else."""
    text = F.try_variant_get(content, "$", "string")
    parts = F.try_variant_get(content, "$", "array<variant>")
    total = F.aggregate(parts, F.lit(0), lambda s, b: s + F.coalesce(F.length(F.try_variant_get(b, "$.text", "string")), F.lit(0)))
    kind = F.schema_of_variant(content)
    return F.when(content.isNull(), 0).when(kind.startswith("ARRAY"), total).when(kind == "STRING", F.length(text)).otherwise(0).cast("long")


def upsert(ledger: DataFrame, rows: DataFrame, key: str = "session") -> DataFrame:
    """The ledger with ``rows`` in place of those of the same key."""
    return ledger.where(F.col(key).isNotNull()).join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def prompts(lines: DataFrame) -> DataFrame:
    """session, pos, text, human and typed of each record of the user's side that is no marginal note.

    ``text``: a text itself, or the text blocks of an array, one to a line. ``human``: the record names a
    human as its origin. ``typed``: all blocks are texts, and they are neither empty, nor an
    interruption, nor an insertion that begins with ``<``.
    """
    parsed = lines.withColumn("v", F.try_parse_json("line")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    get = lambda p, t: F.try_variant_get("v", f"$.{p}", t)
    own = parsed.where((get("type", "string") == "user") & ~F.coalesce(get("isMeta", "boolean"), F.lit(False)))
    own = own.withColumns({"content": get("message.content", "variant"), "human": F.coalesce(get("origin.kind", "string") == "human", F.lit(False))})
    plain = F.schema_of_variant("content") == "STRING"
    parts = F.when(F.schema_of_variant("content").startswith("ARRAY"), F.try_variant_get("content", "$", "array<variant>"))
    of = lambda b, name: F.coalesce(F.try_variant_get(b, f"$.{name}", "string"), F.lit(""))
    texts = F.transform(F.filter(parts, lambda b: of(b, "type") == "text"), lambda b: of(b, "text"))
    said = F.when(plain, F.try_variant_get("content", "$", "string"))
    whole = trim_space(F.coalesce(said, F.when(F.forall(parts, lambda b: of(b, "type") == "text"), F.array_join(texts, "")), F.lit("")))
    typed = (whole != "") & ~whole.startswith("[Request interrupted") & ~whole.startswith("<")
    return own.select("session", "pos", F.coalesce(said, F.array_join(texts, "\n"), F.lit("")).alias("text"), "human", typed.alias("typed"))


def last_prompts(lines: DataFrame) -> DataFrame:
    """session and text of each session's last prompt of a human; the empty text without one."""
    told = prompts(lines).where("human").groupBy("session").agg(F.max(F.struct("pos", "text"))["text"].alias("text"))
    return lines.select("session").distinct().join(told, "session", "left").select("session", F.coalesce("text", F.lit("")).alias("text"))
