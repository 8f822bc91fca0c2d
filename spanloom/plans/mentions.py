"""Queries on what texts contain: words of the benchmark in documents, paths of pages in notes about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import containment
from spanloom.plans.tables import table
from spanloom.shared import shared_path
from spanloom.sources import files

PATH = r"^https?://[^/]+/([^?#]*)"


def literal_containment(spark, d):
    """How many documents contain each word of the benchmark, as any part of their texts."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("literal"))
    found = containment.literals_of(table(spark, d, "documents"), "doc_id", "text", words)
    return found.groupBy("literal").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def page_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", PATH, 1).alias("path"))


def notes(spark, d):
    """A note for each page that names its path, its folder, a glob over it, and names that only look alike."""
    own, folder = page_paths(spark, d), F.regexp_extract("path", "^([^/]*)/", 1)
    lines = ["# Page", F.concat(F.lit("- see "), "path", F.lit(":10 and")), F.concat(F.lit("  its folder `"), folder, F.lit("`")), "", "  not of the item", F.concat(F.lit("- like `"), folder, F.lit("/"), F.substring("path", 4, 1), F.lit("*`")), "## Others", F.concat(F.lit("- not x"), "path", F.lit(" nor "), "path", F.lit("-old, but "), folder, F.lit("/ itself")), F.concat(F.lit("- `**/"), F.regexp_extract("path", "([^/]*)/?$", 1), F.lit("`"))]
    return own.select("page_id", F.array_join(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)), "\n").alias("note"))


def note_items(spark, d):
    return containment.items(notes(spark, d), "page_id", "note").select("page_id", F.col("item").cast("int").alias("item"), "heading", F.sha2("body", 256).alias("body"))


def path_mentions(spark, d):
    """How many pages' paths each item of the notes names."""
    items = containment.items(notes(spark, d), "page_id", "note").withColumn("item_id", F.concat_ws("-", "page_id", "item"))
    return containment.mention_counts(items, "item_id", "body", page_paths(spark, d))


def files_scan(spark, d):
    """Documents written as text files by language and source, listed, opened and summed by folder."""
    path = shared_path(spark, "texts")
    own = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), "text")
    own.write.partitionBy("lang", "source").text(path)
    read = files.scan(spark, path, most=1 << 31)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return read.groupBy(folder.alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.length("text")).alias("chars"), F.count_if("binary").alias("binaries"))


QUERIES = {f.__name__: f for f in (literal_containment, note_items, path_mentions, files_scan)}

NOTES = r"""p as (select page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages), q as (select *, regexp_extract(path, '^([^/]*)/', 1) as dir, regexp_extract(path, '([^/]*)/?$', 1) as last from p),
i as (
  select page_id, 1 as item, '# Page' as heading, '- see ' || path || ':10 and' || chr(10) || '  its folder `' || dir || '`' as body from q
  union all select page_id, 5, '# Page', '- like `' || dir || '/' || substring(path, 4, 1) || '*`' from q
  union all select page_id, 7, '## Others', '- not x' || path || ' nor ' || path || '-old, but ' || dir || '/ itself' from q
  union all select page_id, 8, '## Others', '- `**/' || last || '`' from q)"""

SQL = {
    "literal_containment": r"""
with w as (select distinct literal from (select unnest(string_split_regex(text, '\s+')) as literal from benchmark) where literal <> '')
select literal, count(*) as n_docs, min(doc_id) as first_doc from w join documents on contains(text, literal) group by 1""",
    "files_scan": "select 'lang=' || coalesce(lang, 'und') || '/source=' || coalesce(source, 'none') as folder, sum(strlen(text) + 1)::bigint as bytes, sum(length(text) + 1)::bigint as chars, 0::bigint as binaries from documents where text is not null group by 1",
    "note_items": f"with {NOTES} select page_id, item, heading, sha256(body) as body from i",
    "path_mentions": rf"""
with {NOTES}, paths as (select distinct path from p where path <> ''), dirs as (select path, array_to_string(ps[1:n], '/') as dir from (select path, string_split(path, '/') as ps from paths), range(1, 20) as r(n) where n < len(ps)),
names as (select path, path as name from paths union select path, dir || '/' from dirs),
globs as (select page_id, item, regexp_extract(body, '`([^`\s]*\*[^`\s]*)`', 1) as gl from i where regexp_matches(body, '`[^`\s]*\*[^`\s]*`')),
m as (
  select page_id, item, path from i join names on contains(body, name) and regexp_matches(body, '(^|[^\w./*-])' || regexp_escape(name) || '($|[^\w./*-])')
  union select page_id, item, path from i join dirs on contains(body, '`' || dir || '`')
  union select page_id, item, path from globs join paths on regexp_full_match(path, case when starts_with(gl, '**/') then '(?:.*/)?' || replace(regexp_escape(substring(gl, 4)), '\*', '[^/]*') else replace(regexp_escape(gl), '\*', '[^/]*') end))
select page_id || '-' || item as item_id, count(*) as n_paths, min(path) as first_path from m group by 1""",
}
