"""Queries on documents, embeddings, pages and benchmark: search, chunks, contents, index upkeep, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.chunker import chunk_rows
from spanloom.functions.text import fold_marks, literal_of, query_words, quoted_query, redact, secret_value, tokens_mixed
from spanloom.operators import index, links, search, textindex
from spanloom.operators.filters import path_filter
from spanloom.plans.tables import table
from spanloom.shared import shared_path

WORDS = [["the"], ["tion"], ["de", "la"], ["the"]]
TEXT_WORDS = [["the"], ["la"], ["und"]]


def query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def knn_topk(spark, d):
    return rounded(search.knn(table(spark, d, "embeddings"), query_vector(spark, d)), "distance")


def knn_filtered(spark, d):
    return rounded(search.knn(table(spark, d, "embeddings"), query_vector(spark, d), where=F.col("label") == 1), "distance")


def bm25_topk(spark, d):
    return rounded(search.bm25(table(spark, d, "documents"), TEXT_WORDS), "score")


def bm25_filtered_global_idf(spark, d):
    return rounded(search.bm25(table(spark, d, "documents"), TEXT_WORDS, where=F.col("lang") == "fr"), "score")


def bm25_phrase(spark, d):
    return rounded(search.bm25(table(spark, d, "documents"), WORDS), "score")


def hybrid_rrf(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    texts = table(spark, d, "documents").select("doc_id", "text")
    return rounded(search.hybrid(vectors, texts, query_vector(spark, d), TEXT_WORDS, "doc_id"), "score")


INDEXES: dict[tuple[str, str], textindex.TextIndex] = {}


def text_index(spark, d):
    """The stored index of a folder's documents, made once for each application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in INDEXES:
        INDEXES[at] = textindex.build(table(spark, d, "documents"), shared_path(spark, "textindex"), carry=["lang"])
    return INDEXES[at]


def index_bm25_topk(spark, d):
    return rounded(textindex.bm25(spark, text_index(spark, d), TEXT_WORDS), "score")


def index_bm25_filtered(spark, d):
    return rounded(textindex.bm25(spark, text_index(spark, d), TEXT_WORDS, where=F.col("lang") == "fr"), "score")


def index_bm25_phrase(spark, d):
    return rounded(textindex.bm25(spark, text_index(spark, d), [["of", "the"], *WORDS, ["of", "the", "and"]]), "score")


def index_hybrid(spark, d):
    """Vectors and the stored index, fused."""
    vectors = search.knn(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), query_vector(spark, d), key="doc_id")
    return rounded(search.fuse(vectors, textindex.bm25(spark, text_index(spark, d), TEXT_WORDS), "doc_id"), "score")


def index_replaced(spark, d):
    """The index after French texts got other words and all texts of one source went."""
    docs = table(spark, d, "documents")
    changed = docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" of the, und la")))
    made = textindex.forget(textindex.replace(text_index(spark, d), changed), docs.where("source = 'src3'"))
    return rounded(textindex.bm25(spark, made, WORDS), "score")


def path_filter_pages(spark, d):
    return table(spark, d, "pages").where(path_filter(F.col("url"), ["/en/", "/fr/"], ["utm_"])).select("page_id", "url")


def fts_postings(spark, d):
    one = search.postings(table(spark, d, "documents"))
    return one.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_times"), F.max("length").alias("longest"))


def fts_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(query_words("text")).alias("n_terms"), quoted_query("text").alias("query"))


def chunk_documents(spark, d):
    return chunk_rows(table(spark, d, "documents"), "doc_id")


def chunk_headings_lines(spark, d):
    lines = F.split("text", "\n")
    count = lambda p: F.size(F.filter(lines, p))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(lines).alias("n_lines"), count(lambda x: F.trim(x) == "").alias("n_blank"), count(lambda x: x.rlike(r"^#{1,6}\s+\S")).alias("n_headings"))


def content_hash_groups(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def snapshots(spark, d):
    """All documents twice: some renamed, some touched, some with other contents before."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("n_chars").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), F.trim("text").alias("body"))
    now = docs.select(F.when(F.col("path") % 7 == 0, -1 - F.col("path")).otherwise(F.col("path")).alias("path"), "size", F.lit(2).alias("mtime"), "hash", (F.col("body") == "").alias("blank"))
    then = docs.select(F.when(F.col("path") % 5 == 0, -10_000_000 - F.col("path")).otherwise(F.col("path")).alias("path"), "size", F.when(F.col("path") % 2 == 0, 2).otherwise(1).alias("mtime"), F.when(F.col("path") % 3 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"))
    return now, then


def snapshot_diff(spark, d):
    return index.snapshot_diff(*snapshots(spark, d)).select("path", "status")


def index_report(spark, d):
    return index.report(index.snapshot_diff(*snapshots(spark, d)))


def hashed(every):
    """The hash of a text, of another one where doc_id is no multiple of ``every``."""
    return F.sha2(F.concat("text", F.when(F.col("doc_id") % every == 0, "").otherwise(f"/{every}")), 256)


def cache_of(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(hashed(2).alias("content_hash"), F.lit(0).alias("seq"), "text", (F.col("doc_id") * 3600 % 7_000_000).cast("double").alias("last_used"))


def cache_restore(spark, d):
    return index.restored(index.snapshot_diff(*snapshots(spark, d)), cache_of(spark, d)).select("path", "restored")


def cache_gc_age(spark, d):
    return index.gc_age(cache_of(spark, d), 7_000_000).select("content_hash", "last_used")


def cache_gc_surplus(spark, d):
    return index.gc_surplus(cache_of(spark, d), 50).select("content_hash", "last_used")


def cache_gc_dead(spark, d):
    live = table(spark, d, "documents").where("text is not null").select(hashed(4).alias("hash"))
    return index.gc_dead(cache_of(spark, d), live, ratio=0.5, least=10).select("content_hash", "chunks")


def cache_gc_chain(spark, d):
    """Age, surplus and dead content one after the other."""
    live = table(spark, d, "documents").where("text is not null").select(hashed(4).alias("hash"))
    return index.collect_garbage(cache_of(spark, d), live, 7_000_000, days=60, most=600, ratio=0.5, least=10).groupBy("content_hash").agg(F.count("*").alias("chunks"))


def index_stats(spark, d):
    return index.stats(table(spark, d, "documents").select(F.col("source").alias("path")))


def index_status(spark, d):
    """Each source as an index; events are the logs of its syncs."""
    docs = table(spark, d, "documents").select(F.col("source").alias("index"), F.col("lang").alias("path"))
    disabled = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src"), "n_nationkey").alias("index"))
    holders = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("src"), "s_nationkey").alias("index"), F.col("s_suppkey").cast("long").alias("holder"))
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("first\nfailed at "), "event_id", F.lit("\n \n"))).otherwise(F.col("props"))
    logs = table(spark, d, "events").select(F.concat(F.lit("src"), F.col("user_id") % 25).alias("index"), F.col("event_id").cast("long").alias("at"), text.alias("text"))
    return index.status(docs, disabled, holders, logs)


def token_estimate_mixed(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tokens_mixed("text").alias("n_tokens"))


def redact_documents(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(redact("text"), 256).alias("redacted"))


def secret_values(spark, d):
    return table(spark, d, "documents").select("doc_id", secret_value("text").alias("secret")).where("secret is not null")


def literal_groups(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "<")).alias("line"))
    return links.literal_sides(lines, "page_id", "line")


def mention_join(spark, d):
    names = table(spark, d, "nation").select(F.lower("n_name").alias("name")).unionByName(spark.createDataFrame([("the",), ("la",), ("und",)], "name string"))
    docs = table(spark, d, "documents").select("doc_id", fold_marks("text").alias("text"))
    return links.mentions(docs, "doc_id", "text", names)


def glob_match(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1).alias("path"))
    found = links.glob_matches(pages, "path", {"english": ["en/*"], "spanish": ["es/*", "es/**"], "all": ["**"]})
    return pages.join(found.distinct(), "path").select("page_id", "domain")


def settings_diff(spark, d):
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 7).alias("v"))
    actual = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") % 7).alias("v"))
    return links.difference(wanted, actual, "k", "v")


def first_literals(spark, d):
    return table(spark, d, "pages").select("page_id", literal_of("html").alias("literal"))


def head_tail_lines(spark, d):
    from spanloom.operators.order import first_and_last

    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return first_and_last(lines, ["doc_id"], "pos", 2, 3).select("doc_id", "pos", "omitted")


NAMES = {
    "path_filter": path_filter_pages, "redact": redact_documents, "head_tail": head_tail_lines, "literals": first_literals,
}
QUERIES = {f.__name__: f for f in (knn_topk, knn_filtered, bm25_topk, bm25_filtered_global_idf, bm25_phrase, hybrid_rrf, index_bm25_topk, index_bm25_filtered, index_bm25_phrase, index_hybrid, index_replaced, fts_postings, fts_query_terms, chunk_documents, chunk_headings_lines, content_hash_groups, snapshot_diff, index_report, cache_restore, cache_gc_age, cache_gc_surplus, cache_gc_dead, cache_gc_chain, index_stats, index_status, token_estimate_mixed, secret_values, literal_groups, mention_join, glob_match, settings_diff)} | NAMES

FOLDED = "strip_accents(lower(text))"
TOKENS = rf"regexp_extract_all({FOLDED}, '[\p{{L}}\p{{N}}]+')"


def knn_sql(where: str) -> str:
    return f"""
with q as (select embedding::double[] as e from embeddings where vec_id = 0),
s as (select vec_id, list_distance(embedding::double[], e) as dist from embeddings, q where {where})
select vec_id, round(dist, 6) as distance, rank from (select *, cast(row_number() over (order by dist, vec_id) as integer) as rank from s) where rank <= 40"""


def phrase_sql(words: list[str]) -> str:
    if len(words) == 1:
        return f"len(list_filter(toks, lambda x: x = '{words[0]}'))"
    test = " and ".join(f"toks[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len(toks) + 1), lambda i: {test}))"


def bm25_sql(phrases, where: str = "true", source: str = "documents", k: int = 40) -> str:
    counts = ", ".join(f"{phrase_sql(p)} as f{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(phrases)))
    terms = " + ".join(
        f"(case when ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 then ln((n - n{i} + 0.5) / (n{i} + 0.5)) else 1e-6 end) * f{i} * 2.2::double / (f{i} + 1.2::double * (0.25::double + 0.75::double * dl / mean))" for i in range(len(phrases))
    )
    hit = " or ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""
with t as (select *, {TOKENS} as toks from {source} where text is not null),
c as (select *, len(toks) as dl, {counts} from t),
s as (select count(*) as n, avg(dl) as mean, {stats} from c),
r as (select doc_id, {terms} as sc from c, s where ({hit}) and {where})
select doc_id, round(sc, 6) as score, rank from (select *, cast(row_number() over (order by sc desc, doc_id) as integer) as rank from r) where rank <= {k}"""


NOW = "now_ as (select case when doc_id % 7 = 0 then -1 - doc_id else doc_id end as path, n_chars::bigint as size, 2 as mtime, sha256(text) as hash, trim(text) = '' as blank from documents where text is not null)"
THEN = "then_ as (select case when doc_id % 5 = 0 then -10000000 - doc_id else doc_id end as path, n_chars::bigint as size, case when doc_id % 2 = 0 then 2 else 1 end as mtime, case when doc_id % 3 = 0 then sha256(text) || 'x' else sha256(text) end as hash from documents where text is not null)"
DIFF = f"""{NOW}, {THEN},
diff as (select coalesce(a.path, b.path) as path, coalesce(a.hash, b.hash) as hash, b.path is not null as was_known,
case when a.path is null then 'removed' when b.path is not null and a.size = b.size and a.mtime = b.mtime then 'unchanged' when b.path is not null and a.hash = b.hash then 'touched'
when a.blank then 'empty' when b.path is not null then 'changed' else 'added' end as status from now_ a full join then_ b on a.path = b.path)"""
CACHE = "cache as (select sha256(case when doc_id % 2 = 0 then text else text || '/2' end) as content_hash, (doc_id * 3600 % 7000000)::double as last_used from documents where text is not null), v as (select content_hash, max(last_used) as last_used, count(*) as chunks from cache group by 1)"

SQL = {
    "knn_topk": knn_sql("true"),
    "knn_filtered": knn_sql("label = 1"),
    "bm25_topk": bm25_sql(TEXT_WORDS),
    "bm25_filtered_global_idf": bm25_sql(TEXT_WORDS, "lang = 'fr'"),
    "bm25_phrase": bm25_sql(WORDS),
    "index_bm25_topk": bm25_sql(TEXT_WORDS),
    "index_bm25_filtered": bm25_sql(TEXT_WORDS, "lang = 'fr'"),
    "index_bm25_phrase": bm25_sql([["of", "the"], *WORDS, ["of", "the", "and"]]),
    "index_replaced": bm25_sql(WORDS, source="(select doc_id, case when lang = 'fr' then text || ' of the, und la' else text end as text from documents where source <> 'src3' or source is null)"),
    "hybrid_rrf": f"""
with k as (select vec_id as doc_id, rank as v from ({knn_sql("true")})),
b as (select doc_id, rank as t from ({bm25_sql(TEXT_WORDS)})),
f as (select coalesce(k.doc_id, b.doc_id) as doc_id, coalesce(1.0::double / (60 + v), 0) + coalesce(1.0::double / (60 + t), 0) as sc, coalesce(v, 1000000 + t) as tie from k full join b on k.doc_id = b.doc_id)
select doc_id, round(sc, 6) as score, rank from (select *, cast(row_number() over (order by sc desc, tie) as integer) as rank from f) where rank <= 8""",
    "index_hybrid": f"""
with k as (select vec_id as doc_id, rank as v from ({knn_sql("true")})),
b as (select doc_id, rank as t from ({bm25_sql(TEXT_WORDS)})),
f as (select coalesce(k.doc_id, b.doc_id) as doc_id, coalesce(1.0::double / (60 + v), 0) + coalesce(1.0::double / (60 + t), 0) as sc, coalesce(v, 1000000 + t) as tie from k full join b on k.doc_id = b.doc_id)
select doc_id, round(sc, 6) as score, rank from (select *, cast(row_number() over (order by sc desc, tie) as integer) as rank from f) where rank <= 8""",
    "path_filter": "select page_id, url from pages where (instr(url, '/en/') > 0 or instr(url, '/fr/') > 0) and instr(url, 'utm_') = 0",
    "fts_postings": f"""
with t as (select doc_id, {TOKENS} as toks from documents where text is not null), w as (select doc_id, len(toks) as length, unnest(toks) as term from t),
p as (select term, doc_id, length, count(*) as tf from w group by 1, 2, 3)
select term, count(*) as n_docs, sum(tf)::bigint as n_times, max(length)::integer as longest from p group by 1""",
    "fts_query_terms": r"""
with w as (select item_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: length(x) > 1)[1:24] as ws from benchmark)
select item_id, len(ws)::integer as n_terms, array_to_string(list_transform(ws, lambda x: '"' || x || '"'), ' OR ') as query from w""",
    "chunk_headings_lines": r"""
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)
select doc_id, len(ls)::integer as n_lines, len(list_filter(ls, lambda x: trim(x) = ''))::integer as n_blank, len(list_filter(ls, lambda x: regexp_matches(x, '^#{1,6}\s+\S')))::integer as n_headings from l""",
    "content_hash_groups": "select sha256(text) as hash, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1",
    "snapshot_diff": f"with {DIFF} select path, status from diff",
    "index_report": f"""with {DIFF} select count(*) filter (status = 'added') as added, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'touched') as touched,
count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'empty') as skipped, count(*) filter (status = 'error') as error, count(*) filter (status = 'removed') as removed from diff""",
    "cache_restore": f"with {DIFF}, {CACHE} select path, diff.hash in (select content_hash from v) as restored from diff where status in ('added', 'changed')",
    "cache_gc_age": f"with {CACHE} select content_hash, last_used from v where last_used >= 7000000 - 45 * 86400",
    "cache_gc_surplus": f"with {CACHE} select content_hash, last_used from v qualify row_number() over (order by last_used desc, content_hash desc) <= 50",
    "cache_gc_dead": f"""
with {CACHE}, live as (select distinct sha256(case when doc_id % 4 = 0 then text else text || '/4' end) as h from documents where text is not null), a as (select * from v where content_hash in (select h from live)), b as (select * from v where content_hash not in (select h from live)),
l as (select greatest(10.0, coalesce((select sum(chunks) from a), 0) * 0.5) as lim, coalesce((select sum(chunks) from b), 0) as dead),
r as (select *, sum(chunks) over (order by last_used desc, content_hash rows unbounded preceding) as total from b)
select content_hash, chunks from a union all select content_hash, chunks from r, l where dead <= lim or total <= lim / 2""",
    "cache_gc_chain": f"""
with {CACHE}, live as (select distinct sha256(case when doc_id % 4 = 0 then text else text || '/4' end) as h from documents where text is not null),
y as (select * from v where last_used >= 7000000 - 60 * 86400 qualify row_number() over (order by last_used desc, content_hash desc) <= 600), a as (select * from y where content_hash in (select h from live)), b as (select * from y where content_hash not in (select h from live)),
l as (select greatest(10.0, coalesce((select sum(chunks) from a), 0) * 0.5) as lim, coalesce((select sum(chunks) from b), 0) as dead),
r as (select *, sum(chunks) over (order by last_used desc, content_hash rows unbounded preceding) as total from b)
select content_hash, chunks from a union all select content_hash, chunks from r, l where dead <= lim or total <= lim / 2""",
    "index_stats": "select count(distinct source) as files, count(*) as chunks from documents",
    "index_status": """
with c as (select source as index, count(distinct lang) as files, count(*) as chunks from documents group by 1),
h as (select 'src' || s_nationkey as index, min(s_suppkey)::bigint as holder from supplier where s_acctbal < 0 group by 1),
l as (select 'src' || user_id % 25 as index, event_id::bigint as "at", case when event_type <> 'error' then props end as report, case when event_type = 'error' then 'failed at ' || event_id end as error from events qualify row_number() over (partition by user_id % 25 order by event_id desc) = 1)
select c.index, files, chunks, case when c.index in (select 'src' || n_nationkey from nation where n_regionkey = 1) then 'disabled' else 'ok' end as autosync, holder, l.at as "at", report, error
from c left join h on h.index = c.index left join l on l.index = c.index""",
    "token_estimate_mixed": "select doc_id, floor(len(regexp_extract_all(text, '[Ѐ-ӿ]')) / 2.2::double + (length(text) - len(regexp_extract_all(text, '[Ѐ-ӿ]'))) / 4.0::double + 0.5)::bigint as n_tokens from documents where text is not null",
    "mention_join": rf"""
with n as (select lower(n_name) as name from nation union select unnest(['the', 'la', 'und'])), w as (select doc_id, unnest(regexp_extract_all({FOLDED}, '[\p{{L}}\p{{N}}_]+')) as name from documents)
select doc_id, name, count(*) as n from w where name in (select name from n) group by 1, 2""",
    "glob_match": r"""
with p as (select page_id, regexp_extract(url, '^https?://[^/]+/([^?]*)', 1) as path from pages)
select page_id, 'all' as domain from p union all select page_id, 'english' from p where regexp_full_match(path, 'en/[^/]*') union all select page_id, 'spanish' from p where regexp_full_match(path, 'es/.*')""",
    "settings_diff": """
with d as (select n_nationkey as k, n_nationkey % 7 as v from nation), a as (select s_nationkey as k, count(*) % 7 as v from supplier group by 1)
select coalesce(d.k, a.k) as k, case when a.k is null then 'missing' when d.k is null then 'extra' when d.v <> a.v then 'different' else 'same' end as state from d full join a on d.k = a.k""",
    "head_tail": """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), p as (select doc_id, len(ls) as total, unnest(range(0, len(ls))) as pos from l)
select doc_id, pos::integer as pos, greatest(total - 5, 0) as omitted from p where pos < 2 or pos >= total - 3""",
}
