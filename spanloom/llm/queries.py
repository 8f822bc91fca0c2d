"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import collocations, cross_polytope, hilbert, lattice, lm, packing, prefix_free, quality, simhash, tandem, token_orc, toxicity, warc
from spanloom.llm.common import shared_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=2)
    tokens = token_orc.read_tokens(spark, path)
    return token_orc.positions(token_orc.digests(tokens), tokens)


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.digests(lattice.encode(table(spark, sf_dir, "documents"), PIECE_FILE, decoded=True))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "offsets")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1, window=2048, with_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(warc.read_records(warc.archive(table(spark, sf_dir, "pages"))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op9_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove(table(spark, sf_dir, "documents")).drop("kept")


def op10_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), BYTE_PIECES)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.summaries(table(spark, sf_dir, "documents"), least=6, ratio=4, change=tandem.planted)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, longest=3, percent=50, most=2000)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_token_orc, op3_lattice, op4_toxicity, op5_nearest, op6_packing, op7_warc, op8_simhash, op9_prefix_free, op10_attention, op11_runs, op12_collocations, op13_quality)}
SQL: dict[str, str] = {
    "op1_near_vectors": r"""
with recursive v as materialized (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
finite as materialized (select r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where len(list_filter(e, lambda x: isfinite(x))) = len(e)),
sound as materialized (select * from finite where norm > 0),
edges as materialized (select a.r as x, b.r as y, b.vec_id as y_id from sound a join sound b on a.r <> b.r and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach as (select r, vec_id as c from sound union select y, c from reach join edges on x = r where c < y_id),
least as (select r, min(c) as c from reach group by 1), links as (select x as r, count(*) as n from edges group by 1)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, vec_id = coalesce(c, vec_id) as kept from v left join least using (r) left join links using (r)""",
    "op7_warc": r"""
with p as (select page_id, coalesce(html, '') as payload, min(page_id) over (partition by coalesce(html, '')) as first from pages),
h as (select *, sha1(payload) as hex from p)
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from h""",
    "op12_collocations": r"""
with w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
totals as (select lang, sum(len(ws))::bigint as n from w group by 1),
grams as (
  select lang, 1 as size, unnest(ws) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from w),
f as (select lang, size, phrase, count(*) as a from grams group by all),
c as (select lang, size, phrase, a, string_split(phrase, ' ') as ws from f where size > 1 and a >= 10),
cuts as (select lang, size, phrase, a, ws, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as tail from c, (values (1), (2)) as v(k) where k < size),
s as (
  select cuts.*, x.a as l, y.a as r, (1000000::hugeint * cuts.a * cuts.a // (x.a::hugeint * y.a))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = head and x.size = k join f y on y.lang = cuts.lang and y.phrase = tail and y.size = cuts.size - k
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by score, k) = 1),
longer as (select lang, part, max(a) as most from (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from c where size = 3) group by 1, 2),
kept as (select s.* from s left join longer o on o.lang = s.lang and o.part = s.phrase where o.most is null or 100 * o.most < 50 * s.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join totals using (lang) qualify rank <= 2000""",
}
