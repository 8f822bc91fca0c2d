"""Queries on conversations, events, pages and documents: parts of transcripts, reports, pruning, what is missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import literal_of
from spanloom.operators import index, links, reports
from spanloom.plans import retrieval
from spanloom.plans.sessions import EVENTS, TURNS, turns
from spanloom.plans.tables import events, table

ORDER, NOW, FOLDERS = ["turn", "role", "text"], 1_704_100_000, {"click": 0, "view": 1, "error": 2}


def tail_scan(spark, d):
    return reports.tail(turns(spark, d), ["conv_id"], ORDER, F.octet_length("text") + 1, 600).select("conv_id", "turn")


def head_scan(spark, d):
    first = reports.head(turns(spark, d), ["conv_id"], ORDER, F.octet_length("text") + 1, 400).where("role = 'user'")
    return first.groupBy("conv_id").agg(F.min_by(F.md5("text"), F.struct(*ORDER)).alias("first"))


def log_tail(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return reports.log_tail(lines, ["doc_id"], F.col("pos"), F.octet_length("line") + 1, 3000, 4).select("doc_id", "pos")


def latest_usage(spark, d):
    return reports.latest_usage(turns(spark, d), "conv_id", F.struct(*ORDER), F.col("role") == "assistant", F.col("tokens"), 500)


def unanswered_exit(spark, d):
    place = F.struct("ts", "event_id")
    found = reports.unanswered(events(spark, d), "user_id", place, F.col("event_type") == "error", F.col("event_type") == "click")
    return found.select("user_id", F.col("place.event_id").alias("event_id"))


def last_turn(spark, d):
    own = reports.last_turn(turns(spark, d), "conv_id", "turn", F.col("role") == "user")
    return own.groupBy("conv_id").agg(F.max("_prompt").alias("prompt"), F.count_if(F.col("role") != "user").alias("steps"), F.max_by(F.md5("text"), F.struct(*ORDER)).alias("last"))


def ledger(spark, d):
    own = events(spark, d).groupBy(F.col("user_id").alias("session"))
    return own.agg(F.max("ts").alias("ended"), F.count("*").alias("calls")).withColumn("project", F.concat(F.lit("/home/p"), F.col("session") % 12))


def ledger_period(spark, d):
    newest = events(spark, d).agg(F.max("ts").alias("now"))
    one = ledger(spark, d).join(F.broadcast(newest.select(reports.period_start(F.col("now"), 1).alias("since"))))
    return reports.in_period(one, F.col("since"), "/p1").select("session", "project", "calls")


def ledger_today(spark, d):
    newest = events(spark, d).agg(F.max("ts").alias("now"))
    one = ledger(spark, d).join(F.broadcast(newest.select(reports.period_start(F.col("now"), 1, today=True).alias("since"))))
    return reports.in_period(one, F.col("since")).select("session", "calls")


def multi_calls(spark, d):
    own = events(spark, d).withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    return reports.multi_calls(own, ["user_id", "hour"], "user_id", F.col("event_type").isin("click", "purchase"))


def lost(spark, d):
    own = events(spark, d).groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("class"))
    return own.agg(F.sum(F.floor("value").cast("long")).alias("tok"), F.sum((F.floor("value") * (F.col("target") % 3)).cast("long")).alias("usd"))


def waste_argmax(spark, d):
    return reports.worst_of_class(lost(spark, d))


def waste_top_class(spark, d):
    return reports.top_class(lost(spark, d))


def worst_sessions(spark, d):
    return reports.worst_sessions(lost(spark, d))


def missing_calls(spark, d):
    return reports.missing_calls(events(spark, d), "user_id", {"errors": F.col("event_type") == "error", "dear": F.col("value") > 200, "odd": F.col("target") == 13})


def commit_allowed(spark, d):
    is_ = lambda t: F.col("event_type") == t
    return reports.commit_allowed(events(spark, d), "user_id", F.struct("ts", "event_id"), is_("view"), is_("purchase"), is_("signup"))


def missing_skills(spark, d):
    own = events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("loaded"))
    required = F.array(F.lit("click"), F.lit("signup"), F.lit("review"), F.lit("error"))
    return own.select("user_id", F.array_join(reports.not_loaded(required, F.col("loaded")), ",").alias("missing"))


def implied_grants(spark, d):
    own = events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    return own.select("user_id", F.array_join(reports.with_implied(F.col("own"), {"purchase": "view", "signup": "push"}), ",").alias("grants"))


def union_by_key(spark, d):
    own = events(spark, d)
    parts = [own.where(F.col("event_type") == t).select("user_id", "target", "event_id", "event_type") for t in ("error", "view", "click")]
    return reports.union_by_key(parts, ["user_id", "target"])


def rare_literals(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.concat(F.lit("'"), F.regexp_extract("url", r"^https?://([^/.]*)", 1), F.lit("'")).alias("line"))
    return reports.rarest(links.literal_sides(lines, "page_id", "line").select("literal", "sides"))


def files(spark, d):
    return events(spark, d).select(F.col("event_type").alias("folder"), F.concat_ws("/", "event_type", "target").alias("path"), F.unix_seconds("ts").alias("mtime"), F.floor("value").cast("long").alias("size"), "event_id")


def prune_report(spark, d):
    return reports.prune_report(files(spark, d), FOLDERS, F.lit(NOW) + 2 * reports.DAY, ["click/1", "view/2"])


def pruned_files(spark, d):
    return reports.pruned(files(spark, d), FOLDERS, F.lit(NOW) + 2 * reports.DAY, ["click/1", "view/2"]).select("event_id")


def first_seen(spark, d):
    return reports.first_seen(files(spark, d), "path", "mtime")


def last_of_folder(spark, d):
    return reports.last_of_folder(table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^?]*)", 1).alias("path")))


def oversized(spark, d):
    prompt, plan = reports.oversized(F.col("text"), 2500, F.col("text"), 1500, r"[A-Z]un? ", r"(?im)^la [^\n]* un ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", prompt.alias("prompt"), plan.alias("plan"))


def names_word(spark, d):
    return turns(spark, d).where(reports.names_word(F.col("text"), "La")).select("conv_id", "turn", "role")


def index_gaps(spark, d):
    listed, present = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return reports.both_ways(listed, present, "id")


def report_merge(spark, d):
    now, then = retrieval.snapshots(spark, d)
    one = index.report(index.snapshot_diff(now, then))
    return reports.merged_reports(one.unionByName(one))


def fused_rows(spark, d):
    return retrieval.hybrid_rrf(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


def main_and_sub(spark, d):
    own = events(spark, d)
    main, sub = own.where("event_type != 'error'").select("user_id"), own.where("event_type = 'error'").select("user_id", (F.col("target") % 5).cast("long").alias("agent"))
    return reports.main_and_sub(main, sub, "user_id")


QUERIES = {f.__name__: f for f in (tail_scan, head_scan, log_tail, latest_usage, unanswered_exit, last_turn, ledger_period, ledger_today, multi_calls, waste_argmax, waste_top_class, worst_sessions, missing_calls, commit_allowed, missing_skills, implied_grants, union_by_key, rare_literals, prune_report, pruned_files, first_seen, last_of_folder, oversized, names_word, index_gaps, report_merge, fused_rows, main_and_sub)}

T = "(partition by conv_id order by turn, role, text"
LOST = f"{EVENTS}, lo as (select user_id as session, event_type as class, sum(floor(value)::bigint)::bigint as tok, sum((floor(value) * (target % 3))::bigint)::bigint as usd from ev group by 1, 2)"
LEDGER = "le as (select user_id as session, max(ts) as ended, count(*) as calls, '/home/p' || (user_id % 12) as project from events group by 1), nw as (select max(ts) as now_ from events)"
FILES = f"{EVENTS}, fi as (select event_type as folder, event_type || '/' || target as path, epoch_us(ts) // 1000000 as mtime, floor(value)::bigint as size, event_id from ev)"
DUE = f"(case folder when 'click' then mtime < {NOW} + 2 * 86400 when 'view' then mtime < {NOW} + 86400 when 'error' then mtime < {NOW} else false end and path not in ('click/1', 'view/2'))"
SETS = "us as (select user_id, list(distinct event_type) as own from events group by 1)"
SQL = {
    "tail_scan": f"""with b as (select conv_id, turn, sum(strlen(text) + 1) over {T} rows between current row and unbounded following) as behind, sum(strlen(text) + 1) over (partition by conv_id) as whole from conversations)
select conv_id, turn from b where whole <= 600 or behind < 600""",
    "head_scan": f"""with b as (select *, sum(strlen(text) + 1) over {T} rows unbounded preceding) as upto from conversations)
select conv_id, md5(text) as first from b where upto <= 400 and role = 'user' qualify row_number() over {T}) = 1""",
    "log_tail": """with s as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null), l as (select doc_id, len(ls) as n, strlen(text) + 1 as size, unnest(range(0, len(ls))) as pos from s)
select doc_id, pos::integer as pos from l where size <= 3000 or pos >= n - 4""",
    "latest_usage": f"with {TURNS} select conv_id, tokens, floor(100.0::double * tokens / 500 + 0.5)::bigint as percent from tn where role = 'assistant' and tokens > 0 qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1",
    "unanswered_exit": "select user_id, event_id from events where event_type in ('error', 'click') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and event_type = 'error'",
    "last_turn": f"""with p as (select *, max(case when role = 'user' then turn end) over (partition by conv_id) as prompt from conversations), k as (select * from p where prompt is null or turn >= prompt)
select conv_id, max(prompt) as prompt, count(*) filter (role <> 'user') as steps, (select md5(text) from k x where x.conv_id = k.conv_id order by turn desc, role desc, text desc limit 1) as last from k group by conv_id""",
    "ledger_period": f"with {LEDGER} select session, project, calls from le, nw where ended >= now_ - interval 86400 seconds and instr(project, '/p1') > 0",
    "ledger_today": f"with {LEDGER} select session, calls from le, nw where ended >= date_trunc('day', now_)",
    "multi_calls": "with r as (select user_id, count(*) filter (event_type in ('click', 'purchase')) as n from events group by user_id, epoch_us(ts) // 3600000000) select user_id, count(*) filter (n > 0) as tooled, count(*) filter (n > 1) as multi from r group by 1",
    "waste_argmax": f"with {LOST} select class, sum(tok)::bigint as tok, sum(usd)::bigint as usd, (select session from lo x where x.class = lo.class order by usd desc, session limit 1) as worst from lo group by class",
    "waste_top_class": f"with {LOST} select session, class from lo where usd > 0 qualify row_number() over (partition by session order by usd desc, class) = 1",
    "worst_sessions": f"with {LOST}, s as (select session, sum(tok)::bigint as tok, sum(usd)::bigint as usd from lo group by 1 order by usd desc, session limit 10) select * from s where tok > 0",
    "missing_calls": f"""with {EVENTS}, c as (select user_id, count(*) filter (event_type = 'error') as a, count(*) filter (value > 200) as b, count(*) filter (target = 13) as o from ev group by 1)
select 'errors' as name, sum(a)::bigint as calls, count(*) filter (a > 0) as sessions from c union all select 'dear', sum(b)::bigint, count(*) filter (b > 0) from c union all select 'odd', sum(o)::bigint, count(*) filter (o > 0) from c""",
    "commit_allowed": """with n as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events), m as (select user_id, max(i) filter (event_type = 'view') as v, max(i) filter (event_type in ('purchase', 'signup')) as e from n group by 1)
select user_id, v is not null and (e is null or v > e) as allowed from m""",
    "missing_skills": f"with {SETS} select user_id, array_to_string(list_filter(['click', 'error', 'review', 'signup'], lambda x: not list_contains(own, x)), ',') as missing from us",
    "implied_grants": f"""with {SETS}, m as (select user_id, unnest(own) as g from us union select user_id, 'view' from us where list_contains(own, 'purchase') union select user_id, 'push' from us where list_contains(own, 'signup'))
select user_id, string_agg(g, ',' order by g) as grants from m group by 1""",
    "union_by_key": f"with {EVENTS}, t as (select *, list_position(['error', 'view', 'click'], event_type) as k from ev) select user_id, target, event_id, event_type from t where k is not null and k > 0 qualify row_number() over (partition by user_id, target order by k, event_id) = 1",
    "rare_literals": r"with h as (select page_id, regexp_extract(url, '^https?://([^/.]*)', 1) as literal from pages) select literal, count(distinct page_id) as sides from h where length(trim(literal)) > 1 and regexp_matches(literal, '\p{L}') group by 1 order by 2, 1 limit 50",
    "prune_report": f"with {FILES} select folder, count(*) as files, sum(size)::bigint as bytes from fi where {DUE} group by 1",
    "pruned_files": f"with {FILES} select event_id from fi where not {DUE}",
    "first_seen": f"with {FILES} select path, min(mtime) as first_seen from fi group by 1",
    "last_of_folder": r"with p as (select regexp_extract(url, '^https?://([^?]*)', 1) as path from pages) select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, count(*) as files, max(regexp_extract(path, '([^/]*)$', 1)) as last from p group by 1",
    "oversized": r"""select doc_id, case when length(text) > 2500 then 'long' end as prompt, case when len(regexp_extract_all(text, '(?m)^[A-Z]un? ')) > 1 or regexp_matches(text, '(?im)^la [^\n]* un ') then 'stacked' when length(text) > 1500 then 'long' end as plan from documents where text is not null""",
    "names_word": r"select conv_id, turn, role from conversations where regexp_matches(replace(lower(text), 'ё', 'е'), '(^|[^\p{L}\p{N}_-])la([^\p{L}\p{N}_-]|$)')",
    "index_gaps": "select doc_id as id, 'absent' as side from documents where doc_id not in (select vec_id from embeddings) union all select vec_id, 'unlisted' from embeddings where vec_id not in (select doc_id from documents)",
    "report_merge": "with r as (" + retrieval.SQL["index_report"] + ") select " + ", ".join(f"2 * {c} as {c}" for c in ("added", "changed", "touched", "unchanged", "skipped", "error", "removed")) + " from r",
    "fused_rows": "with r as (" + retrieval.SQL["hybrid_rrf"] + ") select r.doc_id, score, rank, n_chars from r join documents d on d.doc_id = r.doc_id",
    "main_and_sub": f"with {EVENTS} select user_id, count(*) as messages, count(distinct case when event_type = 'error' then target % 5 end) as subagents from ev group by 1",
}
