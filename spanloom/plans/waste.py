"""Queries on waste and shares over transcripts made from events: a call, a use and a result for each event, some results late, notes and hooks between."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.money import price_schema
from spanloom.operators import waste
from spanloom.plans.sessions import EVENTS
from spanloom.plans.tables import events
from spanloom.plans.transcripts import RATES
from spanloom.sources import transcripts

#: Events whose transcript lines one task orders at once; three to four lines each.
EVENTS_OF_TASK = 20_000
RULES = waste.Rules(big_shell=50, full_read=20, wide_search=20)

USE = """case target % 8 when 0 then '"name":"Read","input":{"file_path":"f' || target % 3 || '.py"}' when 1 then '"name":"mcp__code__read","input":{"file":"f' || target % 3 || '.py","mode":"' || if(event_id % 2 = 0, 'full', 'map') || '"}'
when 2 then '"name":"Edit","input":{"file_path":"f' || target % 3 || '.py"}' when 3 then '"name":"Bash","input":{"command":"ls"}' when 4 then '"name":"ToolSearch","input":{"query":"select:S' || target % 5 || ', U' || target % 7 || '"}'
when 5 then '"name":"Skill","input":{"skill":"' || if(target % 3 = 0, 'handoff', 'review') || '"}' when 6 then '"name":"mcp__code__search","input":{"query":"q","literal":' || if(target % 16 = 6, 'true', 'false') || '}' else '"name":"Grep","input":{"pattern":"x"}' end"""
CALL = f"""'{{"type":"assistant","message":{{"id":"m' || event_id || '","model":"' || event_type || '","usage":{{"input_tokens":' || floor(value)::bigint * 1000 || ',"output_tokens":' || target || '}},"content":[{{"type":"tool_use","id":"t' || event_id || '",' || {USE} || '}}]}}}}'"""
RESULT = """'{"type":"user"' || case when event_type = 'error' and target % 4 = 0 then ',"toolDenialKind":"permission-rule"' when event_type = 'error' and target % 4 = 1 then ',"toolDenialKind":"user-rejected"' else '' end || ',"message":{"content":[{"type":"tool_result","tool_use_id":"t' || event_id || '","is_error":' || if(event_type = 'error', 'true', 'false') || ',"content":"' || if(target % 8 = 6 and event_id % 3 = 0, 'count: 0\\\\n', repeat('x', target * 4)) || '"}]}}'"""
SKILL = """'{"type":"user","isMeta":true,"sourceToolUseID":"t' || event_id || '","message":{"content":"' || repeat('y', target * 4) || '"}}'"""
NOTE = """if(event_type = 'purchase', '{"type":"user","isMeta":true,"message":{"content":"Stop hook feedback: x"}}', '{"type":"attachment","attachment":{"type":"hook_additional_context","content":["context: 91k"]}}')"""


def stream(spark, d):
    own = events(spark, d)
    after = F.expr("lead(event_id) over (partition by user_id order by event_id)")
    late = F.coalesce(after * 10 + 5, F.col("event_id") * 10 + 6)
    row = lambda pos, line, when=None: F.when(F.lit(True) if when is None else F.expr(when), F.struct(pos.alias("pos"), (F.expr(line) if isinstance(line, str) else line).alias("line")))
    at = F.col("event_id") * 10
    lines = F.array(
        row(at - 1, F.lit('{"type":"user","message":{"content":"go on"}}'), "event_type = 'view' and target % 6 = 0"),
        row(at, CALL),
        row(F.when(F.col("target") % 5 == 0, F.col("late")).otherwise(at + 1), RESULT),
        row(at + 3, SKILL, "target % 8 = 5"),
        row(at + 4, NOTE, "event_type in ('purchase', 'signup')"),
    )
    each = own.withColumn("late", late).select("user_id", F.explode(F.array_compact(lines)).alias("l"))
    made = each.select(F.col("user_id").cast("string").alias("session"), F.lit("p").alias("project"), "l.pos", "l.line")
    return waste.items(transcripts.records(made), spark.createDataFrame(RATES, price_schema()), RULES, parts=-(-own.count() // EVENTS_OF_TASK) or 1)


def waste_classes(spark, d):
    return waste.waste(stream(spark, d), RULES).withColumn("usd", F.round("usd", 8))


def waste_missing(spark, d):
    return waste.missing(stream(spark, d), RULES)


def waste_shares(spark, d):
    return waste.session_shares(stream(spark, d), RULES)


def waste_repeats(spark, d):
    return waste.repeats(stream(spark, d))


QUERIES = {f.__name__: f for f in (waste_classes, waste_missing, waste_shares, waste_repeats)}

STREAM = f"""{EVENTS}, c0 as (select user_id::varchar as u, event_id as e, target as k, event_type as t, floor(value)::bigint * 1000 as win, row_number() over (partition by user_id order by event_id) - 1 as i, lead(event_id) over (partition by user_id order by event_id) as nx from ev),
c1 as (select *, coalesce((win < lag(win) over (partition by u order by i) / 2.0::double)::integer, 0) as fell from c0), c2 as (select *, sum(fell) over (partition by u order by i) as seg from c1),
r(model, a, b, rr, wr) as (values ('click', 2.0::double, 10.0::double, 0.2::double, 2.5::double), ('view', 3.0, 15.0, 0.3, 3.75), ('error', 1.0, 5.0, 0.1, 1.25)),
c as (select c2.*, count(*) over (partition by u, seg order by i rows between current row and unbounded following) as lft, coalesce((win * a + k * b) / 1e6, 0) as usd, rr, wr,
  case when k % 5 = 0 then coalesce(nx * 10 + 5, e * 10 + 6) else e * 10 + 1 end as rpos, case when k % 5 = 0 then coalesce(lead(seg) over (partition by u order by i), seg) else seg end as rseg,
  case when k % 8 = 6 and e % 3 = 0 then 2 else k end as rtok, t = 'error' as err, t = 'error' and k % 4 = 0 as denied, t = 'error' and k % 4 < 2 as rejected, 'f' || k % 3 as path from c2 left join r on model = t),
x as (select u, rseg as seg, path, rpos as pos, 0 as ed, k % 8 as tool, case when k % 8 = 1 and e % 2 = 1 then 'map' else 'full' end as mode, i, rtok as tok from c where not err and k % 8 < 2
  union all select u, seg, path, e * 10, 1, 2, '', i, 0 from c where k % 8 = 2),
y as (select *, sum(ed) over (partition by u, seg, path order by pos) as epoch, coalesce(sum(ed) over (partition by u, seg, path order by pos rows between 1 following and unbounded following), 0) as later from x),
rd as (select *, row_number() over (partition by u, seg, path, epoch, tool, mode order by pos) > 1 as again from y where ed = 0)"""

SQL = {
    "waste_classes": f"""
with {STREAM}, sk as (select *, case when k % 3 = 0 then 'handoff' else 'review' end as skill from c where k % 8 = 5),
ts as (select u, rpos, i, row_number() over (partition by u, rseg, name order by rpos) > 1 as again from (select u, rseg, rpos, i, unnest(['S' || k % 5, 'U' || k % 7]) as name from c where k % 8 = 4 and not err)),
v as (
  select u, rpos as pos, i, 'deny' as cls, 'next' as kind, null::bigint as tok from c where denied
  union all select u, rpos, i, 'error', 'next', null from c where err and not rejected and k % 8 <> 3
  union all select u, e * 10 + 4, i, 'stop', 'next', null from c where t = 'purchase'
  union all select u, pos, i, 'reread', 'carry', tok from rd where again
  union all select u, pos, i, 'fullread', 'carry', tok from rd where not again and tool = 1 and tok > 20 and later = 0
  union all select u, rpos, i, 'bigbash', 'carry', rtok - 50 from c where k % 8 = 3 and not err and rtok > 50
  union all select distinct u, rpos, i, 'toolsearch', 'count', null::bigint from ts where again
  union all select u, e * 10 + 3, i, 'skill', 'carry', k from sk qualify row_number() over (partition by u, seg, skill order by e) > 1
  union all select u, e * 10 + 4, i, 'meter', 'carry', 3 from c where t = 'signup'
  union all select u, e * 10, i, 'handoff', 'self', win - 150000 from (select *, max(k % 8 = 5 and k % 3 = 0) over (partition by u, seg order by i rows between unbounded preceding and 1 preceding) as handed from c) where win > 150000 and not coalesce(handed, false)),
p as (select v.*, row_number() over (partition by v.u, v.i, kind order by pos) = 1 as first, n.win, n.usd, n.lft, n.rr, n.wr, o.rr as own from v left join c n on n.u = v.u and n.i = v.i + 1 left join c o on o.u = v.u and o.i = v.i)
select u as session, cls, count(*) as n, sum(coalesce(case when kind = 'self' then tok when kind = 'next' and first then win when kind = 'carry' then tok * lft end, 0))::bigint as tok,
round(sum(coalesce(case when kind = 'self' then tok * own / 1e6 when kind = 'next' and first then usd when kind = 'carry' then tok * (wr + (lft - 1) * rr) / 1e6 end, 0)), 8) as usd from p group by 1, 2""",
    "waste_missing": f"""
with {STREAM}, m as (
  select u, seg, pos, mark, last_value(mark ignore nulls) over (partition by u, seg order by pos rows between unbounded preceding and 1 preceding) as gap, i from (
    select u, rseg as seg, rpos as pos, {{'open': rtok = 2 and e % 3 = 0, 'literal': k % 16 = 6, 'pos': rpos}} as mark, i from c where k % 8 = 6 and not err union all select u, seg, e * 10, null, i from c where k % 8 = 7)),
g as (select * from m where mark is null and gap.open and not gap.literal)
select u as session, 'digest' as what, count(*) as n, sum(tok)::bigint as tok from rd where again and tool = 1 group by 1
union all select u, 'wide', count(*), sum(rtok)::bigint from c where k % 8 = 6 and not err and rtok > 20 group by 1
union all select g.u, 'documents', count(distinct gap), sum(rtok)::bigint from g join c on c.u = g.u and c.i = g.i group by 1""",
    "waste_shares": f"""
with {STREAM} select u as session, arg_max(t, i) as model, count(*) as turns, count(*) filter (i = 0 or (t = 'view' and k % 6 = 0)) as asks, count(*) as tooled, 0::bigint as multi, count(*) filter (denied) as deny, sum(win)::bigint as ctx, sum(k)::bigint as out,
count(*) filter (k % 8 in (1, 6)) as code, 0::bigint as docs, count(*) filter (k % 8 = 0) as read, count(*) filter (k % 8 = 7) as grep, count(*) filter (k % 8 = 3) as bash, count(*) filter (k % 8 = 2) as edit from c group by 1""",
    "waste_repeats": f"""
with {STREAM}, n as (select *, case k % 8 when 0 then path when 1 then path || e % 2 when 2 then path when 4 then k % 5 || ',' || k % 7 when 5 then (k % 3 = 0)::varchar when 6 then (k % 16 = 6)::varchar else '' end as input from c),
s as (select u, e * 10 as pos, k % 8 as tool, input, false as denial from n union all select u, rpos, k % 8, input, true from n where denied),
l as (select *, lag(denial) over w as d, lag(tool) over w as pt, lag(input) over w as pi from s window w as (partition by u order by pos))
select u as session, count(*) as n from l where not denial and d and pt = tool and pi = input group by 1""",
}
