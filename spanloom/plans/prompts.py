"""Queries on what prompts allow, and on lines that link pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions.grants import Vocabulary, grants
from spanloom.operators import linkmine, settings
from spanloom.plans.tables import table
from spanloom.sources import transcripts

#: Words of the tables' invented languages in place of commands.
INVENTED = Vocabulary(
    stems={"push": ["^on", "^de$"], "mr": ["^(the|la)$"], "delete": ["^er[a-h]"], "deploy": ["^und$"]},
    phrases={"mr": [r"st\S*\s+\S*on"], "push-delete": [r"th\S*\s+(\S+\s+)?and"]},
    implies={"mr": ["push"], "delete": ["revert"]},
    before=("of", "is", "et"),
    after=("in",),
    particle="to",
    verdict="^th",
)


def session_lines(spark, d):
    """A transcript for each conversation: texts of users as texts or blocks, notes of the program, and answers."""
    own = table(spark, d, "conversations").withColumn("n", F.length("text"))
    text, block = F.col("text"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    user = lambda content: F.to_json(F.struct(F.lit("user").alias("type"), (F.col("n") % 5 == 0).alias("isMeta"), F.struct(F.when(F.col("n") % 7 == 0, "auto").otherwise("human").alias("kind")).alias("origin"), F.struct(content.alias("content")).alias("message")))
    answer = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(block.alias("content")).alias("message")))
    line = F.when(F.col("role") != "user", answer).when(F.col("n") % 2 == 0, user(text)).otherwise(user(block))
    return own.select(F.col("conv_id").alias("session"), F.struct("turn", "text").alias("pos"), line.alias("line"))


def prompt_grants(spark, d):
    """What the last prompt of a human allows in each conversation."""
    last = transcripts.last_prompts(session_lines(spark, d))
    return last.select("session", F.sha2("text", 256).alias("prompt"), F.array_join(grants("text", INVENTED), " ").alias("grants"))


def typed_prompts(spark, d):
    """How many of a conversation's records people have typed."""
    return transcripts.prompts(session_lines(spark, d)).groupBy("session").agg(F.count("*").alias("prompts"), F.count_if("typed").alias("typed"), F.count_if("human").alias("human"))


TAGS = (linkmine.Kind("links", ("href=",), needs=r'href="/', never="^<link"), linkmine.Kind("lists", ("<ul", "<li>"), grouped=False), linkmine.Kind("scripts", ("track(", "var "), at="var ", not_there="^var x"))
ITEMS = linkmine.Decoration(name="^<(nav|ul|li|p)>", like="^<(ul|li)", method='^<a href="([^"]*)"')


def page_lines(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.regexp_replace("html", "<", "\n<").alias("text"))


def linked_lines(spark, d):
    """Tags that link pages, and what stands below those that hold others."""
    found = linkmine.linked_lines(page_lines(spark, d), kinds=TAGS, decoration=ITEMS)
    return found.select("path", "line", "kind", F.sha2("code", 256).alias("code"), "symbol", "literal")


def linked_sides(spark, d):
    return linkmine.literal_sides(linkmine.linked_lines(page_lines(spark, d), kinds=TAGS, decoration=ITEMS))


def order_settings(spark, d, before: bool):
    """Nested settings from each order, or from the customer's order before."""
    own = table(spark, d, "orders").withColumn("year", F.year("o_orderdate")).select("o_orderkey", *(F.lag(c).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias(c) if before else c for c in ("o_orderstatus", "year", "o_orderpriority")))
    still = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("year").alias("model")).alias("still"))
    made = F.struct(F.col("year").alias("model"), F.struct(F.col("year").alias("YEAR")).alias("env"), F.struct(still.alias("er")).alias("deep"), F.array_compact(F.array("o_orderpriority", "o_orderstatus")).alias("tags"))
    return settings.settings_items(own.select("o_orderkey", F.to_json(made).alias("text")), "o_orderkey", "text")


def settings_lost(spark, d):
    """What the settings of an order hold and those of the customer's order before do not."""
    return settings.settings_difference(order_settings(spark, d, False), order_settings(spark, d, True), "o_orderkey")


QUERIES = {f.__name__: f for f in (prompt_grants, typed_prompts, linked_lines, linked_sides, settings_lost)}

USER = "us as (select conv_id as session, turn, text, length(text) as n from conversations where role = 'user' and length(text) % 5 <> 0)"
LINES = r"""raw as (select page_id::varchar as path, unnest(ls) as x, generate_subscripts(ls, 1) as line from (select page_id, string_split(replace(html, '<', chr(10) || '<'), chr(10)) as ls from pages)),
tr as (select path, line, x, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') as code, case when not regexp_matches(x, '^<(ul|li)') then nullif(regexp_extract(x, '^<a href="([^"]*)"', 1), '') end as link from raw),
nx as (select *, first_value(link ignore nulls) over (partition by path order by line rows between 1 following and 6 following) as later, regexp_extract(code, '^<(nav|ul|li|p)>', 1) as tag from tr),
kd as (
  select *, 'links' as kind from nx where contains(code, 'href="/') and not starts_with(code, '<link')
  union all select *, 'lists' from nx where contains(code, '<ul') or contains(code, '<li>')
  union all select *, 'scripts' from nx where (contains(code, 'track(') or contains(code, 'var ')) and not (contains(code, 'var ') and starts_with(substring(code, instr(code, 'var ')), 'var x'))),
li as (select *, list_filter(regexp_extract_all(code, '[''"`]([^''"`]+)[''"`]', 1), lambda s: length(trim(s)) > 1 and regexp_matches(s, '\p{L}'))[1] as quoted,
  list_filter(list_transform(regexp_extract_all(code, '\b[A-Z][A-Z0-9_]{2,}(?:\.[A-Z][A-Z0-9_]+)*\b(?:\.[a-z])?'), lambda s: case when not regexp_matches(s, '\.[a-z]$') then s end), lambda s: s is not null)[1] as constant from kd where not regexp_matches(code, '^(?://|/\*|\*)')),
ll as (select path, line, kind, code, case when tag <> '' then coalesce(later, tag) end as symbol, case when kind = 'lists' then '' else coalesce(quoted, constant, '') end as literal from li)"""
SQL = {
    "typed_prompts": f"with {USER} select session, count(*) as prompts, count(*) filter (where trim(text) <> '' and not starts_with(trim(text), '[Request interrupted') and not starts_with(trim(text), '<')) as typed, count(*) filter (where n % 7 <> 0) as human from us group by 1",
    "prompt_grants": rf"""
with {USER}, la as (select c.session, coalesce(p.text, '') as text from (select distinct conv_id as session from conversations) c left join (select * from us where n % 7 <> 0 qualify row_number() over (partition by session order by turn desc, text desc) = 1) p using (session)),
ow as (select session, text, array_to_string(list_filter(string_split(regexp_replace(text, '(?s)```.*?(?:```|\z)', chr(10), 'g'), chr(10)), lambda s: not regexp_matches(s, '^\s*>')), chr(10)) as own from la),
st as (select session, array_to_string(list_filter(regexp_extract_all(own, '[^.!?\n]*[.!?\n]|[^.!?\n]+'), lambda s: not regexp_matches(s, '\?\s*$')), chr(10)) as told from ow),
sp as (select session, string_split_regex(replace(lower(told), 'ё', 'е'), '[.,;:!?()\n]+|\s(?:и|но|а|потом|затем|then|and|but)\s') as cs from st),
cl as (select session, unnest(cs) as clause, generate_subscripts(cs, 1) as c from sp),
wo as (select session, c, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select session, c, regexp_extract_all(clause, '[\p{{L}}\p{{N}}]+') as ws from cl)),
ng as (select *, coalesce(bool_or(word in ('of', 'is', 'et')) over (partition by session, c order by i rows between 3 preceding and 1 preceding), false) as before, coalesce(lead(word) over (partition by session, c order by i), '') as a, coalesce(lead(word, 2) over (partition by session, c order by i), '') as b from wo),
ok as (select * from ng where not before and a <> 'in' and not (a = 'to' and starts_with(b, 'th'))),
ph as (select session, k, string_split_regex(trim(regexp_replace(' ' || regexp_extract(clause, '(?s)^(.*?)(?:' || p || ')', 1), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as ahead from cl, (values ('mr', 'st\S*\s+\S*on'), ('push-delete', 'th\S*\s+(?:\S+\s+)?and')) as v(k, p) where regexp_matches(clause, p)),
gr as (
  select session, 'push' as g from ok where regexp_matches(word, '^on|^de$') union select session, 'mr' from ok where word in ('the', 'la')
  union select session, 'delete' from ok where regexp_matches(word, '^er[a-h]') union select session, 'deploy' from ok where word = 'und'
  union select session, k from ph where not list_has_any(list_slice(ahead, greatest(len(ahead) - 2, 1), len(ahead)), ['of', 'is', 'et'])),
al as (select * from gr union select session, 'push' from gr where g = 'mr' union select session, 'revert' from gr where g = 'delete')
select o.session, sha256(o.text) as prompt, coalesce(x.grants, '') as grants from ow o left join (select session, string_agg(g, ' ' order by g) as grants from al group by 1) x using (session)""",
    "settings_lost": """
with o as (select o_orderkey, o_orderstatus as s, year(o_orderdate) as c, o_orderpriority as p, lag(o_orderstatus) over w as ls, lag(year(o_orderdate)) over w as lc, lag(o_orderpriority) over w as lp from orders window w as (partition by o_custkey order by o_orderkey)),
d as (
  select o_orderkey, v.path, case when v.was is null then 'missing' else 'different' end as state, null::varchar as value from o, lateral (values ('env.YEAR', c::varchar, lc::varchar), ('deep.er.still.status', s, ls), ('deep.er.still.model', c::varchar, lc::varchar)) as v(path, is_, was) where v.is_ is distinct from v.was
  union select o_orderkey, 'tags', 'missing', v.tag from o, lateral (values (p), (s)) as v(tag) where not coalesce(v.tag in (ls, lp), false))
select * from d""",
    "linked_lines": f"with {LINES} select path, line::int as line, kind, sha256(code) as code, symbol, literal from ll",
    "linked_sides": f"with {LINES} select kind, literal, count(*) as sides, arg_min(path || ':' || line, (path, line)) as first from ll where literal <> '' group by 1, 2",
}
