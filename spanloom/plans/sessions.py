"""Queries on events, conversations, parts and orders: ledgers, shares, order-dependent logic, chains, verdicts, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions.money import cost, month_key, price_schema, priced
from spanloom.functions.text import percent, tokens_by_length
from spanloom.operators import order, usage, verdicts
from spanloom.plans.tables import events, table
from spanloom.shared import shared_path

USER, TIME = ["user_id"], ["ts", "event_id"]
PRICES = [(0, "PROMO", 2.0, 10.0, 0.2, 2.5, 4.0), (1, "PRO", 3.0, 15.0, 0.3, 3.75, 6.0), (2, "ECONOMY", 1.0, 5.0, 0.1, 1.25, 2.0), (3, "STANDARD", 5.0, 25.0, 0.5, 6.25, 10.0)]


def minute_calls(spark, d, last):
    own = events(spark, d).withColumn("minute", F.floor(F.unix_seconds("ts") / 60))
    return usage.wins(own, ["user_id", "minute"], [F.col("ts"), F.col("event_id")], last)


def ledger_by_session(spark, d):
    return minute_calls(spark, d, True).groupBy("user_id").agg(F.count("*").alias("messages"), F.round(F.sum("value"), 4).alias("cost"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def ledger_first_wins(spark, d):
    return minute_calls(spark, d, False).groupBy("user_id").agg(F.count("*").alias("messages"), F.round(F.sum("value"), 4).alias("cost"))


def price_prefix_join(spark, d):
    prices = spark.createDataFrame(PRICES, price_schema())
    found = priced(table(spark, d, "part"), prices, "p_type").groupBy("p_type").agg(F.count("*").alias("n"), F.bool_and("priced").alias("priced"), F.max("price.input").alias("rate"))
    return found


def cost_rollup_4dp(spark, d):
    prices = spark.createDataFrame([(0, "p", 2.0, 10.0, 0.2, 2.5, 4.0), (1, "c", 3.0, 15.0, 0.3, 3.75, 6.0)], price_schema())
    own = priced(events(spark, d), prices, "event_type")
    tokens = F.floor(F.col("value") * 100).cast("long")
    sums = own.groupBy("user_id", "event_type", "price").agg(F.sum(tokens).alias("n"))
    money = F.round(cost(F.col("n"), F.floor(F.col("n") / 10), F.col("n") * 3, F.lit(0), F.lit(7)), 4)
    return sums.withColumn("usd", money).groupBy("user_id").agg(F.round(F.sum("usd"), 4).alias("usd"))


def usage_by_project(spark, d):
    return events(spark, d).groupBy("target").agg(F.countDistinct("user_id").alias("sessions"), F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("cost"))


def usage_top_tools(spark, d):
    own = events(spark, d).groupBy("target").agg(F.count("*").alias("calls"))
    return own.orderBy(F.col("calls").desc(), "target").limit(12)


def usage_skills(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("sessions"), F.count("*").alias("calls"))


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", tokens_by_length("text").alias("tokens"))


def context_sources(spark, d):
    own = turns(spark, d)
    asks = own.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("prompt").alias("source"))
    replies = own.where("role != 'user'")
    joined = replies.join(asks.dropDuplicates(["conv_id", "turn"]), ["conv_id", "turn"], "left")
    return joined.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), "role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"))


def shares_grouping_sets(spark, d):
    own = events(spark, d)
    flag = lambda t: (F.col("event_type") == t).cast("long")
    sessions = own.groupBy("user_id").agg(F.min("ts").cast("string").alias("start"), F.count("*").alias("turns"), F.sum(flag("view")).alias("views"), F.sum(flag("error")).alias("errors")).withColumn("project", F.col("user_id") % 5)
    return usage.shares(usage.by_period(sessions, "2024-01-01 12:00:00", ["turns", "views", "errors"]), "views", "turns")


def batch_and_steps(spark, d):
    own = turns(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = own.withColumn("asks", F.coalesce((F.col("role") != "user") & (F.lag("role").over(w) == "user"), F.lit(False)))
    return marked.groupBy("conv_id").agg(F.count_if(F.col("role") != "user").alias("steps"), F.count_if("asks").alias("asks"), percent(F.count_if("asks"), F.count("*")).alias("asks_percent"))


def segments(spark, d):
    return order.segments(events(spark, d), USER, TIME, "value").select("event_id", "seg", "left")


def reread(spark, d):
    return order.rereads(events(spark, d), USER, TIME, "target", F.col("event_type") == "purchase", F.col("event_type") == "click")


def reread_events(spark, d):
    return reread(spark, d).select("event_id", "again")


def fullread_no_later_edit(spark, d):
    return reread(spark, d).where("not again and later_edits = 0 and value > 50").select("event_id", "value")


def calls_and_events(spark, d):
    own = order.segments(events(spark, d), USER, TIME, "value").withColumn("i", F.row_number().over(Window.partitionBy(*USER).orderBy(*TIME)))
    calls = own.select("user_id", "i", F.col("value").alias("win"), (F.col("value") / 1000).alias("usd"), "left")
    return calls, own.withColumn("at", F.col("i"))


def waste_next_call(spark, d):
    calls, own = calls_and_events(spark, d)
    denied = own.where("event_type = 'error'").select("user_id", "event_id", F.floor(F.col("at") / 3).cast("int").alias("at"))
    return order.charge_next(calls, denied, USER).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("tok"), 4).alias("tok"), F.round(F.sum("usd"), 6).alias("usd"))


def waste_carry(spark, d):
    calls, own = calls_and_events(spark, d)
    read = own.where("event_type = 'view'").select("user_id", "event_id", "at", F.floor("value").cast("long").alias("tok"))
    return order.charge_carry(calls, read, USER, F.lit(2.5), F.lit(0.2)).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("carried").alias("carried"), F.round(F.sum("usd"), 6).alias("usd"))


def deny_repeat(spark, d):
    own = events(spark, d).withColumn("same", F.col("target") % 4)
    return order.denied_repeats(own, USER, TIME, F.col("event_type") == "error", ["same"]).where("repeat").select("event_id", "user_id")


def gap_open_close(spark, d):
    found = order.open_gaps(events(spark, d), USER, TIME, F.col("event_type") == "error", F.col("event_type") == "purchase", "event_id")
    return found.where("gap is not null and event_type = 'click'").select("event_id", "gap")


def context_levels(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    own = turns(spark, d).withColumn("total", F.sum("tokens").over(w))
    return own.groupBy("conv_id").agg(F.max("total").alias("total")).withColumn("level", order.level(F.col("total"), 50, 150, 400))


def start_cost_layers(spark, d):
    own = turns(spark, d).withColumns({"session": F.col("conv_id"), "pos": F.col("turn"), "type": F.col("role"), "model": F.lit("m")})
    return usage.start_cost(own, F.when(F.col("role") != "assistant", F.col("role")), F.col("tokens"))


def monthly_rollup(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ended"), F.col("o_totalprice").alias("cost"))
    none = spark.createDataFrame([], "month string, sessions long, cost double")
    cut = F.lit("1997-01-01").cast("timestamp")
    months, rest = usage.rollup(own, none, cut)
    again, _ = usage.rollup(rest, months, F.lit("1997-07-01").cast("timestamp"))
    return again.select("month", "sessions", F.round("cost", 2).alias("cost"))


def edges(spark, d):
    own = events(spark, d).withColumn("session", F.col("event_id")).withColumn("key", F.col("target") % 10)
    return order.handoff_edges(own.where("event_type = 'error'"), own.where("event_type = 'signup'"), ["key"], 600)


def handoff_asof(spark, d):
    return edges(spark, d).select("parent", "child", "gap_us")


def handoff_chain(spark, d):
    """Users as sessions: the last error of each hands on to another user's nearest sign-up within six hours."""
    own = events(spark, d).withColumn("session", F.col("user_id")).withColumn("key", F.col("user_id") % 3)
    exits = usage.wins(own.where("event_type = 'error'"), USER, [F.col("ts"), F.col("event_id")], last=True)
    return order.chain_ends(order.handoff_edges(exits, own.where("event_type = 'signup'"), ["key"], 6 * 3600))


def failure_streak(spark, d):
    found = order.streaks(events(spark, d), USER, TIME, F.col("event_type").isin("error", "view"))
    return found.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 3).alias("hints"))


def decisions_by_hook(spark, d):
    return events(spark, d).groupBy("target", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def uniq_collapse(spark, d):
    from spanloom.sources.files import uniq

    return uniq(events(spark, d), USER, TIME, "event_type").select("event_id")


def verdict_merge(spark, d):
    own = events(spark, d)
    level = F.when(F.col("value") > 150, "deny").when(F.col("value") > 80, "ask").otherwise("context")
    one = own.select("user_id", "target", F.col("event_id").alias("ord"), level.alias("level"), F.col("event_type").alias("reason"))
    return verdicts.merge(one, ["user_id", "target"])


def pending_question(spark, d):
    from spanloom.functions.text import pending_question as asks

    return turns(spark, d).select("conv_id", "turn", asks("text").alias("question")).where("question is not null")


def prose_lines(spark, d):
    from spanloom.functions.text import prose_lines as prose

    own = table(spark, d, "documents").where("text is not null").select("doc_id", prose("text").alias("p"))
    return own.select("doc_id", F.size("p").alias("n_lines"), F.coalesce(F.array_max(F.transform("p", lambda x: x["paragraph"])) + 1, F.lit(0)).alias("n_paragraphs"))


def streamed(spark, d, processed, purpose):
    from spanloom.streaming.states import drain

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
        own = source.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value", "event_id")
        path = shared_path(spark, purpose)
        drain(processed(own), f"{path}/rows", f"{path}/state")
        return spark.read.parquet(f"{path}/rows")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream_threshold_notice(spark, d):
    from spanloom.streaming.states import notices

    return streamed(spark, d, lambda s: notices(s.withColumn("tokens", F.floor("value").cast("long") * 1000)), "notices")


def breaker_window(spark, d):
    from spanloom.streaming.states import breaker

    return streamed(spark, d, lambda s: breaker(s, seconds=3600), "breaker")


def stream_failure_streak(spark, d):
    from spanloom.streaming.states import failure_streaks

    return streamed(spark, d, lambda s: failure_streaks(s.withColumn("failed", F.col("event_type").isin("error", "view"))), "streaks")


#: What events stand for in attempts: purchases are edits, clicks passes, errors and views failures, sign-ups interrupted ones.
KIND = "case event_type when 'purchase' then 'edit' when 'click' then 'pass' when 'signup' then 'skip' else 'fail' end"


def failure_attempts(spark, d):
    """The first third failure of a command with edits between, for each user, where the value lets it be told."""
    own = events(spark, d).withColumns({"kind": F.expr(KIND), "command": F.col("event_id") % 3})
    found = order.attempts(own, USER, TIME, "command", F.col("kind") == "edit", F.col("kind") == "pass", F.col("kind") == "fail")
    first = usage.wins(found.where((F.col("failures") >= 3) & F.col("counted") & (F.col("value") > 20)), USER, [F.col("ts"), F.col("event_id")], last=False)
    return first.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("command").cast("string").alias("command"), "failures")


def stream_failure_attempts(spark, d):
    from spanloom.streaming.sessions import attempts

    return streamed(spark, d, lambda s: attempts(s.withColumns({"kind": F.expr(KIND), "command": (F.col("event_id") % 3).cast("string"), "hints": F.col("value") > 20, "ord": F.col("event_id")}), keep=10**12), "attempts")


def stream_commit_gate(spark, d):
    """Sign-ups ask; views are reads, purchases edits, clicks reviews, each for an hour and a half."""
    from spanloom.streaming.sessions import commit_gate

    mark = F.when(F.col("event_type") != "signup", F.col("event_type"))
    rule = {"needs": ["click"], "reads": "view", "changes": ["purchase", "click"], "keep": 5_400_000}
    return streamed(spark, d, lambda s: commit_gate(s.withColumns({"mark": mark, "asks": F.col("event_type") == "signup", "ord": F.col("event_id")}), **rule), "gate")


def stream_context_notes(spark, d):
    """Values as usage; clicks are prompts, views steps, purchases work, sign-ups stops."""
    from spanloom.streaming.sessions import context_notes

    kind = F.expr("case event_type when 'click' then 'prompt' when 'view' then 'step' when 'purchase' then 'work' when 'signup' then 'stop' end")

    def notes(s):
        own = s.withColumns({"ord": F.col("event_id"), "tokens": F.floor("value").cast("long") * 3000, "kind": kind})
        return context_notes(own, own.where("kind is not null"))

    return streamed(spark, d, notes, "context")


QUERIES = {f.__name__: f for f in (ledger_by_session, ledger_first_wins, price_prefix_join, cost_rollup_4dp, usage_by_project, usage_top_tools, usage_skills, context_sources, shares_grouping_sets, batch_and_steps, segments, reread_events, fullread_no_later_edit, waste_next_call, waste_carry, deny_repeat, gap_open_close, context_levels, start_cost_layers, monthly_rollup, handoff_asof, handoff_chain, failure_streak, decisions_by_hook, uniq_collapse, verdict_merge, pending_question, prose_lines, stream_threshold_notice, breaker_window, stream_failure_streak, failure_attempts, stream_failure_attempts, stream_commit_gate, stream_context_notes)}

EVENTS = "ev as (select *, json_extract_string(props, '$.k')::integer as target from events)"
W = "(partition by user_id order by ts, event_id)"
PAST = "(partition by user_id order by ts, event_id rows unbounded preceding)"
SEGMENTS = f"""sg as (select *, sum(fell) over {PAST} as seg from (select *, coalesce((value < lag(value) over {W} / 2)::integer, 0) as fell from ev)),
calls as (select *, count(*) over (partition by user_id, seg order by ts, event_id rows between current row and unbounded following) as lft, row_number() over {W} as i from sg)"""
READS = """rd as (select *, sum((event_type = 'purchase')::integer) over (partition by user_id, target order by ts, event_id rows unbounded preceding) as epoch,
coalesce(sum((event_type = 'purchase')::integer) over (partition by user_id, target order by ts, event_id rows between 1 following and unbounded following), 0) as later from ev where event_type in ('purchase', 'click')),
rr as (select *, row_number() over (partition by user_id, target, epoch order by ts, event_id) > 1 as again from rd where event_type = 'click')"""
MINUTES = "mm as (select *, row_number() over (partition by user_id, epoch_us(ts) // 60000000 order by ts desc, event_id desc) as l, row_number() over (partition by user_id, epoch_us(ts) // 60000000 order by ts, event_id) as f from events)"
TURNS = "tn as (select *, floor(length(text) / 4.0::double + 0.5)::bigint as tokens from conversations)"
CHILDREN = """x as (select user_id as parent, epoch_us(ts) as t from events where event_type = 'error' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
s as (select user_id as child, epoch_us(ts) as u from events where event_type = 'signup'),
ne as (select parent, child from x join s on parent % 3 = child % 3 and parent <> child and abs(t - u) <= 21600000000 qualify row_number() over (partition by parent order by abs(t - u), u, child) = 1)"""
ATTEMPTS = f"""
with k as (select *, event_id % 3 as command, {KIND} as kind from events), e as (select *, sum((kind = 'edit')::integer) over (partition by user_id order by ts, event_id) as edits from k),
r as (select *, sum((kind = 'pass')::integer) over (partition by user_id, command order by ts, event_id) as run from e where kind in ('pass', 'fail')),
f as (select *, dense_rank() over (partition by user_id, command, run order by edits) as failures, row_number() over (partition by user_id, command, run, edits order by ts, event_id) as nth from r where kind = 'fail')
select user_id::varchar as key, ts as at, command::varchar as command, failures::integer as failures from f where failures >= 3 and nth = 1 and value > 20 qualify row_number() over (partition by user_id order by ts, event_id) = 1"""

SQL = {
    "ledger_by_session": f"with {MINUTES} select user_id, count(*) as messages, round(sum(value), 4) as cost, min(ts) as started, max(ts) as ended from mm where l = 1 group by 1",
    "ledger_first_wins": f"with {MINUTES} select user_id, count(*) as messages, round(sum(value), 4) as cost from mm where f = 1 group by 1",
    "price_prefix_join": """
with p(prefix, ord, rate) as (values ('PROMO', 0, 2.0::double), ('PRO', 1, 3.0), ('ECONOMY', 2, 1.0), ('STANDARD', 3, 5.0)), t as (select p_type, count(*) as n from part group by 1)
select p_type, n, exists (select 1 from p where starts_with(p_type, prefix)) as priced, (select arg_min(rate, ord) from p where starts_with(p_type, prefix)) as rate from t""",
    "cost_rollup_4dp": """
with s as (select user_id, event_type, sum(floor(value * 100)::bigint) as n from events group by 1, 2),
c as (select user_id, case when starts_with(event_type, 'p') then round((n * 2.0::double + floor(n / 10.0) * 10 + n * 3 * 0.2::double + 28) / 1e6, 4) when starts_with(event_type, 'c') then round((n * 3.0::double + floor(n / 10.0) * 15 + n * 3 * 0.3::double + 42) / 1e6, 4) else 0 end as usd from s)
select user_id, round(sum(usd), 4) as usd from c group by 1""",
    "usage_by_project": f"with {EVENTS} select target, count(distinct user_id) as sessions, count(*) as calls, round(sum(value), 2) as cost from ev group by 1",
    "usage_top_tools": f"with {EVENTS} select target, count(*) as calls from ev group by 1 order by 2 desc, 1 limit 12",
    "usage_skills": "select event_type, count(distinct user_id) as sessions, count(*) as calls from events group by 1",
    "context_sources": """
with a as (select distinct conv_id, turn + 1 as turn from conversations where role = 'user')
select case when a.conv_id is null then 'unknown' else 'prompt' end as source, role, count(*) as calls, sum(length(text))::bigint as chars from conversations c left join a on a.conv_id = c.conv_id and a.turn = c.turn where role <> 'user' group by 1, 2""",
    "shares_grouping_sets": """
with s as (select user_id % 5 as project, case when min(ts) >= timestamp '2024-01-01 12:00:00' then 'after' else 'before' end as period, count(*) as turns, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'error') as errors from events group by user_id)
select project, period, grouping(project)::integer as all_projects, count(*) as sessions, sum(turns)::bigint as turns, sum(views)::bigint as views, sum(errors)::bigint as errors,
case when coalesce(sum(turns), 0) = 0 then 0 else floor(100.0 * sum(views)::double / sum(turns) + 0.5)::bigint end as share from s group by grouping sets ((project, period), (period))""",
    "batch_and_steps": """
with m as (select *, coalesce(role <> 'user' and lag(role) over (partition by conv_id order by turn, role, text) = 'user', false) as asked from conversations)
select conv_id, count(*) filter (role <> 'user') as steps, count(*) filter (asked) as asks, floor(100.0 * count(*) filter (asked)::double / count(*) + 0.5)::bigint as asks_percent from m group by 1""",
    "segments": f"with {EVENTS}, {SEGMENTS} select event_id, seg::bigint as seg, lft as \"left\" from calls",
    "reread_events": f"with {EVENTS}, {READS} select event_id, again from rr",
    "fullread_no_later_edit": f"with {EVENTS}, {READS} select event_id, value from rr where not again and later = 0 and value > 50",
    "waste_next_call": f"""
with {EVENTS}, {SEGMENTS}, e as (select user_id, event_id, i // 3 as spot from calls where event_type = 'error'), n as (select *, row_number() over (partition by user_id, spot order by event_id) as k from e)
select n.user_id, count(*) as n, round(sum(case when k = 1 then coalesce(c.value, 0) else 0 end), 4) as tok, round(sum(case when k = 1 then coalesce(c.value / 1000, 0) else 0 end), 6) as usd from n left join calls c on c.user_id = n.user_id and c.i - 1 = n.spot group by 1""",
    "waste_carry": f"""
with {EVENTS}, {SEGMENTS}, e as (select user_id, i as at, floor(value)::bigint as tok from calls where event_type = 'view')
select e.user_id, count(*) as n, sum(tok * c.lft)::bigint as carried, round(sum((tok * 2.5::double + tok * (c.lft - 1) * 0.2::double) / 1e6), 6) as usd from e join calls c on c.user_id = e.user_id and c.i - 1 = e.at group by 1""",
    "deny_repeat": f"""
with {EVENTS}, l as (select *, lag(event_type) over {W} as t, lag(target % 4) over {W} as s from ev)
select event_id, user_id from l where t = 'error' and s is not distinct from target % 4""",
    "gap_open_close": f"""
with m as (select *, case when event_type in ('error', 'purchase') then event_id end as mark from events),
g as (select *, last_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_mark from m)
select g.event_id, g.last_mark as gap from g join events o on o.event_id = g.last_mark and o.event_type = 'error' where g.event_type = 'click'""",
    "context_levels": f"with {TURNS}, s as (select conv_id, sum(tokens)::bigint as total from tn group by 1) select conv_id, total, case when total >= 400 then 'hard' when total >= 150 then 'hand' when total >= 50 then 'soft' end as level from s",
    "start_cost_layers": f"""
with {TURNS}, f as (select conv_id, min(turn) as first from tn where role = 'assistant' group by 1)
select tn.conv_id as session, role as layer, sum(tokens)::bigint as tokens from tn join f on f.conv_id = tn.conv_id where turn < first and role <> 'assistant' group by 1, 2""",
    "monthly_rollup": "select strftime(o_orderdate, '%Y-%m') as month, count(*) as sessions, round(sum(o_totalprice), 2) as cost from orders where o_orderdate < timestamp '1997-07-01' group by 1",
    "handoff_asof": f"""
with {EVENTS}, x as (select event_id as parent, target % 10 as k, epoch_us(ts) as t from ev where event_type = 'error'), s as (select event_id as child, target % 10 as k, epoch_us(ts) as u from ev where event_type = 'signup')
select parent, child, abs(t - u) as gap_us from x join s on x.k = s.k and abs(t - u) <= 600000000 qualify row_number() over (partition by parent order by abs(t - u), u, child) = 1""",
    "handoff_chain": f"""
with recursive {CHILDREN}, r as (select parent, child as last, 1 as hops, [parent, child] as seen from ne union all select r.parent, ne.child, hops + 1, list_append(seen, ne.child) from r join ne on ne.parent = r.last where hops < 50 and not list_contains(seen, ne.child))
select parent, arg_max(last, hops) as last, max(hops) as hops from r group by 1""",
    "failure_streak": f"""
with m as (select *, event_type in ('error', 'view') as bad, sum((event_type not in ('error', 'view'))::integer) over {PAST} as run from events),
s as (select user_id, row_number() over (partition by user_id, run order by ts, event_id) as streak from m where bad)
select user_id, max(streak)::integer as longest, count(*) filter (streak = 3) as hints from s group by 1""",
    "stream_failure_streak": f"""
with m as (select *, event_type in ('error', 'view') as bad, sum((event_type not in ('error', 'view'))::integer) over {PAST} as run from events),
s as (select *, row_number() over (partition by user_id, run order by ts, event_id) as streak from m where bad)
select user_id::varchar as key, ts as at, 3::integer as failures from s where streak = 3 qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "failure_attempts": ATTEMPTS,
    "stream_failure_attempts": ATTEMPTS,
    "stream_commit_gate": """
with m as (select *, max(ts) filter (event_type = 'click') over w as c, max(ts) filter (event_type = 'view') over w as v, max(ts) filter (event_type = 'purchase') over w as p from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
l as (select user_id, ts, case when ts - c <= interval 90 minute then c end as c, case when ts - v <= interval 90 minute then v end as v, case when ts - p <= interval 90 minute then p end as p from m where event_type = 'signup')
select user_id::varchar as key, ts as at, c is not null and v is not null and v > greatest(c, p) as allowed, case when c is null then 'click' when v is null or v <= greatest(c, p) then 'view' end as missing from l""",
    "decisions_by_hook": f"with {EVENTS} select target, event_type, count(*) as n, max(value) as most from ev group by 1, 2",
    "uniq_collapse": f"select event_id from events qualify lag(event_type) over {W} is null or lag(event_type) over {W} <> event_type",
    "verdict_merge": f"""
with {EVENTS}, v as (select user_id, target, event_id, event_type, case when value > 150 then 3 when value > 80 then 2 else 0 end as p from ev), m as (select *, max(p) over (partition by user_id, target) as top from v)
select user_id, target, case top when 3 then 'deny' when 2 then 'ask' else 'context' end as level, string_agg(event_type, '; ' order by event_id) as reasons from m where p = top group by user_id, target, top""",
}
