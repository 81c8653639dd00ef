"""Queries of ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import ordered as op
from skein.plans.registry import Tables, query


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders")
def row_number(t: Tables) -> DataFrame:
    return op.numbered(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "n")


@query("""select o_orderkey, max(d - rn) over (partition by o_custkey order by o_orderdate, o_orderkey) + rn as at from
(select *, epoch(date_trunc('month', o_orderdate))::bigint as d, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders)""")
def monotonic_ts(t: Tables) -> DataFrame:
    o = t.orders.withColumn("b", F.unix_timestamp(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))))
    return op.monotonic(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("b"), "at").select("o_orderkey", "at")


@query("""select conv_id, turn, expected from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) + 1 as expected from conversations
where (conv_id * 7 + turn) % 5 <> 0) where turn <> expected""")
def gap_detect(t: Tables) -> DataFrame:
    return op.gaps(t.conversations.where("(conv_id * 7 + turn) % 5 <> 0").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""select user_id, sum(greatest(v - coalesce(p, 0), 0)) as gained from (select user_id, event_id % 100 as v, lag(event_id % 100) over (partition by user_id order by event_id) as p
from events) group by user_id""")
def counter_delta(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", (F.col("event_id") % 100).alias("v"))
    return op.counter_deltas(e, ["user_id"], ["event_id"], "v", "d").groupBy("user_id").agg(F.sum("d").alias("gained"))


@query("select user_id, event_type from (select user_id, arg_max(event_type, event_id) as event_type from events group by 1) where event_type in ('click', 'view')")
def latest_per_key(t: Tables) -> DataFrame:
    return op.latest_then(t.events, "user_id", "event_id", "event_type", ["click", "view"])


@query("""select user_id, seg, count(*) as n, min(event_id) as first_id from (select *, coalesce(sum((event_type in ('purchase', 'error'))::int)
over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) + 1 as seg from events) group by 1, 2""")
def turn_segments(t: Tables) -> DataFrame:
    out = op.turns_by_markers(t.events, ["user_id"], ["event_id"], "event_type", "view", ["purchase", "error"], "seg")
    return out.groupBy("user_id", "seg").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""select user_id, event_type, coalesce(sum(d), 0)::bigint as us from (select *, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as d from events) group by 1, 2""")
def phase_times(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return op.phase_times(t.events, ["user_id"], ["ts", "event_id"], at, "event_type", "us")


@query("""select user_id, min(epoch_us(ts)) filter (where event_type = 'click') - min(epoch_us(ts)) as first_click_us,
min(epoch_us(ts)) filter (where event_type = 'purchase') - min(epoch_us(ts)) as first_purchase_us from events group by user_id""")
def time_to_first(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = lambda k: (F.min(F.when(F.col("event_type") == k, at)) - F.min(at)).alias(f"first_{k}_us")
    return t.events.groupBy("user_id").agg(first("click"), first("purchase"))


@query("select conv_id, turn from (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as c from conversations) where c <= 2")
def prefix_before_nth(t: Tables) -> DataFrame:
    return op.prefix_before(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", 2).select("conv_id", "turn")


@query("select conv_id, turn from (select *, coalesce(sum((role = 'user')::int) over (partition by conv_id order by turn desc), 0) as c from conversations) where c < 2 or (c = 2 and role = 'user')")
def tail_last_n_users(t: Tables) -> DataFrame:
    return op.tail_from(t.conversations, ["conv_id"], [F.desc("turn")], F.col("role") == "user", 2).select("conv_id", "turn")


@query(r"""with s as (select *, coalesce(sum((role = 'user')::int) over (partition by conv_id order by turn desc), 0) as c from conversations),
b as (select conv_id, turn, role, text, hex(encode(text)) as x, strlen(text) as n, (30 - coalesce(sum(case when role = 'assistant' then (strlen(text) + 3) // 4 else 0 end)
  over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint as l from s where c < 2 or (c = 2 and role = 'user')),
k as (select *, list_filter(range(2 * l, 2 * l - 4, -1), lambda p: substr(x, 2 * p + 1, 2) not between '80' and 'BF')[1] as h,
  list_filter(range(n - 2 * l, n - 2 * l + 4), lambda p: substr(x, 2 * p + 1, 2) not between '80' and 'BF')[1] as e from b where role <> 'assistant' or l > 0)
select conv_id, turn, case when role <> 'assistant' or n <= 4 * l then text
  else decode(unhex(substr(x, 1, 2 * h))) || '…' || (n - 4 * l + 3) // 4 || ' tokens truncated…' || decode(unhex(substr(x, 2 * e + 1))) end as text from k""")
def tail_budget(t: Tables) -> DataFrame:
    """The tail from the second last user row on, with at most 30 tokens of assistant text."""
    rows = op.tail_from(t.conversations, ["conv_id"], [F.desc("turn")], F.col("role") == "user", 2)
    return op.token_budget(rows, ["conv_id"], "turn", F.col("role") == "assistant", "text", 30).select("conv_id", "turn", "text")


@query("""select e.event_id, e.user_id from events e left join (select user_id, max(event_id) as m from events where event_type = 'purchase' group by 1) p on p.user_id = e.user_id
where m is null or e.event_id >= m""")
def suffix_since_marker(t: Tables) -> DataFrame:
    return op.since_last(t.events.select("event_id", "user_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "purchase").drop("event_type")


@query("""with l as (select doc_id, i as line, lower(list_extract(ls, i)) as x from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))),
a as (select doc_id, line as start, greatest(line, min(case when contains(x, 'the') then line end) over w, min(case when contains(x, 'tion') then line end) over w) as stop,
min(case when contains(x, 'the') then line end) over w as t1, min(case when contains(x, 'tion') then line end) over w as t2 from l
window w as (partition by doc_id order by line range between current row and 2 following)),
b as (select * from a where t1 is not null and t2 is not null)
select doc_id, start, stop from (select *, min(stop) over (partition by doc_id order by start rows between 1 following and unbounded following) as nx from b) where nx is null or nx > stop""")
def windowed_match(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    d = d.select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "x")
    return op.windows_with_all(d, ["doc_id"], ["the", "tion"], "line", "x", 3)


@query("""select conv_id, pair, min(turn) as first_turn, count(*) as n_messages, sum(strlen(text))::bigint as n_bytes from
(select *, greatest(sum((role = 'user')::int) over (partition by conv_id order by turn), 1) as pair from conversations where role <> 'system') group by 1, 2""")
def turn_pairs(t: Tables) -> DataFrame:
    c = op.segments(t.conversations.where("role <> 'system'"), ["conv_id"], ["turn"], F.col("role") == "user", "pair")
    return c.groupBy("conv_id", "pair").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_messages"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("""with e as (select user_id, event_id, event_type, (event_type = 'view')::int as turn, (event_type = 'error')::int as back from events),
s as (select *, sum(turn - back) over (partition by user_id order by event_id) as s from e),
m as (select *, least(back, coalesce(lag(s) over w, 0) - least(coalesce(min(s) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0), 0)) as takes from s window w as (partition by user_id order by event_id)),
r as (select *, sum(takes - turn) over (partition by user_id order by event_id desc) as z from m),
o as (select *, coalesce(lag(z) over w, 0) - least(coalesce(min(z) over (partition by user_id order by event_id desc rows between unbounded preceding and 1 preceding), 0), 0) as owed from r window w as (partition by user_id order by event_id desc))
select user_id, event_id, event_type from o where back = 0 and owed = 0""")
def rollback_fold(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type")
    back = F.when(F.col("event_type") == "error", F.lit(1))
    return op.rolled_back(e, "user_id", "event_id", F.col("event_type") == "view", back)
