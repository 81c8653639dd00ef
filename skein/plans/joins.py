"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import filters, joins, ordered
from skein.plans.registry import Tables, query


@query("select o_orderkey, l_linenumber, o_orderstatus, l_linestatus from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def join_inner(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")
    return o.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus"), "o_orderkey")


@query("""select c.conv_id, c.turn, c.role from conversations c join (select conv_id, max(turn) filter (where role = 'assistant') as final
from conversations group by conv_id) p on p.conv_id = c.conv_id and p.final = c.turn""")
def join_pointer(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role")
    final = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turn"))
    return c.join(final, ["conv_id", "turn"])


@query("""select conv_id, min(turn) filter (where role = 'user') as first_user, max(turn) filter (where role = 'assistant') as final_agent,
arg_min(strlen(text), turn) filter (where role = 'user') as first_user_bytes from conversations group by conv_id""")
def first_last_per_group(t: Tables) -> DataFrame:
    user = F.col("role") == "user"
    return t.conversations.groupBy("conv_id").agg(
        F.min(F.when(user, F.col("turn"))).alias("first_user"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("final_agent"),
        F.min_by(F.when(user, F.octet_length("text")), F.when(user, F.col("turn"))).cast("long").alias("first_user_bytes"),
    )


@query("""select c_custkey, coalesce(a.n_name, b.r_name, 'nation ' || c_nationkey) as name from customer
left join (select * from nation where n_nationkey % 2 = 0) a on a.n_nationkey = c_nationkey left join (select * from region) b on b.r_regionkey = c_nationkey""")
def join_fallback(t: Tables) -> DataFrame:
    first = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    second = t.region.select(F.col("r_regionkey").alias("c_nationkey"), F.col("r_name").alias("name"))
    out = joins.first_found(t.customer.select("c_custkey", "c_nationkey"), [first, second], "c_nationkey", "name", F.concat(F.lit("nation "), "c_nationkey"))
    return out.select("c_custkey", "name")


@query("""with a as (select s_nationkey as k, min(s_name) as name, list_sort(list(distinct 's' || s_suppkey)) as ids from supplier where s_nationkey < 15 group by 1),
b as (select c_nationkey as k, min(c_name) as name, list_sort(list(distinct 'c' || c_custkey)) as ids from customer where c_nationkey > 10 group by 1)
select coalesce(a.k, b.k) as nation, coalesce(a.name, b.name) as name, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.ids, []), coalesce(b.ids, [])))), ',') as ids
from a full join b on a.k = b.k""")
def merge_outer(t: Tables) -> DataFrame:
    a = t.supplier.where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_name").alias("name"), F.collect_set(F.concat(F.lit("s"), "s_suppkey")).alias("ids"))
    b = t.customer.where("c_nationkey > 10").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_name").alias("name"), F.collect_set(F.concat(F.lit("c"), "c_custkey")).alias("ids"))
    return joins.merge_outer(a, b, "nation", ("ids",)).withColumn("ids", F.array_join("ids", ","))


@query("select n_nationkey, n_name from nation where n_nationkey < 12 union all select distinct c_nationkey, 'unknown' from customer where c_nationkey >= 12")
def union_missing(t: Tables) -> DataFrame:
    have = t.nation.where("n_nationkey < 12").select("n_nationkey", "n_name")
    return joins.add_missing(have, t.customer.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", n_name=F.lit("unknown"))


@query("""with s as (select user_id, event_id as low, event_id + 40 as high from events where event_type = 'signup')
select e.event_id, e.user_id, s.low from events e join s on s.user_id = e.user_id and e.event_id between s.low and s.high where e.event_type = 'error'""")
def range_join(t: Tables) -> DataFrame:
    spans = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("low"), (F.col("event_id") + 40).alias("high"))
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id")
    return joins.range_join(errors, spans, "user_id", "event_id", "low", "high", 64).select("event_id", "user_id", "low")


@query("""select o_orderkey, coalesce(a.c_name, 'UNRESOLVED:CUSTOMER#' || o_custkey) as target from orders left join (select * from customer where c_custkey % 3 <> 0) a on a.c_custkey = o_custkey""")
def resolve_left(t: Tables) -> DataFrame:
    calls = t.orders.select("o_orderkey", F.lit("x").alias("caller"), F.concat(F.lit("CUSTOMER#"), "o_custkey").alias("name"))
    types = t.customer.where("c_custkey % 3 <> 0").select(F.lit("X").alias("owner"), F.concat(F.lit("customer#"), "c_custkey").alias("instance"), F.col("c_name").alias("type"))
    blocks = t.customer.select(F.col("c_name").alias("block"))
    return joins.resolve(calls, types, blocks).select("o_orderkey", "target")


@query("select n_nationkey, n_name, r_name from nation join region on r_regionkey = n_regionkey")
def broadcast_lookup(t: Tables) -> DataFrame:
    regions = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return t.nation.join(regions, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("""with r as (select *, row_number() over (partition by user_id order by event_id) as n from events),
m as (select a.event_id, b.n - a.n as d, b.value, row_number() over (partition by a.event_id order by abs(b.n - a.n), b.n) as k
from r a join r b on a.user_id = b.user_id and b.n between a.n - 2 and a.n + 2 and b.event_type = 'purchase' where a.event_type = 'error')
select event_id, d, value from m where k = 1""")
def nearest_row(t: Tables) -> DataFrame:
    e = ordered.numbered(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], "n")
    marks = e.where("event_type = 'purchase'").select("user_id", "n", "value")
    out = joins.nearest(e.where("event_type = 'error'").select("user_id", "n", "event_id"), marks, "user_id", "n")
    return out.select("event_id", (F.col("mark_at") - F.col("n")).alias("d"), "value")


@query("""select conv_id, turn, 0 as sub, 'assistant' as role from conversations where role = 'assistant' union all
select conv_id, turn + 1, 1, 'aborted' from conversations u where role = 'user' and not exists (select 1 from conversations a
where a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant')""")
def complete_unmatched(t: Tables) -> DataFrame:
    c = t.conversations
    calls = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("call"), (F.col("turn") + 1).alias("turn"))
    outputs = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("call"), "turn", "role")
    out = joins.complete_unmatched(calls, outputs, ["conv_id", "call"], "turn", role=F.lit("aborted"))
    return out.select("conv_id", "turn", "sub", "role")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O')")
def drop_orphans(t: Tables) -> DataFrame:
    keep = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.exists(t.lineitem.select("l_orderkey", "l_linenumber"), keep, ["l_orderkey"])


@query("""select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')
and c_custkey in (select o_custkey from orders where o_totalprice > 100000) order by c_name""")
def anti_semi_chain(t: Tables) -> DataFrame:
    k = F.col("o_custkey").alias("c_custkey")
    out = filters.exists(t.customer.select("c_custkey", "c_name"), t.orders.where("o_orderstatus = 'P'").select(k), ["c_custkey"], negate=True)
    return filters.exists(out, t.orders.where("o_totalprice > 100000").select(k), ["c_custkey"]).orderBy("c_name")


@query("select 'customer' as kind, c_custkey as id, c_name as name from customer where c_acctbal < 0 union all select 'supplier', s_suppkey, s_name from supplier order by 1, 2")
def union_all(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b).orderBy("kind", "id")


@query("select c_custkey from customer except select o_custkey from orders")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""select doc_id + 1000000 as path, doc_id as origin from documents where doc_id % 5 = 0 and doc_id % 10 <> 0""")
def rename_pairs(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    moved = d.where("doc_id % 5 = 0")
    baseline = d.select(F.col("doc_id").alias("path"))
    current = d.where("doc_id % 10 = 0 or doc_id % 5 <> 0").union(moved.selectExpr("doc_id + 1000000")).select(F.col("doc_id").alias("path"))
    origins = moved.select((F.col("doc_id") + 1000000).alias("path"), F.col("doc_id").alias("origin"))
    return joins.renames(baseline, current, origins)
