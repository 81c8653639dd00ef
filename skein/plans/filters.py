"""Queries of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import filters as op
from skein.operators import paging
from skein.plans.registry import Tables, query


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_orderpriority = '1-URGENT'")
def filter_optional(t: Tables) -> DataFrame:
    keep = op.optional(o_orderstatus=["F", "O"], o_orderpriority="1-URGENT", o_custkey=None)
    return t.orders.where(keep).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""select event_id, user_id, event_type, value from (select *, case when user_id % 7 = 0 then null else user_id end as th from events)
where event_type in ('error', 'purchase') and ts >= timestamp '2024-01-05' and (props like '%1%' or props like '%2%')
and (th in (3, 5, 8, 13, 21) or th is null) and event_id > 100 order by event_id desc limit 60""")
def log_query(t: Tables) -> DataFrame:
    e = t.events.withColumn("thread_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    out = op.log_filter(
        e, kinds=["error", "purchase"], since="2024-01-05 00:00:00", contains={"props": ["1", "2"]}, threads=[3, 5, 8, 13, 21],
        threadless=True, after=100, limit=60, kind="event_type", key="event_id",
    )
    return out.select("event_id", "user_id", "event_type", "value")


@query("""select o.o_orderkey, coalesce(c.c_name, 'customer ' || o.o_custkey) as title, o.o_orderstatus, o.o_orderdate
from orders o left join customer c on c.c_custkey = o.o_custkey and c.c_custkey % 10 <> 0
where o.o_orderstatus <> 'P' and o.o_orderpriority <> '' and (o.o_orderdate, -o.o_orderkey) < (timestamp '1997-06-01', 0)
order by o.o_orderdate desc, o.o_orderkey desc limit 26""")
def thread_list(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus <> 'P' and o_orderpriority <> ''")
    page = paging.keyset(rows, [("o_orderdate", False), ("o_orderkey", False)], ("1997-06-01 00:00:00", 2**60), 25)
    names = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = page.join(names, "o_custkey", "left")
    return out.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("customer "), "o_custkey")).alias("title"), "o_orderstatus", "o_orderdate")


@query("select doc_id, lang from documents where contains(lower(text), 'the thin')")
def text_contains_ci(t: Tables) -> DataFrame:
    return t.documents.where(op.contains_ci(F.col("text"), "The THIN")).select("doc_id", "lang")


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)")
def exists_semi(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return op.exists(t.customer.select("c_custkey"), big, ["c_custkey"])


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def not_exists_anti(t: Tables) -> DataFrame:
    return op.exists(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], negate=True)


#: Which kinds are stored in which mode of history.
POLICY = [("signup", "paged", True), ("purchase", "paged", True), ("purchase", "whole", True), ("click", "whole", True), ("view", "paged", False), ("error", "whole", False)]


@query("""select event_id, event_type, mode from (select event_id, event_type, case when user_id % 2 = 0 then 'paged' else 'whole' end as mode from events)
where (event_type, mode) in (('signup', 'paged'), ('purchase', 'paged'), ('purchase', 'whole'), ('click', 'whole'))""")
def policy_filter(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", F.expr("case when user_id % 2 = 0 then 'paged' else 'whole' end").alias("mode"))
    table = t.spark.createDataFrame(POLICY, "event_type string, mode string, keep boolean")
    return op.by_policy(e, table, ["event_type", "mode"]).select("event_id", "event_type", "mode")


@query("select conv_id, turn, role from conversations where role <> 'system' and role in ('user', 'assistant')")
def role_filter(t: Tables) -> DataFrame:
    return t.conversations.where(F.col("role").isin("user", "assistant") & (F.col("role") != "system")).select("conv_id", "turn", "role")


@query("""select event_id, rule_id from events join (values (1, 'click', '"k": [0-9]}'), (2, 'click', '1'), (3, 'error', null), (4, 'view', '^x')) r(rule_id, kind, pattern)
on event_type = kind and (pattern is null or regexp_matches(props, pattern))""")
def rule_match(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(1, "click", '"k": [0-9]}'), (2, "click", "1"), (3, "error", None), (4, "view", "^x"), (2, "click", "1")], "rule_id int, kind string, pattern string")
    return op.rule_matches(t.events.select("event_id", F.col("event_type").alias("kind"), "props"), rules, "props").select("event_id", "rule_id")


@query("select user_id, count(*) as n_events from events where ('0x' || substr(md5(user_id::varchar), 1, 8))::bigint % 100 < 10 group by 1")
def sample_by_key(t: Tables) -> DataFrame:
    return op.sample_keys(t.events, "user_id", 10).groupBy("user_id").agg(F.count("*").alias("n_events"))


@query("""select event_id, target, level from (select event_id, case event_type when 'view' then 'hyper_util::pool' when 'signup' then 'log' when 'click' then 'rmcp::service' else 'app' end as target,
case user_id % 3 when 0 then 'DEBUG' when 1 then 'info' else 'error' end as level from events) where target = 'app' or (target = 'hyper_util::pool' and level = 'error') or (target = 'rmcp::service' and level <> 'DEBUG')""")
def ingest_filter(t: Tables) -> DataFrame:
    target = F.expr("case event_type when 'view' then 'hyper_util::pool' when 'signup' then 'log' when 'click' then 'rmcp::service' else 'app' end")
    level = F.expr("case user_id % 3 when 0 then 'DEBUG' when 1 then 'info' else 'error' end")
    e = t.events.select("event_id", target.alias("target"), level.alias("level"))
    return e.where(op.ingested(F.col("target"), F.col("level")))
