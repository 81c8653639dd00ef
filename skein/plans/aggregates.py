"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import aggregates as op
from skein.operators import paging
from skein.plans.registry import Tables, query


@query("""select o_orderpriority, count(*) as total, count(*) filter (where o_orderstatus = 'O') as pending,
count(*) filter (where o_orderstatus = 'P') as running, count(*) filter (where o_orderstatus = 'F') as completed,
count(*) filter (where o_orderstatus = 'X') as failed from orders group by o_orderpriority""")
def progress_counts(t: Tables) -> DataFrame:
    return op.pivot_counts(t.orders, ["o_orderpriority"], "o_orderstatus", {"pending": "O", "running": "P", "completed": "F", "failed": "X"})


@query("select coalesce(max(o_orderkey), 0) as max_key, coalesce(max(o_totalprice), 0) as max_price, coalesce(max(case when o_orderstatus = 'X' then o_orderkey end), 0) as none from orders")
def global_max(t: Tables) -> DataFrame:
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    return t.orders.agg(zero("o_orderkey").alias("max_key"), zero("o_totalprice").alias("max_price"), zero(F.expr("case when o_orderstatus = 'X' then o_orderkey end")).alias("none"))


@query("select user_id, greatest(5000, max(event_id)) as watermark from events group by user_id")
def watermark_max(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.greatest(F.lit(5000).cast("long"), F.max("event_id")).alias("watermark"))


@query("select nullif(l_returnflag, 'N') as flag, l_linestatus, count(*) as n from lineitem group by 1, 2 order by 1 nulls first, 2")
def group_count(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_linestatus")
    return d.groupBy("flag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("flag"), "l_linestatus")


@query("select p_brand, count(*) as n from part where p_size > 10 group by 1 order by n desc, p_brand")
def group_count_desc(t: Tables) -> DataFrame:
    return t.part.where("p_size > 10").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey, l_partkey) as n_same from lineitem")
def dup_annotate(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.expr("count(*) over (partition by l_orderkey, l_partkey)").alias("n_same"))


@query("select event_type, props, sum(event_id % 5) as total from events group by 1, 2")
def metric_counter(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", "props").agg(F.sum(F.col("event_id") % 5).cast("long").alias("total"))


_CASES = " ".join(f"when value <= {b} then {i}" for i, b in enumerate(op.MS_BOUNDS))


@query("select event_type, case {cases} else {over} end as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", cases=_CASES, over=str(len(op.MS_BOUNDS)))
def metric_histogram(t: Tables) -> DataFrame:
    return op.histogram(t.events, ["event_type"], "value", op.MS_BOUNDS).withColumn("total", F.round("total", 4))


@query("""select user_id, count(*) filter (where event_type = 'click') as tool_calls, coalesce(round(sum(value) filter (where event_type = 'click')), 0)::bigint as tool_ms,
count(*) filter (where event_type = 'view') as api_calls, coalesce(round(sum(value) filter (where event_type = 'view')), 0)::bigint as api_ms,
count(*) filter (where event_type = 'error') as error_calls from events group by user_id""")
def runtime_summary(t: Tables) -> DataFrame:
    fields = {"tool_calls": ("click", "count"), "tool_ms": ("click", "sum"), "api_calls": ("view", "count"), "api_ms": ("view", "sum"), "error_calls": ("error", "count")}
    return op.summary(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_type", "value", fields, order=["event_id"])


@query("""select user_id, sum(event_id % 7)::bigint as calls, coalesce(arg_max(gauge, event_id) filter (where gauge > 0), 0) as gauge
from (select *, case when event_type = 'error' then event_id % 3 else 0 end as gauge from events) group by user_id""")
def summary_merge(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", (F.col("event_id") % 7).alias("calls"), F.expr("case when event_type = 'error' then event_id % 3 else 0 end").alias("gauge"))
    return op.merge_summaries(e, ["user_id"], "event_id", ["calls"], ["gauge"])


@query("select event_type, user_id, arg_max(value, event_id) as value from events group by 1, 2")
def gauge_last(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("""select source, lang, count(*) as n_before, sum(strlen(text))::bigint as bytes_before, count(*) filter (where n_chars > 500) as n_after,
coalesce(sum(strlen(text)) filter (where n_chars > 500), 0)::bigint as bytes_after from documents group by 1, 2""")
def filter_measure(t: Tables) -> DataFrame:
    return op.measure(t.documents, ["source", "lang"], F.octet_length("text"), F.col("n_chars") > 500)


@query("""select o_orderkey, round(spent, 4) as spent, spent >= 500000 as exhausted, (500000 - spent <= 400000)::int + (500000 - spent <= 250000)::int + (500000 - spent <= 0)::int as crossed
from (select o_orderkey, sum(greatest(o_totalprice, 0) * 0.5 + greatest(o_totalprice - 1000, 0) * 0.25) over (partition by o_custkey order by o_orderkey) as spent from orders)""")
def weighted_budget(t: Tables) -> DataFrame:
    cost = F.greatest("o_totalprice", F.lit(0)) * 0.5 + F.greatest(F.col("o_totalprice") - 1000, F.lit(0)) * 0.25
    out = op.budget(t.orders, ["o_custkey"], ["o_orderkey"], cost, 500000, [400000, 250000, 0])
    return out.select("o_orderkey", F.round("spent", 4).alias("spent"), "exhausted", "crossed")


@query("""select w as term, count(*) as n_docs from (select distinct doc_id, unnest(string_split(lower(text), ' ')) as w from documents) where w <> '' group by 1 having count(*) > 1""")
def doc_freq(t: Tables) -> DataFrame:
    d = t.documents.select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("term"))
    return d.where("term <> ''").groupBy("term").agg(F.count("*").alias("n_docs")).where("n_docs > 1")


@query("""select rule, severity, count(*) as n from (select 'short' as rule, 'warning' as severity from documents where n_chars < 300
union all select 'long', 'info' from documents where n_chars > 5000 union all select 'no_stop', 'error' from documents where not contains(text, '.')) group by 1, 2""")
def rule_counts(t: Tables) -> DataFrame:
    rules = F.array_compact(F.array(
        F.when(F.col("n_chars") < 300, F.struct(F.lit("short").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(F.col("n_chars") > 5000, F.struct(F.lit("long").alias("rule"), F.lit("info").alias("severity"))),
        F.when(~F.contains("text", F.lit(".")), F.struct(F.lit("no_stop").alias("rule"), F.lit("error").alias("severity"))),
    ))
    return t.documents.select(F.explode(rules).alias("r")).groupBy("r.rule", "r.severity").agg(F.count("*").alias("n"))


@query("select user_id, string_agg(event_type, ',' order by f) as types from (select user_id, event_type, min(event_id) as f from events group by 1, 2) group by 1")
def ordered_distinct(t: Tables) -> DataFrame:
    return op.ordered_distinct(t.events, ["user_id"], "event_id", "event_type", "types").withColumn("types", F.array_join("types", ","))


@query("""select user_id, coalesce(string_agg(event_id::varchar, ',' order by event_id) filter (where event_type = 'view'), '') as "view",
coalesce(string_agg(event_id::varchar, ',' order by event_id) filter (where event_type = 'click'), '') as click from events group by user_id""")
def partition_collect(t: Tables) -> DataFrame:
    out = op.partitioned(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", ["view", "click"])
    return out.select("user_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("view", "click")])


@query("""select c_nationkey, arg_min(c_name, c_custkey) filter (where c_acctbal > 0) as c_name, arg_min(c_acctbal, c_custkey) as c_acctbal,
array_to_string(list_sort(list(distinct c_mktsegment)), ',') as c_mktsegment from customer group by 1""")
def coalesce_group(t: Tables) -> DataFrame:
    c = t.customer.withColumn("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    out = op.coalesce_group(c, ["c_nationkey"], "c_custkey", ["c_name", "c_acctbal"], "c_mktsegment")
    return out.withColumn("c_mktsegment", F.array_join("c_mktsegment", ","))


@query("select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as n from lineitem) where n = 1")
def argmax_group(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return paging.best_of(d, ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber"])


@query("""with g as (select o_custkey, max(o_orderdate) as latest, count(*) as n_in_group from orders group by 1 order by o_custkey = 7 desc, latest desc, o_custkey limit 8)
select o_custkey, o_orderkey, place, n_in_group from (select o.*, g.n_in_group, row_number() over (partition by o.o_custkey order by o_orderdate desc, o_orderkey) as place
from orders o join g on g.o_custkey = o.o_custkey) where place <= 5""")
def group_recency(t: Tables) -> DataFrame:
    out = op.group_recency(t.orders, "o_custkey", "o_orderdate", "o_orderkey", 7, 8, 5)
    return out.select("o_custkey", "o_orderkey", "place", "n_in_group")


@query("""select lower(p_name) as name, count(*) as n, count(distinct p_name) as n_exact from part where p_brand <> 'Brand#11' group by 1""")
def name_counts(t: Tables) -> DataFrame:
    kept = t.part.where("p_brand <> 'Brand#11'").groupBy("p_name").agg(F.count("*").alias("n"))
    return kept.groupBy(F.lower("p_name").alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("n_exact"))
