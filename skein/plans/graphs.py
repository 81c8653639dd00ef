"""Queries of graphs. The spawn tree: customer k hangs below k // 4, open unless k is a multiple of 7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import filters
from skein.operators import graph as op
from skein.plans.registry import Tables, query

_EDGES = "(select c_custkey // 4 as parent, c_custkey as child, case when c_custkey % 7 = 0 then 'closed' else 'open' end as status from customer where c_custkey > 0)"


def _tree(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey > 0").selectExpr("c_custkey div 4 as parent", "c_custkey as child", "case when c_custkey % 7 = 0 then 'closed' else 'open' end as status")


@query("select child from {e} where parent = 5 and status = 'open' order by child", e=_EDGES)
def graph_children(t: Tables) -> DataFrame:
    return op.children(_tree(t), 5, "open")


@query("""with recursive d(child, depth) as (select child, 1 from {e} where parent = 2 and status = 'open' union all
select e.child, d.depth + 1 from d join {e} e on e.parent = d.child where e.status = 'open') select child, min(depth) as depth from d group by 1""", e=_EDGES)
def graph_descendants(t: Tables) -> DataFrame:
    return op.descendants(t.spark, _tree(t), 2, "open")


@query("""with recursive d(child) as (select child from {e} where parent = 3 union all select e.child from d join {e} e on e.parent = d.child) select distinct child::varchar as id from d order by id""", e=_EDGES)
def graph_descendants_flat(t: Tables) -> DataFrame:
    return op.descendants(t.spark, _tree(t), 3).select(F.col("child").cast("string").alias("id")).orderBy("id")


@query("""with recursive d(child) as (select child from {e} where parent = 3 union all select e.child from d join {e} e on e.parent = d.child)
select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_custkey in (select child from d) order by o_orderkey desc limit 40""", e=_EDGES)
def thread_list_relation(t: Tables) -> DataFrame:
    below = op.descendants(t.spark, _tree(t), 3).select(F.col("child").alias("o_custkey"))
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return filters.exists(rows, below, ["o_custkey"]).orderBy(F.desc("o_orderkey")).limit(40).select("o_orderkey", "o_custkey")


@query("""with e as (select distinct l_partkey, -l_suppkey - 1 as s from lineitem) select coalesce(a.node, b.node) as node, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from
(select l_partkey as node, count(*) as n_out from e group by 1) a full join (select s as node, count(*) as n_in from e group by 1) b on a.node = b.node""")
def graph_degree(t: Tables) -> DataFrame:
    return op.degrees(t.lineitem.select("l_partkey", (-F.col("l_suppkey") - 1).alias("s")), "l_partkey", "s")


def _blocks(t: Tables) -> tuple[DataFrame, DataFrame]:
    blocks = t.nation.select(F.col("n_name").alias("block"), F.when(F.col("n_nationkey") == 0, "OB").otherwise("FB").alias("kind"))
    calls = t.nation.selectExpr("n_name as caller", "n_nationkey as k").selectExpr("caller", "k * 2 + 1 as a", "k * 2 + 2 as b").selectExpr("caller", "explode(array(a, b)) as c")
    names = t.nation.selectExpr("n_nationkey as c", "n_name as callee")
    return blocks, calls.join(names, "c", "left").select("caller", F.coalesce("callee", F.concat(F.lit("missing_"), "c")).alias("callee"))


_CALLS = """c as (select n.n_name as caller, coalesce(m.n_name, 'missing_' || x) as callee from (select *, unnest([n_nationkey * 2 + 1, n_nationkey * 2 + 2]) as x from nation) n left join nation m on m.n_nationkey = x)"""


@query("with {c} select callee as name from c where callee not in (select n_name from nation) group by 1", c=_CALLS)
def graph_unresolved(t: Tables) -> DataFrame:
    return op.diagnostics(*_blocks(t)).where("issue = 'unresolved'").select("name")


@query("with {c} select n_name as name from nation where n_nationkey <> 0 and n_name not in (select callee from c)", c=_CALLS)
def graph_orphans(t: Tables) -> DataFrame:
    return op.diagnostics(*_blocks(t)).where("issue = 'orphan'").select("name")


@query("""with recursive {c}, p(path, last) as (select [n_name], n_name from nation where n_name in (select caller from c) and n_name not in (select callee from c) union all
select list_append(p.path, c.callee), c.callee from p join c on c.caller = p.last where not list_contains(p.path, c.callee))
select array_to_string(path, '>') as path from p where len(path) > 1""", c=_CALLS)
def graph_root_paths(t: Tables) -> DataFrame:
    return op.root_paths(t.spark, _blocks(t)[1]).select(F.array_join("path", ">").alias("path"))


@query("""select e.event_id, e.user_id, coalesce(s.event_id, -1) as target from events e left join (select user_id, min(event_id) as event_id from events where event_type = 'signup' group by 1) s
on s.user_id = e.user_id where e.event_type = 'error'""")
def edge_resolve(t: Tables) -> DataFrame:
    target = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("target"))
    out = t.events.where("event_type = 'error'").select("event_id", "user_id").join(target, "user_id", "left")
    return out.select("event_id", "user_id", F.coalesce("target", F.lit(-1)).alias("target"))


@query("""select 'nation:' || n_nationkey as source, 'IN' as kind, 'region:' || n_regionkey as target from nation union all select 'customer:' || c_custkey, 'LIVES_IN', 'nation:' || c_nationkey from customer""")
def kg_build(t: Tables) -> DataFrame:
    ent = lambda d, kind, k, n: d.select(F.concat(F.lit(f"{kind}:"), k).alias("id"), F.lit(kind).alias("kind"), F.col(n).alias("name"), F.lit(0).alias("seq"))
    rel = lambda d, a, x, kind, b, y: d.select(F.concat(F.lit(f"{a}:"), x).alias("source"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{b}:"), y).alias("target"))
    nodes = [ent(t.region, "region", "r_regionkey", "r_name"), ent(t.nation, "nation", "n_nationkey", "n_name"), ent(t.customer, "customer", "c_custkey", "c_name")]
    edges = [rel(t.nation, "nation", "n_nationkey", "IN", "region", "n_regionkey"), rel(t.customer, "customer", "c_custkey", "LIVES_IN", "nation", "c_nationkey")]
    return op.build(nodes, edges)[1]


@query("select 'IN' as relation, 'region:' || n_regionkey as id, 'region' as kind, r_name as name from nation join region on r_regionkey = n_regionkey where n_nationkey = 7")
def kg_related(t: Tables) -> DataFrame:
    n = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("source"), F.lit("IN").alias("kind"), F.concat(F.lit("region:"), "n_regionkey").alias("target"))
    r = t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    return op.related(r, n, "nation:7", "IN")
