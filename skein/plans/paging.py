"""Queries of pages, sorts and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import ordered
from skein.operators import paging as op
from skein.plans.registry import Tables, query
from skein.scratch import Scratch


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def order_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey > 100 or (l_orderkey = 100 and l_linenumber >= 2) order by 1, 2 limit 31")
def keyset_asc(t: Tables) -> DataFrame:
    return op.keyset(t.lineitem.select("l_orderkey", "l_linenumber"), [("l_orderkey", True), ("l_linenumber", True)], (100, 2), 30, include=True)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey < 100 or (l_orderkey = 100 and l_linenumber < 2) order by 1 desc, 2 desc limit 31")
def keyset_desc(t: Tables) -> DataFrame:
    return op.keyset(t.lineitem.select("l_orderkey", "l_linenumber"), [("l_orderkey", False), ("l_linenumber", False)], (100, 2), 30)


@query("select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1996-01-01' or (o_orderdate = timestamp '1996-01-01' and o_orderkey < 500) order by o_orderdate desc, o_orderkey desc limit 51")
def keyset_ts_id(t: Tables) -> DataFrame:
    order = [("o_orderdate", False), ("o_orderkey", False)]
    return op.keyset(t.orders.select("o_orderkey", "o_orderdate"), order, ("1996-01-01 00:00:00", 500), 50)


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25 offset 50")
def offset_page(t: Tables) -> DataFrame:
    return op.offset_page(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 50, 25)


@query("""select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as n, sum(strlen(text)) over (partition by conv_id order by turn desc) as b from conversations)
where n = 1 or (n <= 3 and b <= 1200)""")
def batch_rows_bytes(t: Tables) -> DataFrame:
    return op.batch_newest(t.conversations, ["conv_id"], "turn", F.octet_length("text"), 3, 1200).select("conv_id", "turn")


@query("select s_suppkey, s_acctbal > 5000 as pinned, lower(s_name) as label, row_number() over (order by s_acctbal > 5000 desc, lower(s_name), s_suppkey) as place from supplier")
def multi_sort(t: Tables) -> DataFrame:
    d = t.supplier.select("s_suppkey", (F.col("s_acctbal") > 5000).alias("pinned"), F.lower("s_name").alias("label"))
    out = ordered.numbered_all(Scratch(t.spark), d, [F.desc("pinned"), F.asc("label"), F.asc("s_suppkey")], "place")
    return out.select("s_suppkey", "pinned", "label", "place")


@query("select c_custkey, c_name from customer order by regexp_extract(c_name, '^(\\D*)', 1), regexp_extract(c_name, '^\\D*(\\d+)', 1)::bigint desc limit 30")
def natural_sort(t: Tables) -> DataFrame:
    head, number, whole = op.natural_key(F.col("c_name"))
    return t.customer.select("c_custkey", "c_name").orderBy(head, F.desc(number), whole).limit(30)


@query("select source, lang, doc_id from (select *, row_number() over (partition by source, lang order by n_chars > 1000 desc, n_chars desc, doc_id) as n from documents) where n = 1")
def dedup_best(t: Tables) -> DataFrame:
    d = t.documents.select("source", "lang", "doc_id", "n_chars")
    return op.best_of(d, ["source", "lang"], [F.desc(F.col("n_chars") > 1000), F.desc("n_chars"), "doc_id"]).drop("n_chars")


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as n from lineitem) where n = 1")
def dedup_first(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return op.best_of(d, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("select doc_id, (select count(*) from documents) as total from documents order by n_chars desc, doc_id limit 64")
def topk_with_total(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    return op.with_total(d, [F.desc("n_chars"), "doc_id"], 64).drop("n_chars")


@query("""select * from (select o_custkey, count(*) as uses, max(o_orderdate) as last_use from orders group by 1 having max(o_orderdate) >= timestamp '1997-01-01'
order by uses desc, last_use desc, o_custkey limit 40) order by o_custkey""")
def rank_select(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("uses"), F.max("o_orderdate").alias("last_use")).where("last_use >= timestamp_ntz'1997-01-01 00:00:00'")
    return g.orderBy(F.desc("uses"), F.desc("last_use"), "o_custkey").limit(40).orderBy("o_custkey")


@query("select p_partkey, p_size * 2 + length(p_name) as score from part order by score desc, p_name, p_partkey limit 50")
def score_topk(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", "p_name", (F.col("p_size") * 2 + F.length("p_name")).cast("long").alias("score"))
    return d.orderBy(F.desc("score"), "p_name", "p_partkey").limit(50).drop("p_name")


@query("""select event_id, user_id from events where ts > timestamp '2024-01-10' and user_id not in (select user_id from events where event_type = 'signup' and event_id < 300)
order by ts desc, event_id limit 50""")
def recent_topk(t: Tables) -> DataFrame:
    ledger = t.events.where("event_type = 'signup' and event_id < 300").select("user_id").distinct()
    e = t.events.where("ts > timestamp_ntz'2024-01-10 00:00:00'").select("event_id", "user_id", "ts")
    return e.join(ledger, "user_id", "left_anti").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id")


@query("select s_suppkey, s_name from supplier order by s_name = 'none' desc, s_nationkey = 7 desc, s_acctbal desc, s_suppkey desc limit 1")
def priority_pick(t: Tables) -> DataFrame:
    order = [F.desc(F.col("s_name") == "none"), F.desc(F.col("s_nationkey") == 7), F.desc("s_acctbal"), F.desc("s_suppkey")]
    return t.supplier.orderBy(*order).limit(1).select("s_suppkey", "s_name")


@query("""select o_orderkey, case when n = 1 then '1' when n <= 5 then '2_5' when n <= 10 then '6_10' when n <= 20 then '11_20' else 'miss' end as bucket,
case when o_custkey % 4 = 0 then 0 else n * 10000 // (o_custkey % 4) end as bps from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)""")
def rank_bucket(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", "o_custkey", F.expr("row_number() over (partition by o_custkey order by o_orderkey)").alias("n"))
    return d.select("o_orderkey", op.rank_bucket(F.col("n")).alias("bucket"), op.basis_points("n", "(o_custkey % 4)").cast("long").alias("bps"))
