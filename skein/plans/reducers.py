"""Queries of folds and incremental loads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import dml
from skein.operators import reducers as op
from skein.plans.registry import Tables, query


@query("""select user_id, arg_min(props, event_id) filter (where event_type = 'click') as title, arg_max(event_type, event_id) as last_kind,
arg_max(value, event_id) filter (where event_type = 'purchase') as last_value, greatest(max((event_id % 50) - 10), 0) as tokens from events group by user_id""")
def metadata_fold(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return op.fold(
        t.events, ["user_id"], "event_id", {"title": F.when(kind == "click", F.col("props"))},
        {"last_kind": kind, "last_value": F.when(kind == "purchase", F.col("value"))}, {"tokens": (F.col("event_id") % 50) - 10},
    )


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'old ' || o_orderkey else 'new' end as title, coalesce(case when o_orderkey % 2 = 0 then o_orderpriority end, case when o_orderkey % 3 = 0 then 'kept' end) as branch from orders""")
def reconcile(t: Tables) -> DataFrame:
    new = t.orders.select("o_orderkey", F.lit("new").alias("title"), F.expr("case when o_orderkey % 2 = 0 then o_orderpriority end").alias("branch"))
    old = t.orders.select("o_orderkey", F.concat(F.lit("old "), "o_orderkey").alias("title"), F.expr("case when o_orderkey % 3 = 0 then 'kept' end").alias("branch"), (F.col("o_orderkey") % 5 == 0).alias("titled"))
    return op.reconcile(new, old, "o_orderkey", ["branch"], {"title": "titled"})


@query("""select c_custkey, array_to_string(list_filter([case when c_acctbal > 2500 then 'c_acctbal' end, case when c_mktsegment = 'BUILDING' then 'c_mktsegment' end], lambda x: x is not null), ',') as changed from customer""")
def row_diff(t: Tables) -> DataFrame:
    a = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    b = a.select("c_custkey", F.least("c_acctbal", F.lit(2500.0)).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_nationkey")
    return op.row_diff(a, b, ["c_custkey"], ["c_acctbal", "c_mktsegment", "c_nationkey"]).withColumn("changed", F.array_join("changed", ","))


@query("select o_orderkey, o_orderstatus from orders where o_orderkey > 4000 order by o_orderkey limit 200")
def incremental_since(t: Tables) -> DataFrame:
    return op.since(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 4000, 200)


_SPANS = """s as (select user_id, row_number() over (partition by user_id order by event_id) as n, event_id as started from events where event_type = 'view'),
e as (select user_id, row_number() over (partition by user_id order by event_id) as n, event_id as ended from events where event_type = 'click')"""


def _spans(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = F.expr("row_number() over (partition by user_id order by event_id)").alias("n")
    get = lambda kind, name: t.events.where(f"event_type = '{kind}'").select("user_id", n, F.col("event_id").alias(name))
    return get("view", "started"), get("click", "ended")


@query("with {s} select s.user_id, s.n, started, ended, case when ended is null then 'open' else 'closed' end as state from s left join e on e.user_id = s.user_id and e.n = s.n", s=_SPANS)
def span_pairing(t: Tables) -> DataFrame:
    return op.pair_spans(*_spans(t), ["user_id", "n"])


@query("""with {s}, x as (select user_id, max(event_id) as turn_end from events where event_type = 'purchase' group by 1)
select s.user_id, s.n, started, coalesce(ended, turn_end) as ended, case when ended is not null then 'closed' when turn_end is not null then 'with_turn' else 'open' end as state
from s left join e on e.user_id = s.user_id and e.n = s.n left join x on x.user_id = s.user_id""", s=_SPANS)
def close_open_spans(t: Tables) -> DataFrame:
    ends = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("turn_end"))
    return op.pair_spans(*_spans(t), ["user_id", "n"], ends)


@query("""select source, target, count(*) as n from (select event_type as source, lead(event_type) over (partition by user_id order by event_id) as target from events) where target is not null group by 1, 2""")
def transition_matrix(t: Tables) -> DataFrame:
    return op.transitions(t.events, ["user_id"], "event_id", "event_type")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'up_to_date' when o_orderkey % 3 = 0 then 'running' when o_orderkey % 5 = 0 then 'backoff' else 'claimed' end as outcome from orders""")
def claim_outcome(t: Tables) -> DataFrame:
    jobs = t.orders.selectExpr("o_orderkey", "10 as input_watermark", "case when o_orderkey % 4 = 0 then 10 end as done_watermark", "case when o_orderkey % 3 = 0 then 200 end as lease_until", "case when o_orderkey % 5 = 0 then 150 end as retry_at")
    return op.claim(jobs, 100).select("o_orderkey", "outcome")


@query("select doc_id, sha256(text) as hash from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0)")
def incremental_hash(t: Tables) -> DataFrame:
    ledger = t.documents.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash"))
    return op.not_imported(t.documents.select("doc_id", "text"), ledger, F.col("text")).select("doc_id", "hash")


@query("""select conv_id, coalesce(arg_max(substr(text, 1, 20), turn) filter (where role = 'system'), arg_min(substr(text, 1, 20), turn) filter (where role = 'user')) as title,
max(turn) as last_turn from conversations group by 1 having count(*) filter (where role = 'user') > 0""")
def session_summary(t: Tables) -> DataFrame:
    head = F.substring("text", 1, 20)
    g = op.fold(t.conversations, ["conv_id"], "turn", {"said": F.when(F.col("role") == "user", head)}, {"named": F.when(F.col("role") == "system", head)}, {"last_turn": F.col("turn")})
    return g.where("said is not null").select("conv_id", F.coalesce("named", "said").alias("title"), "last_turn")


@query("""with e as (select *, coalesce(sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as dead from events)
select user_id, count(*) filter (where dead = 0) as accepted, count(*) filter (where dead > 0) as rejected from e group by 1""")
def late_reject(t: Tables) -> DataFrame:
    e = dml.accept_until(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "error", "ok")
    return e.groupBy("user_id").agg(F.count(F.when(F.col("ok"), 1)).alias("accepted"), F.count(F.when(~F.col("ok"), 1)).alias("rejected"))


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def stream_dedup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("select event_id, event_type from events where event_id > (select max(event_id) from events) - 50 order by event_id")
def tail_backfill(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type").orderBy(F.desc("event_id")).limit(50).orderBy("event_id")


@query("select c_custkey, 'Dear ' || c_name as letter, case when c_custkey % 97 = 0 then 'failed' else 'completed' end as status from (select c_custkey, case when c_custkey % 97 = 0 then null else c_name end as c_name from customer)")
def map_job(t: Tables) -> DataFrame:
    def letters(b: pd.DataFrame) -> pd.DataFrame:
        if b["c_name"].isna().any():
            raise ValueError("no name")
        return pd.DataFrame({"c_custkey": b["c_custkey"], "letter": "Dear " + b["c_name"]})

    rows = t.customer.select("c_custkey", F.expr("case when c_custkey % 97 = 0 then null else c_name end").alias("c_name"))
    return op.map_job(rows, letters, "c_custkey long, letter string").select("c_custkey", "letter", "status")


@query("""with o as (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events where event_id % 2 = 0), n as (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events where event_id % 2 = 1)
select n.user_id, n.event_id, o.event_id as old_seq from n left join o using (user_id, event_type, k)""")
def snapshot_match(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type")
    return op.snapshot_match(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id", "event_type")
