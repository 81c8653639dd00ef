"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import dml
from skein.plans.registry import Tables, query
from skein.scratch import Scratch
from skein.sources import files, numbered
from skein.sources.published import Store, backfill


@query("select c_custkey, c_name, c_mktsegment from customer")
def scan_audit(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("""select o.o_orderkey, o.o_orderstatus, l.l_linenumber, l.l_quantity from orders o
join lineitem l on l.l_orderkey = o.o_orderkey where o.o_orderkey = 7 and l.l_orderkey = 7 and l.l_linenumber = 1""")
def point_lookup(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderkey = 7").select("o_orderkey", "o_orderstatus")
    line = t.lineitem.where("l_orderkey = 7 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_quantity")
    return o.join(line, o.o_orderkey == line.l_orderkey).drop("l_orderkey")


@query("""select event_id, try_cast(json_extract_string(case when json_valid(p) then p end, '$.k') as bigint) as k from
(select event_id, case event_id % 4 when 0 then '' when 1 then '{bad' else props end as p from events) where json_valid(p) and trim(p) <> ''""")
def jsonl_permissive(t: Tables) -> DataFrame:
    damaged = F.expr("case event_id % 4 when 0 then '' when 1 then '{bad' else props end").alias("line")
    return files.jsonl_permissive(t.events.select("event_id", damaged), "line", "k bigint")


@query("select event_id, user_id, event_type from events where event_type <> 'error' order by event_id desc limit 40")
def latest_first(t: Tables) -> DataFrame:
    return files.newest_first(t.events.select("event_id", "user_id", "event_type"), "event_id", 40, F.col("event_type") != "error")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) - 1 as n from conversations) where n = 2")
def nth_row(t: Tables) -> DataFrame:
    return files.nth_row(t.conversations.select("conv_id", "turn", "role"), ["turn"], 2, ["conv_id"])


@query("select count(*) as n_rows, max(doc_id) as last_id from documents")
def row_count(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("n_rows"), F.max("doc_id").alias("last_id"))


@query("""select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as content,
len(string_split(text, chr(10))) > 4 as truncated from documents""")
def line_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", files.line_window(F.col("text"), 2, 3).alias("w")).select("doc_id", "w.*")


@query("""select user_id, event_type, value, event_id from
(select *, row_number() over (partition by user_id, event_type order by event_id desc) as n from events) where n = 1""")
def upsert_lww(t: Tables) -> DataFrame:
    old = t.events.where("event_id % 2 = 0").select("user_id", "event_type", "value", "event_id")
    new = t.events.where("event_id % 2 = 1").select("user_id", "event_type", "value", "event_id")
    return dml.upsert(old, new, ["user_id", "event_type"], "event_id")


@query("""select user_id, min(event_id) as first_ordinal, arg_max(event_type, event_id) as status,
arg_max(value, event_id) as value from events group by user_id""")
def upsert_first_last(t: Tables) -> DataFrame:
    e = t.events
    return dml.upsert_fields(e, ["user_id"], "event_id", first={"first_ordinal": "event_id"}, last={"status": "event_type", "value": "value"})


@query("""select o_orderkey, o_orderstatus from orders where o_orderkey % 3 = 0
union all select o_orderkey, 'new' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0""")
def insert_ignore(t: Tables) -> DataFrame:
    have = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus")
    come = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return dml.insert_ignore(have, come, ["o_orderkey"])


@query("""with e as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id
rows between unbounded preceding and 1 preceding) as dead from events)
select event_id, user_id, event_type, coalesce(dead, 0) = 0 as changed from e""")
def job_transitions(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type")
    return dml.accept_until(e, ["user_id"], "event_id", F.col("event_type") == "error", "changed")


@query("select 'orders' as tbl, count(*) as n from orders where o_custkey % 5 <> 0 union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 5 = 0)")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.where("o_custkey % 5 = 0").select("o_orderkey")
    left = dml.cascade_delete(gone, {"orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey")}, "o_orderkey")
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("tbl"), "n") for k, d in left.items()]
    return counts[0].unionByName(counts[1])


@query("""select l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber as item_id, l_linestatus as status,
case when l_linestatus = 'F' then strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') else '' end as completed_at,
case when l_returnflag = 'R' then '{"flag":"R"}' else '' end as result_json from lineitem""")
def job_export(t: Tables) -> DataFrame:
    d = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("completed_at"),
        F.when(F.col("l_returnflag") == "R", F.struct(F.col("l_returnflag").alias("flag"))).alias("result_json"),
    )
    return dml.csv_ready(d, keep=["l_orderkey", "l_linenumber"])


@query("""select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as rn,
sum(strlen(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as b,
sum(strlen(text)) over (partition by conv_id) as total from conversations) where total <= 2000 or rn = 1 or b <= 1600""")
def retain_tail_bytes(t: Tables) -> DataFrame:
    return dml.retain_tail(t.conversations, ["conv_id"], "turn", F.octet_length("text"), 2000).select("conv_id", "turn")


@query("""select event_id, bucket from (select *, row_number() over w as rn, sum(strlen(props)) over (partition by bucket order by ts desc, event_id desc
rows unbounded preceding) as b from (select *, case when user_id % 10 = 0 then 'none' else user_id::varchar end as bucket from events)
window w as (partition by bucket order by ts desc, event_id desc)) where rn <= 50 and b <= 400""")
def prune_partition_caps(t: Tables) -> DataFrame:
    e = t.events.withColumn("bucket", F.expr("case when user_id % 10 = 0 then 'none' else cast(user_id as string) end"))
    return dml.prune_caps(e, ["bucket"], [F.desc("ts"), F.desc("event_id")], F.octet_length("props"), 50, 400).select("event_id", "bucket")


@query("select event_id, event_type from events where ts > timestamp '2024-01-20' or event_type = 'click'")
def retain_since(t: Tables) -> DataFrame:
    named = t.events.withColumn("name", F.expr("case when event_type = 'click' then 'notes.md' else date_format(ts, \"yyyy-MM-dd'T'HH-mm-ss.SSSSSS\") end"))
    return dml.retain_since(named, F.expr("try_to_timestamp(name, \"yyyy-MM-dd'T'HH-mm-ss.SSSSSS\")"), "2024-01-20 00:00:00").select("event_id", "event_type")


@query("select o_orderkey, coalesce(nullif(case when o_orderkey % 3 = 0 then 0 else epoch_ms(o_orderdate) end, 0), epoch_ms(o_orderdate) // 1000 * 1000) as ms from orders")
def derive_defaults(t: Tables) -> DataFrame:
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    o = t.orders.select("o_orderkey", s.alias("s"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ms"))
    return dml.derived(o, "ms", F.col("s") * 1000).select("o_orderkey", "ms")


@query("""select 'j1' as job_id, c_custkey::varchar as item_id, c_custkey as row_index, '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' as row_json, 'pending' as status,
0::bigint as attempt_count, timestamp '2024-05-06 07:08:09' as created_at, null::varchar as last_error from customer""")
def job_insert(t: Tables) -> DataFrame:
    items = dml.insert_job({"id": "j1", "name": "names"}, t.customer, "c_custkey", ["c_name", "c_mktsegment"], "c_custkey", "2024-05-06 07:08:09")[1]
    return items.select("job_id", "item_id", "row_index", "row_json", "status", "attempt_count", "created_at", "last_error")


@query("select o_orderkey % 64 as shard, row_number() over (partition by o_orderkey % 64 order by o_orderkey) as line, o_orderkey, o_orderstatus from orders")
def strict_lines(t: Tables) -> DataFrame:
    """Orders as files of JSON lines, read back with the number of each line."""
    where = f"{Scratch(t.spark).root}/lines"
    o = t.orders.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 64).alias("shard"))
    o.repartition(64, "shard").sortWithinPartitions("shard", "o_orderkey").write.partitionBy("shard").json(where)
    rows = numbered.strict_json(t.spark, [f"{where}/shard=*"], "o_orderkey bigint, o_orderstatus string")
    return rows.select(F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("long").alias("shard"), "line", "o_orderkey", "o_orderstatus")


@query("select event_type as name, count(*) as n_lines from events group by 1")
def file_counts(t: Tables) -> DataFrame:
    """How many lines the files of each kind of event have, by file, then summed."""
    where = f"{Scratch(t.spark).root}/counted"
    t.events.select(F.to_json(F.struct("event_id", "user_id")).alias("value"), "event_type").write.partitionBy("event_type").text(where)
    counts = numbered.file_identity(t.spark, [f"{where}/event_type=*"])
    return counts.groupBy(F.regexp_extract("path", "/event_type=([^/]*)/", 1).alias("name")).agg(F.sum("n_lines").alias("n_lines"))


@query("""select 'j' || c_mktsegment as job_id, count(*) as n_items, sum(c_custkey)::bigint as keys, 'pending' as status from customer
where c_mktsegment <> 'BUILDING' group by 1""")
def published_jobs(t: Tables) -> DataFrame:
    """A job and its items for each market segment, published in one version each; one is deleted again, from both tables at once."""
    store = Store(t.spark, f"{Scratch(t.spark).root}/store")
    for (segment,) in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect():  # five
        items = t.customer.where(F.col("c_mktsegment") == segment)
        dml.publish_job(store, {"id": f"j{segment}"}, items, "c_custkey", ["c_name"], "c_custkey", "2024-05-06 07:08:09")
    gone = t.spark.range(1).select(F.lit("jBUILDING").alias("id"))
    dml.publish_delete(store, gone, {"jobs": "id", "job_items": "job_id"}, "id")
    jobs, items = store.read("jobs").select("id", "status"), store.read("job_items")
    per = items.groupBy("job_id").agg(F.count("*").alias("n_items"), F.sum("row_index").alias("keys"))
    return jobs.join(per, jobs["id"] == per["job_id"]).select("job_id", "n_items", "keys", "status")


@query("""select o_orderkey, (row_number() over (order by o_orderkey) - 1) // n + 1 as batch, o_orderstatus from orders, (select (count(*) + 4) // 5 as n from orders)""")
def backfill_batches(t: Tables) -> DataFrame:
    """Orders loaded in five batches in the order of their keys, each published with the key reached."""
    store, o = Store(t.spark, f"{Scratch(t.spark).root}/store"), t.orders.select("o_orderkey", "o_orderstatus")
    backfill(store, "orders", o, "o_orderkey", lambda b, k: {"orders": b.withColumn("batch", F.lit(k).cast("long"))}, (o.count() + 4) // 5)
    return store.read("orders")


@query(r"""with w as (select doc_id, text, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as c from documents),
h as (select *, hex(encode(c)) as x, strlen(c) as n, len(string_split(text, chr(10))) > 4 as more from w),
k as (select *, list_filter(range(80, 76, -1), lambda p: substr(x, 2 * p + 1, 2) not between '80' and 'BF')[1] as a,
  list_filter(range(n - 80, n - 76), lambda p: substr(x, 2 * p + 1, 2) not between '80' and 'BF')[1] as b from h)
select doc_id, case when n <= 160 then c else decode(unhex(substr(x, 1, 2 * a))) || '…' || (n - 160 + 3) // 4 || ' tokens truncated…' || decode(unhex(substr(x, 2 * b + 1))) end as content,
more or n > 160 as truncated from k""")
def line_window_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", files.line_window_tokens(F.col("text"), 2, 3, 40).alias("w")).select("doc_id", "w.*")


@query("select c_custkey as id, upper(c_name) as name, 0::bigint as visits from customer union all select -1, 'NEW', 5")
def schema_rewrite(t: Tables) -> DataFrame:
    """Customers under other columns, and a row added under these."""
    store = Store(t.spark, f"{Scratch(t.spark).root}/store")
    store.commit(add={"people": t.customer.select("c_custkey", "c_name")})
    store.rewrite("people", lambda d: d.select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit(0).cast("long").alias("visits")))
    store.commit(add={"people": t.spark.range(1).select(F.lit(-1).cast(t.customer.schema["c_custkey"].dataType).alias("id"), F.lit("NEW").alias("name"), F.lit(5).cast("long").alias("visits"))})
    return store.read("people")
