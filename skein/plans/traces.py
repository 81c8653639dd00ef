"""Queries of reduced traces: each conversation as the event log of a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.traces import Trace, reduce_trace
from skein.plans.registry import Tables, query
from skein.scratch import Scratch


def _log(t: Tables) -> DataFrame:
    """Each row of a conversation as a turn with an inference, and, by its number, a tool in a cell, a compaction, a result of an agent; ends
    come before starts where cells are concerned, and some are missing."""
    event = """filter(array(
        if(turn = 0, named_struct('k', 0, 'kind', 'rollout_started', 'body', '{}'), null), if(turn = 0, named_struct('k', 1, 'kind', 'thread_started', 'body', '{}'), null),
        named_struct('k', 2, 'kind', 'turn_started', 'body', '{}'),
        named_struct('k', 3, 'kind', 'inference_started', 'body', concat('{"inference_id":"i', turn, '","model":"', role, '"}')),
        if(turn % 3 = 1, named_struct('k', 4, 'kind', 'inference_completed', 'body', concat('{"inference_id":"i', turn, '"}')), null),
        if(turn % 3 = 2, named_struct('k', 4, 'kind', 'inference_failed', 'body', concat('{"inference_id":"i', turn, '"}')), null),
        if(turn % 4 = 1, named_struct('k', 5, 'kind', 'tool_started', 'body', concat('{"tool_id":"k', turn, '","requester":"', turn, '"}')), null),
        if(turn % 8 = 1, named_struct('k', 6, 'kind', 'tool_ended', 'body', concat('{"tool_id":"k', turn, '","status":"ok"}')), null),
        if(turn % 4 = 1, named_struct('k', 7, 'kind', 'cell_ended', 'body', concat('{"runtime_id":"', turn, '","status":"done"}')), null),
        if(turn % 4 = 1, named_struct('k', 8, 'kind', 'cell_started', 'body', concat('{"runtime_id":"', turn, '","call_id":"c', turn, '"}')), null),
        if(turn % 5 = 2, named_struct('k', 9, 'kind', 'agent_result', 'body', concat('{"edge_id":"e', turn, '","child_thread":"x","child_turn":"', if(turn % 2 = 0, concat(conv_id, '-', turn), 'none'), '","parent_thread":"main"}')), null),
        if(turn % 6 = 5, named_struct('k', 10, 'kind', 'compaction_started', 'body', concat('{"compaction_id":"z', turn, '"}')), null),
        if(turn % 2 = 0, named_struct('k', 11, 'kind', 'turn_ended', 'body', '{"status":"completed"}'), null)), e -> e is not null)"""
    rows = t.conversations.select("conv_id", "turn", F.explode(F.expr(event)).alias("e"))
    seq = F.col("turn").cast("long") * 100 + F.col("e.k")
    told = F.when(F.col("e.kind").isin("thread_started", "turn_started"), F.lit("main"))
    return rows.select(
        F.col("conv_id").cast("string").alias("trace"), seq.alias("seq"), (seq + 1000).alias("at"), F.col("e.kind").alias("kind"), told.alias("thread"),
        F.when(~F.col("e.kind").isin("rollout_started", "thread_started"), F.concat_ws("-", "conv_id", "turn")).alias("turn"), F.col("e.body").alias("body"),
    )


def _trace(t: Tables) -> Trace:
    return reduce_trace(Scratch(t.spark), _log(t))


@query("""with c as (select *, conv_id::varchar as trace, conv_id || '-' || turn as u, turn::bigint * 100 + 1000 as s, turn % 2 = 0 as e from conversations)
select trace, 'inference' as object, 'i' || turn as id, case turn % 3 when 1 then 'completed' when 2 then 'failed' else case when e then 'completed' else 'running' end end as status,
  s + 3 as started, case when turn % 3 > 0 then s + 4 when e then s + 11 end as ended, case when turn % 3 > 0 then 'own' when e then 'turn' end as closed_by from c
union all select trace, 'turn', u, case when e then 'completed' else 'running' end, s + 2, case when e then s + 11 end, case when e then 'own' end from c
union all select trace, 'tool', 'k' || turn, case when turn % 8 = 1 then 'ok' else 'running' end, s + 5, case when turn % 8 = 1 then s + 6 end, case when turn % 8 = 1 then 'own' end from c where turn % 4 = 1
union all select trace, 'cell', 'cell:c' || turn, 'done', s + 8, s + 7, 'own' from c where turn % 4 = 1
union all select trace, 'compaction', 'z' || turn, 'running', s + 10, null, null from c where turn % 6 = 5
union all select trace, 'thread', 'main', 'running', s + 1, null, null from c where turn = 0 union all select trace, 'rollout', trace, 'running', s, null, null from c where turn = 0""")
def trace_spans(t: Tables) -> DataFrame:
    o = _trace(t).objects.where("object <> 'edge'")
    return o.select("trace", "object", "id", "status", "started", "ended", "closed_by")


@query("""with c as (select *, conv_id::varchar as trace, conv_id || '-' || turn as u from conversations)
select trace, 'tool' as object, 'k' || turn as id, 'main' as thread, 'cell:c' || turn as source, null as target from c where turn % 4 = 1
union all select trace, 'edge', 'e' || turn, 'main', case when turn % 2 = 0 then 'turn:' || u else 'thread:x' end, 'thread:main' from c where turn % 5 = 2""")
def trace_links(t: Tables) -> DataFrame:
    o = _trace(t).objects.where("object in ('tool', 'edge')")
    return o.select("trace", "object", "id", "thread", F.coalesce("cell", "source").alias("source"), "target")
