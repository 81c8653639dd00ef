"""Queries of diffs, line sequences, comments and PLC sources made from rows of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import patches, plc
from skein.plans.registry import Tables, query


@query("""select c_custkey as id, 2 as added, 1 as deleted, sha1('file-line-v1' || chr(0) || 'repo' || chr(0) || c_name) as prints from customer""")
def diff_parse(t: Tables) -> DataFrame:
    diff = F.concat(F.lit("--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n same\n-old "), "c_name", F.lit("\n+"), "c_name", F.lit("\n+}\n+++ not in the hunk"))
    out = patches.diff_summary(t.customer.select(F.col("c_custkey").alias("id"), diff.alias("diff")), "repo")
    return out.select("id", "added", "deleted", F.array_join("fingerprints", ",").alias("prints"))


@query("""select s_suppkey as id, case when s_suppkey % 3 = 2 then null else 1 end as place, case s_suppkey % 3 when 0 then 0 when 1 then 2 end as level from supplier""")
def seek_sequence(t: Tables) -> DataFrame:
    lines = F.array(F.col("s_name"), F.expr("case s_suppkey % 3 when 0 then 'x' when 1 then ' x' else 'z' end"), F.lit("y"))
    return patches.seek(t.supplier.select(F.col("s_suppkey").alias("id"), lines.alias("lines")), ["x", "y"])


@query("""select c_custkey, case when c_custkey % 2 = 0 then '电机' else case when length(c_mktsegment) <= length(c_name) then c_mktsegment else c_name end end as best from customer""")
def best_part(t: Tables) -> DataFrame:
    text = F.concat("c_mktsegment", F.lit(" | "), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(" | 电机")).otherwise(F.lit("")))
    return t.customer.select("c_custkey", patches.best_part(text).alias("best"))


def _sources(t: Tables) -> DataFrame:
    code = F.concat(
        F.lit('FUNCTION_BLOCK "FB_'), "n_nationkey", F.lit('"\nVAR\n  step : Int;\nEND_VAR\nBEGIN\n  #step := 1;\nEND_FUNCTION_BLOCK\nFUNCTION "FC_'),
        "n_nationkey", F.lit('" : Void\nBEGIN\n  "Tag" := TRUE;\nEND_FUNCTION'),
    )
    return t.nation.select(F.concat(F.lit("f"), "n_nationkey").alias("file"), code.alias("text"))


@query("""select 'f' || n_nationkey as file, 'FB_' || n_nationkey as block, 'FB' as kind, 7 as n_lines from nation union all select 'f' || n_nationkey, 'FC_' || n_nationkey, 'FC', 4 from nation""")
def scl_blocks(t: Tables) -> DataFrame:
    return plc.block_lines(_sources(t)).groupBy("file", "block", "kind").agg(F.count("*").alias("n_lines"))


@query("""select 'FB_' || n_nationkey as block, unnest(['step', 'step']) as name, 'LOCAL' as scope, unnest(['DECLARE', 'WRITE']) as access from nation
union all select 'FC_' || n_nationkey, 'Tag', 'GLOBAL', 'WRITE' from nation""")
def xref(t: Tables) -> DataFrame:
    blocks = plc.block_lines(_sources(t))
    return plc.xref(blocks, plc.variables(blocks)).select("block", "name", "scope", "access")


def _machines(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, state machines and devices of one source per nation: a pump is run in state 10 until it is ready, an axis homed in 20."""
    code = F.concat(
        F.lit('FUNCTION_BLOCK "FB_'), "n_nationkey", F.lit('"\nVAR\n  Feed_Pump : "FB_Pump";\n  step : Int;\nEND_VAR\nBEGIN\nCASE #step OF\n  10:\n    #Feed_Pump(run := TRUE);\n'
        '    #out := #a AND #b;\n    IF #ready THEN\n      #step := 20;\n    END_IF;\n  20:\n    MC_Home(Axis := #x);\n    Helper();\n    #overflow_fault := #c;\n    #step := 10;\nEND_CASE;\nEND_FUNCTION_BLOCK\n'),
    )
    blocks = plc.block_lines(t.nation.select(F.concat(F.lit("f"), "n_nationkey").alias("file"), code.alias("text")))
    return blocks, plc.states(blocks), plc.devices(plc.instances(plc.variables(blocks)))


_ACTIONS = """(values ('10', 'DEVICE_CALL', '#Feed_Pump', 'Pump', null), ('10', 'ASSIGNMENT', '#out', null, null), ('20', 'STANDARD_BLOCK_CALL', 'MC_Home', null, 'MotionControl'),
('20', 'BLOCK_CALL', 'Helper', null, null), ('20', 'ASSIGNMENT', '#overflow_fault', null, null)) a(state, kind, target, device, family)"""


@query("select 'FB_' || n_nationkey as block, a.* from nation, {a}", a=_ACTIONS)
def state_actions(t: Tables) -> DataFrame:
    return plc.state_actions(*_machines(t)).select("block", "state", "kind", "target", "device", "family")


@query("""select 'FB_' || n_nationkey as block, c.* from nation, (values ('10', '20', '#ready', '#Feed_Pump,#out', ''), ('20', '10', null, 'MC_Home,Helper,#overflow_fault', '#overflow_fault')) c(state, target, condition, actions, alarms)""")
def causal_chains(t: Tables) -> DataFrame:
    return _chains(t).select("block", "state", "target", "condition", F.array_join("actions", ",").alias("actions"), F.array_join("alarms", ",").alias("alarms"))


def _chains(t: Tables) -> DataFrame:
    blocks, machine, known = _machines(t)
    raised = plc.alarm_states(plc.alarms(blocks), machine)
    return plc.causal_chains(plc.transitions(blocks, machine), plc.state_actions(blocks, machine, known), raised)


@query("""with b as (select 'FB_' || n_nationkey as b from nation) select 'STATE:' || b || ':10' as source, 'COMPLETES_WHEN' as relation, 'CONDITION:' || b || ':10:12' as target from b
union all select 'CONDITION:' || b || ':10:12', 'ADVANCES_TO', 'STATE:' || b || ':20' from b union all select 'STATE:' || b || ':20', 'MAY_RAISE', 'ALARM:' || b || ':overflow_fault' from b""")
def causal_relations(t: Tables) -> DataFrame:
    return plc.causal_relations(_chains(t))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'high' when c_custkey % 3 = 1 then 'medium' else 'low' end as confidence from customer")
def device_confidence(t: Tables) -> DataFrame:
    kinds = F.expr("case c_custkey % 3 when 0 then array('name', 'MotionControl') when 1 then array('name', 'PID') else array('MotionControl') end")
    return plc.confidence(t.customer.select("c_custkey", F.explode(kinds).alias("kind")), ["c_custkey"])


def _nested(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A source for each supplier, whose machine has as many states as its key tells, each with labels, a nested IF and, in every third, a
    nested CASE; all blocks and their states."""
    arm = """concat('  ', 10 * k, ', ', 10 * k + 1, ':\n', '    IF #a', k, ' AND\n       #b THEN\n', '      IF #c THEN #step := ', 10 * k + 10, '; ELSE\n        #step := -', k, ';\n      END_IF;\n    END_IF;\n',
      if(k % 3 = 0, concat('    CASE #mode OF\n      1: #mode := ', k, ';\n    ELSE\n      #step := 0;\n    END_CASE;\n'), ''))"""
    arms = f"array_join(transform(sequence(1, cast(s_suppkey % 7 + 1 as int)), k -> {arm}), '')"
    code = F.expr(f"""concat('FUNCTION_BLOCK "FB_', s_suppkey, '"\nVAR\n  step, mode : Int;\nEND_VAR\nBEGIN\nCASE #step OF\n', {arms}, 'END_CASE;\nEND_FUNCTION_BLOCK\n')""")
    blocks = plc.block_lines(t.supplier.select(F.concat(F.lit("f"), "s_suppkey").alias("file"), code.alias("text")))
    return blocks, plc.states(blocks)


_ARMS = """a as (select 'FB_' || s_suppkey as block, k from (select s_suppkey, unnest(range(1, s_suppkey % 7 + 2)) as k from supplier)),
p as (select block, k, case when l = 0 then 10 * k else 10 * k + 1 end as s from a, (values (0), (1)) x(l))"""


@query("""with {a} select block, 'step' as variable, s::varchar as state from p union all select block, 'mode', '1' from a where k % 3 = 0""", a=_ARMS)
def nested_states(t: Tables) -> DataFrame:
    return _nested(t)[1].select("block", "variable", "state")


@query("""with {a} select block, 'step' as variable, s::varchar as state, (10 * k + 10)::varchar as target, '#a' || k || ' AND #b AND #c' as condition from p
union all select block, 'step', s::varchar, '-' || k, '#a' || k || ' AND #b AND NOT (#c)' from p union all select block, 'step', s::varchar, '0', null from p where k % 3 = 0
union all select block, 'mode', '1', k::varchar, null from a where k % 3 = 0""", a=_ARMS)
def nested_transitions(t: Tables) -> DataFrame:
    return plc.transitions(*_nested(t)).select("block", "variable", "state", "target", "condition")


@query("""select 'FB_' || n_nationkey as block, c.* from nation, (values ('10', 'step in state 10: operates #Feed_Pump; writes #out; when #ready, goes to state 20.'),
('20', 'step in state 20: calls standard block MC_Home; writes #overflow_fault; calls Helper; when no condition is given, goes to state 10. It may raise FAULT #overflow_fault.')) c(state, summary)""")
def flow_narratives(t: Tables) -> DataFrame:
    blocks, machine, known = _machines(t)
    raised = plc.alarm_states(plc.alarms(blocks), machine)
    return plc.narratives(plc.transitions(blocks, machine), plc.state_actions(blocks, machine, known), raised).select("block", "state", "summary")
