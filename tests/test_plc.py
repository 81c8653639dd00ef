import hashlib

from pyspark.sql import functions as F

from skein.operators import graph, joins, plc

MAIN = """ORGANIZATION_BLOCK "Main"
VAR_TEMP
  Axis1 : "FB_Axis";
END_VAR
BEGIN
  #Axis1(run := TRUE);
  Missing_FC();
END_ORGANIZATION_BLOCK
"""
AXIS = """FUNCTION_BLOCK "FB_Axis"
VAR_INPUT
  run : Bool; // start
  run2 : Bool;
END_VAR
VAR
  step : Int;
  motor_fault : Bool;
  tmp1 : Real;
END_VAR
BEGIN
(* several
   lines *)
CASE #step OF
  10:
    IF #run THEN
      #step := 20;
    END_IF;
  20:
    #motor_fault := #run2 AND #run;
    #step := 10;
END_CASE;
END_FUNCTION_BLOCK
"""


def test_project(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.scl").write_text(MAIN)
    (tmp_path / "src" / "b.scl").write_text(AXIS)
    blocks = plc.block_lines(plc.read_project(spark, str(tmp_path))).cache()
    assert {(r.block, r.kind) for r in blocks.select("block", "kind").distinct().collect()} == {("Main", "OB"), ("FB_Axis", "FB")}
    declared = plc.variables(blocks).cache()
    assert sorted((r.name, r.section) for r in declared.where("block = 'FB_Axis'").collect()) == [("motor_fault", "Static"), ("run", "Input"), ("run2", "Input"), ("step", "Static"), ("tmp1", "Static")]
    made = plc.instances(declared)
    assert [(r.name, r.type) for r in made.collect()] == [("Axis1", "FB_Axis")]
    called = plc.calls(blocks).select(F.col("block").alias("caller"), F.col("callee").alias("name"))
    names = blocks.select("block").distinct()
    resolved = joins.resolve(called, made.select(F.col("block").alias("owner"), F.col("name").alias("instance"), "type"), names)
    assert sorted(r.target for r in resolved.collect()) == ["FB_Axis", "UNRESOLVED:Missing_FC"]
    paths = graph.root_paths(spark, resolved.select("caller", F.col("target").alias("callee")))
    assert ["Main", "FB_Axis"] in [r.path for r in paths.collect()]
    machine = plc.states(blocks).cache()
    assert sorted((r.variable, r.state) for r in machine.collect()) == [("step", "10"), ("step", "20")]
    moves = sorted((r.state, r.target, r.condition) for r in plc.transitions(blocks, machine).collect())
    assert moves == [("10", "20", "#run"), ("20", "10", None)]
    found = plc.alarm_states(plc.alarms(blocks), machine).collect()
    assert [(r.category, r.severity, r.state) for r in found] == [("FAULT", "red", "20")]
    uses = plc.xref(blocks, declared).cache()
    assert {(r.name, r.access) for r in uses.where("name = 'step' and scope = 'LOCAL'").collect()} == {("step", "DECLARE"), ("step", "READ"), ("step", "WRITE")}
    issues = {(r.name, r.rule) for r in plc.tag_issues(declared, uses).collect()}
    assert ("tmp1", "generic") in issues and ("tmp1", "unused") in issues and ("run", "unused") not in issues
    assert plc.flow_counts(blocks).where("block = 'FB_Axis'").first().n_case == 1
    index = plc.line_index(declared.select("file", "line", F.col("name").alias("what")), machine.select("file", F.col("first").alias("line"), F.concat(F.lit("state "), "state").alias("what")))
    assert index.where("array_contains(objects, 'state 10')").count() == 1
    listed = spark.createDataFrame([("src/a.scl", hashlib.sha256(MAIN.encode()).hexdigest()), ("gone.scl", "x")], "path string, listed string")
    assert {r.path: r.verdict for r in plc.verify_manifest(spark, str(tmp_path), listed).collect()} == {"src/a.scl": "ok", "src/b.scl": "unlisted", "gone.scl": "missing"}


def test_blocks_end_at_their_end(spark):
    text = 'x\nFUNCTION "A" : Void\n y := 1;\nEND_FUNCTION\n between\nFUNCTION_BLOCK "B"\n never closed\nFUNCTION "C"\nend_function;\n'
    got = plc.block_lines(spark.createDataFrame([("f", text)], "file string, text string")).select("block", "line").orderBy("block", "line").collect()
    assert list(map(tuple, got)) == [("A", 2), ("A", 3), ("A", 4), ("C", 8), ("C", 9)]


NESTED = """FUNCTION_BLOCK "FB_Cell"
VAR
  A, B, "C" : Int; // three
  mode : Int;      (* of the cell *)
  step : Int;
  Step : Int;
END_VAR
BEGIN
CASE #step OF
  -1, 0:
    #step := 10;
  10, 20:
    IF #a AND
       #b THEN
      IF #c THEN #step := 30; ELSIF #d THEN
        #step := 40;
      ELSE
        #step := 50;
      END_IF;
      #step := 60;
    END_IF;
    #A := 1;
  30: #step := 31;
  31:
    CASE #mode OF
      1: #mode := 2; #step := 70;
      2, IDLE:
        IF #e THEN #mode := 1; END_IF;
        #overload_alarm := #x;
    ELSE
      #step := 80;
    END_CASE;
    #step := 90;
ELSE
  #step := 0;
END_CASE;
CASE #mode OF
  1: #overload_alarm := #y;
END_CASE;
END_FUNCTION_BLOCK
"""


def test_nested_machines(spark):
    blocks = plc.block_lines(spark.createDataFrame([("f", NESTED)], "file string, text string")).cache()
    declared = plc.variables(blocks)
    assert [(r.name, r.note) for r in declared.orderBy("line", "name").collect()] == [("A", "three"), ("B", "three"), ("C", "three"), ("mode", "of the cell"), ("step", ""), ("Step", "")]
    found = plc.states(blocks).cache()
    got = sorted((r.machine, r.variable, r.state, r["first"], r["last"]) for r in found.collect())
    assert got == [
        (1, "step", "-1", 10, 11), (1, "step", "0", 10, 11), (1, "step", "10", 12, 22), (1, "step", "20", 12, 22), (1, "step", "30", 23, 23), (1, "step", "31", 24, 33),
        (2, "mode", "1", 26, 26), (2, "mode", "2", 27, 29), (2, "mode", "IDLE", 27, 29), (3, "mode", "1", 38, 38),
    ]
    moves = sorted(((r.machine, r.state, r.target, r.condition) for r in plc.transitions(blocks, found).collect()), key=repr)
    want = [(1, "-1", "10", None), (1, "0", "10", None), (1, "30", "31", None), (1, "31", "70", None), (1, "31", "80", None), (1, "31", "90", None), (2, "1", "2", None), (2, "IDLE", "1", "#e"), (2, "2", "1", "#e")]
    for s in ("10", "20"):
        want += [(1, s, "30", "#a AND #b AND #c"), (1, s, "40", "#a AND #b AND #d"), (1, s, "50", "#a AND #b AND NOT (#c) AND NOT (#d)"), (1, s, "60", "#a AND #b")]
    assert moves == sorted(want, key=repr)
    raised = plc.alarm_states(plc.alarms(blocks), found).cache()
    near = {(r.line, r.machine, r.state) for r in raised.collect()}
    assert {(29, 1, "31"), (29, 2, "2"), (29, 2, "IDLE"), (38, 3, "1")} == near
    edges = {(r.source, r.relation, r.target) for r in plc.causal_graph(plc.transitions(blocks, found), raised).collect()}
    m2, m3 = "STATE:STATE_MACHINE:BLOCK:fb_cell:2:mode", "STATE:STATE_MACHINE:BLOCK:fb_cell:3:mode"
    assert {(f"{m2}:2", "MAY_RAISE", "ALARM:BLOCK:fb_cell:29:overload_alarm"), (f"{m3}:1", "MAY_RAISE", "ALARM:BLOCK:fb_cell:38:overload_alarm")} <= edges
    assert (f"{m2}:2", "COMPLETES_WHEN", f"CONDITION:{m2}:2:28") in edges and (f"CONDITION:{m2}:2:28", "ADVANCES_TO", f"{m2}:1") in edges
    issues = {(r.name, r.rule) for r in plc.tag_issues(declared, plc.xref(blocks, declared)).collect()}
    assert ("step", "duplicate") in issues and {("step", "missing-comment"), ("Step", "missing-comment")} <= issues and ("A", "missing-comment") not in issues
    told = {(r.state, r.target): r.summary for r in plc.narratives(plc.transitions(blocks, found).where("machine = 2"), plc.state_actions(blocks, found, declared.limit(0).withColumn("device", F.lit(""))), raised).collect()}
    assert told["2", "1"] == "mode in state 2: writes #overload_alarm; when #e, goes to state 1. It may raise ALARM #overload_alarm."
