"""Structured-text projects: blocks, variables, calls, state machines and alarms, each as rows of a DataFrame.

Sources are split into blocks and lines by SQL functions; what joins blocks to each other is joined by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as fn

#: What begins a block, kinds of blocks and sections, and types that are no blocks.
HEAD = r'(?im)^\s*(FUNCTION_BLOCK|FUNCTION|ORGANIZATION_BLOCK|DATA_BLOCK)\s+"?([A-Za-z_][\w]*)"?'
KINDS = {"FUNCTION_BLOCK": "FB", "FUNCTION": "FC", "ORGANIZATION_BLOCK": "OB", "DATA_BLOCK": "DB"}
SECTIONS = {"VAR_INPUT": "Input", "VAR_OUTPUT": "Output", "VAR_IN_OUT": "InOut", "VAR_TEMP": "Temp", "VAR CONSTANT": "Constant", "VAR": "Static"}
BUILT_IN = "bool|byte|word|dword|lword|sint|int|dint|lint|usint|uint|udint|ulint|real|lreal|time|date|tod|char|string|wstring|s5time|timer|counter|array|struct"


def read_project(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.scl`` sources below a folder: (file, text)."""
    src = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.scl")
    return src.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def lines(sources: DataFrame) -> DataFrame:
    """Lines (file, line, code, note) without comments; a comment over several lines leaves its line breaks. note: what a comment on the
    line says, else empty."""
    emptied = F.regexp_replace("text", r"(?:(?<=\(\*)|\G(?!\A))(?!\*\))(\n*)(?!\*\))[^\n]", "$1")
    bare = F.regexp_replace(emptied, r"\(\*(\n*)\*\)", "$1")
    kept = F.when(F.contains("text", F.lit("(*")), bare).otherwise(F.col("text"))
    both = F.arrays_zip(F.split(kept, "\n").alias("raw"), F.split("text", "\n").alias("all"))
    each = sources.select("file", F.posexplode(both).alias("p", "x"))
    said = F.trim(F.coalesce(F.nullif(F.regexp_extract("x.all", "//(.*)$", 1), F.lit("")), F.regexp_extract("x.all", r"\(\*(.*?)\*\)", 1)))
    return each.select("file", (F.col("p") + 1).alias("line"), F.regexp_replace("x.raw", "//.*$", "").alias("code"), said.alias("note"))


def block_lines(sources: DataFrame) -> DataFrame:
    """Lines with their block's name and kind. A block reaches from its head to the first end of its kind; one without an
    end is left out, as are lines outside any block."""
    code = lines(sources)
    ahead = Window.partitionBy("file").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    kind, name = F.upper(F.regexp_extract("code", HEAD, 1)), F.regexp_extract("code", HEAD, 2)
    for k in KINDS:
        ends = F.min(F.when(F.rlike("code", F.lit(rf"(?i)\bEND_{k}\b")), F.col("line"))).over(ahead)
        code = code.withColumn(f"_{k}", ends)
    last = F.coalesce(*[F.when(kind == k, F.col(f"_{k}")) for k in KINDS])
    short = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), kind)
    heads = code.where(name != "").select(F.col("file").alias("_f"), name.alias("block"), short.alias("kind"), F.col("line").alias("_first"), last.alias("_last"))
    inside = (F.col("file") == F.col("_f")) & F.col("line").between(F.col("_first"), F.col("_last"))
    return lines(sources).join(heads, inside).select("file", "block", "kind", "line", "code", "note")


def variables(blocks: DataFrame) -> DataFrame:
    """Declarations (block, section, name, type, line, note); ``A, B : Int;`` declares two."""
    w = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.upper(F.trim(F.regexp_extract("code", r"(?i)^\s*(VAR(?:_INPUT|_OUTPUT|_IN_OUT|_TEMP|\s+CONSTANT)?)\s*$", 1)))
    ended = F.rlike("code", F.lit(r"(?i)^\s*END_VAR"))
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    mark = F.when(ended, F.lit("")).when(head != "", F.coalesce(F.try_element_at(names, head), F.lit("Static")))
    d = blocks.withColumn("section", F.last(mark, True).over(w)).where("section <> ''")
    p = r'^\s*("?[A-Za-z_]\w*"?(?:\s*,\s*"?[A-Za-z_]\w*"?)*)\s*(?:\{[^}]*\})?\s*:\s*([^;:=]+)'
    names = F.split(F.regexp_replace(F.regexp_extract("code", p, 1), r'["\s]', ""), ",")
    kind = F.trim(F.regexp_extract("code", p, 2))
    each = d.select("file", "block", "section", F.explode(names).alias("name"), F.replace(kind, F.lit('"'), F.lit("")).alias("type"), "line", *[c for c in ("note",) if c in d.columns])
    return each.where("name <> ''")


def instances(declared: DataFrame) -> DataFrame:
    """Static or temporary variables whose type is a block."""
    return declared.where(F.col("section").isin("Static", "Temp") & ~F.rlike(F.lower("type"), F.lit(rf"^(?:{BUILT_IN})\b")))


def calls(blocks: DataFrame) -> DataFrame:
    """Calls (block, callee, line): a name, of an instance or a block, before a parenthesis."""
    code = blocks.where(~F.rlike("code", F.lit(HEAD)))
    found = F.regexp_extract_all("code", F.lit(r'(?:^|[\s;])#?"?([A-Za-z_]\w*)"?\s*\('), F.lit(1))
    each = code.select("file", "block", "line", F.explode(found).alias("callee"))
    words = ["IF", "ELSIF", "WHILE", "UNTIL", "CASE", "FOR", "AND", "OR", "NOT", "RETURN", "XOR"]
    return each.where(~F.upper("callee").isin(*words))


def flow_counts(blocks: DataFrame) -> DataFrame:
    """How often each block branches and loops."""
    count = lambda k: F.sum(F.regexp_count("code", F.lit(rf"(?i)\b{k}\b"))).alias(f"n_{k.lower()}")
    return blocks.groupBy("file", "block").agg(*[count(k) for k in ("IF", "CASE", "FOR", "WHILE", "REPEAT")])


#: What nests, what stands in it, and what is assigned, in the order in which they are tried at each place of a block.
LABEL = r"(?:-?\d+|[A-Za-z_][\w.]*)"
TOKENS = [
    r"\n", r"\bCASE\s+#?[\"\w.]+\s+OF\b", r"\bEND_CASE\b", r"\bELSIF\b.*?\bTHEN\b", r"\bEND_IF\b", r"\bIF\b.*?\bTHEN\b", r"\bELSE\b",
    rf"(?:^|(?<=\bOF))[ \t]*{LABEL}(?:\s*,\s*{LABEL})*\s*:(?!=)", r"#?\"?[A-Za-z_][\w.\[\]\"]*\s*:=\s*[^;]+;",
]


def nesting(blocks: DataFrame) -> DataFrame:
    """Tokens of each block in order: (file, block, seq, line, what, text, depth, within).

    what: case, end_case, if, elsif, else, end_if, label or set. depth: how many CASE and IF are open there, the token's own included;
    within: seq, kind and text of the innermost of these. Both come from running sums, however deep statements nest and over however
    many lines a condition goes.
    """
    whole = blocks.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("l"))  # lines of one block
    text = F.array_join(F.transform("l", lambda x: x["code"]), "\n")
    found = F.regexp_extract_all(text, F.lit("(?ism)(" + "|".join(TOKENS) + ")"), F.lit(0))
    each = whole.select("file", "block", F.get("l", F.lit(0))["line"].alias("first"), F.posexplode(found).alias("seq", "text"))
    order = Window.partitionBy("file", "block").orderBy("seq")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    each = each.withColumn("line", F.col("first") + F.coalesce(F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    word = F.upper(F.regexp_extract("text", r"^\s*([A-Za-z_]+)", 1))
    opens, ends = word.isin("CASE", "IF"), word.isin("END_CASE", "END_IF")
    what = F.when(F.contains("text", F.lit(":=")) & ~word.isin("IF", "ELSIF"), "set").when(opens | ends | word.isin("ELSIF", "ELSE"), F.lower(word)).otherwise("label")
    each = each.where("text <> '\\n'").withColumn("what", what)
    opens, ends = F.col("what").isin("case", "if"), F.col("what").isin("end_case", "end_if")
    running = F.sum(F.when(opens, 1).when(ends, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("depth", running + F.when(ends, 1).otherwise(0))
    same = Window.partitionBy("file", "block", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    within = F.last(F.when(opens, F.struct("seq", "what", "text")), True).over(same)
    return each.select("file", "block", "seq", "line", "what", "text", "depth", within.alias("within"))


def states(blocks: DataFrame) -> DataFrame:
    """States of CASE statements: (file, block, machine, variable, state, first, last line, from, to: places among the tokens). A list of
    labels is as many states; statements may nest, and a state holds what is nested in it. machine counts the CASE of a block."""
    toks = nesting(blocks)
    edge = toks.where("within.what = 'case' and what in ('case', 'label', 'else', 'end_case')")
    same = Window.partitionBy("file", "block", "depth").orderBy("seq")
    edge = edge.withColumns({"to": F.lead("seq").over(same), "_stop": F.lead("line").over(same) - 1})
    cases = toks.where("what = 'case'").select("file", "block", F.col("seq").alias("_case"), F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")).alias("machine"))
    arms = edge.where("what = 'label'").withColumn("_case", F.col("within.seq")).join(cases, ["file", "block", "_case"])
    labels = F.split(F.regexp_replace("text", r"[\s:]", ""), ",")
    variable = F.regexp_replace(F.regexp_extract("within.text", r"(?i)^CASE\s+(\S+)\s+OF", 1), '[#"]', "")
    return arms.select(
        "file", "block", "machine", variable.alias("variable"), F.explode(labels).alias("state"), F.col("line").alias("first"),
        F.greatest(F.coalesce("_stop", "line"), F.col("line")).alias("last"), F.col("seq").alias("from"), F.coalesce("to", F.lit(2**31 - 1)).alias("to"),
    )


def branches(blocks: DataFrame) -> DataFrame:
    """Branches of IF statements: (file, block, depth, condition, from, to: places among the tokens). That of ELSE is that none before holds."""
    toks = nesting(blocks).where("within.what = 'if' and what in ('if', 'elsif', 'else', 'end_if')")
    same = Window.partitionBy("file", "block", "depth").orderBy("seq")
    upto = Window.partitionBy("file", "block", "within.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    said = fn.collapse(F.regexp_extract("text", r"(?is)^\s*(?:ELS)?IF\b(.*)\bTHEN$", 1))
    d = toks.withColumn("_c", F.when(F.col("what").isin("if", "elsif"), said)).withColumn("_all", F.collect_list("_c").over(upto)).withColumn("to", F.lead("seq").over(same))
    none = F.array_join(F.transform("_all", lambda c: F.concat(F.lit("NOT ("), c, F.lit(")"))), " AND ")
    return d.where("what <> 'end_if'").select("file", "block", "depth", F.coalesce("_c", none).alias("condition"), F.col("seq").alias("from"), F.coalesce("to", F.lit(2**31 - 1)).alias("to"))


def transitions(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Assignments of a state variable inside a state: (file, block, machine, variable, state, target, line, condition: of all the IFs it
    stands in, from the outermost to the innermost, or null)."""
    sets = nesting(blocks).where("what = 'set'")
    sets = sets.select("file", "block", "seq", "line", plain(F.regexp_extract("text", r"^([^:]+?)\s*:=", 1)).alias("_v"), F.trim(F.regexp_extract("text", r"(?s):=\s*([^;]+);", 1)).alias("target"))
    spans = found.select("file", "block", "machine", "variable", "state", F.col("from").alias("_from"), F.col("to").alias("_to"))
    moves = sets.join(spans, ["file", "block"]).where((F.col("_v") == plain(F.col("variable"))) & (F.col("seq") > F.col("_from")) & (F.col("seq") < F.col("_to")) & (F.col("target") != F.col("state")))
    held = branches(blocks).select("file", "block", "depth", F.col("condition").alias("_c"), F.col("from").alias("_b"), F.col("to").alias("_e"))
    inside = sets.select("file", "block", "seq").join(held, ["file", "block"]).where("seq > _b and seq < _e")
    conds = inside.groupBy("file", "block", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "_c"))), lambda x: x["_c"]), " AND ").alias("condition"))
    return moves.join(conds, ["file", "block", "seq"], "left").select("file", "block", "machine", "variable", "state", "target", "line", "condition")


def _spans(found: DataFrame) -> DataFrame:
    return found.select("file", "block", *[F.col(c).alias(f"_{c}") for c in ("variable", "state", "first", "last")])


def alarms(blocks: DataFrame) -> DataFrame:
    """Assignments whose names tell of safety, faults, alarms, interlocks or warnings."""
    p = r'(#?"?[A-Za-z_][\w.]*"?)\s*:=\s*([^;]+);'
    d = blocks.select("file", "block", "line", F.regexp_extract("code", p, 1).alias("symbol"), fn.collapse(F.regexp_extract("code", p, 2)).alias("expression"))
    return d.where("symbol <> ''").withColumn("c", fn.category(F.concat_ws(" ", "symbol", "expression"))).where("c is not null").select("file", "block", "line", "symbol", "expression", "c.category", "c.severity")


def alarm_states(found: DataFrame, machine: DataFrame) -> DataFrame:
    """The state each alarm stands in, if any, with its machine and variable."""
    spans = machine.select("file", "block", "machine", "variable", "state", F.col("first").alias("_first"), F.col("last").alias("_last"))
    near = found.join(spans, ["file", "block"]).where("line between _first and _last")
    states = near.select("file", "block", "line", "symbol", "machine", "variable", "state").distinct()
    return found.join(states, ["file", "block", "line", "symbol"], "left")


#: Families of standard blocks by name, and words that tell a device's kind.
FAMILIES = {
    "MC_POWER": "MotionControl", "MC_HOME": "MotionControl", "MC_MOVEABSOLUTE": "MotionControl", "MC_MOVERELATIVE": "MotionControl",
    "MC_MOVEVELOCITY": "MotionControl", "MC_STOP": "MotionControl", "MC_HALT": "MotionControl", "MC_RESET": "MotionControl",
    "PID_COMPACT": "PID", "PID_3STEP": "PID", "CTRL_PID": "PID",
}
DEVICES = {
    "ServoAxis": r"\b(?:axis|servo|motion|drive)\b|\bMC_(?:Power|Home|MoveAbsolute|MoveRelative|MoveVelocity|Stop|Halt|Reset)\b",
    "Motor": r"\b(?:motor|mtr|conveyor|fan|blower)\b",
    "Cylinder": r"\b(?:cylinder|cyl|pneumatic|aircyl)\b",
    "Valve": r"\b(?:valve|vlv|solenoid)\b",
    "Pump": r"\b(?:pump|pmp)\b",
}


def plain(name: Column) -> Column:
    """A name without quotes and number sign, in lower case."""
    return F.lower(F.regexp_replace(F.trim(name), '^#?"?|"$', ""))


def family(name: Column) -> Column:
    """The family of a standard block; null for other names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.upper(plain(name)))


def devices(found: DataFrame) -> DataFrame:
    """Instances (file, block, section, name, type, line) that name a device, with its kind."""
    text = F.regexp_replace(F.concat_ws(" ", "name", "type"), "_", " ")
    kind = F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?i){p}")) | F.rlike("type", F.lit(f"(?i){p}")), k) for k, p in DEVICES.items()])
    return found.select("file", "block", "name", "type", kind.alias("device"), "line").where("device is not null")


def confidence(evidence: DataFrame, key: list[str]) -> DataFrame:
    """How sure each device of ``key`` is, by its rows of evidence (kind): high with two, one of them of motion control; medium with two."""
    n, motion = F.count("*"), F.max((F.col("kind") == "MotionControl").cast("int"))
    return evidence.groupBy(*key).agg(F.when((n >= 2) & (motion == 1), "high").when(n >= 2, "medium").otherwise("low").alias("confidence"))


def state_actions(blocks: DataFrame, machine: DataFrame, known: DataFrame) -> DataFrame:
    """What each state does: (file, block, variable, state, kind, target, line, device, family). Calls are of a device, a
    standard block or another block; an assignment of the state variable is no action but a transition. known: see ``devices``."""
    call = F.regexp_extract("code", r'^\s*(#?"[^"]+"|#?[A-Za-z_][\w.]*)\s*\(', 1)
    sets = F.regexp_extract("code", r'^\s*(#?"?[A-Za-z_][\w.]*"?)\s*:=\s*[^;]+;', 1)
    # The rest of a line behind a state's label belongs to the state.
    code = blocks.withColumn("code", F.regexp_replace("code", r"^\s*(?:-?\d+|[A-Za-z_][\w.]*)(?:\s*,\s*(?:-?\d+|[A-Za-z_][\w.]*))*\s*:(?!=)", ""))
    words = F.upper(call).isin("IF", "ELSIF", "WHILE", "UNTIL", "CASE", "FOR")
    d = code.select("file", "block", "line", F.when((call != "") & ~words, call).alias("_call"), F.when(sets != "", sets).alias("_set"))
    d = d.withColumn("target", F.coalesce("_call", "_set")).where("target is not null")
    d = d.join(_spans(machine), ["file", "block"]).where("line between _first and _last")
    d = d.where(F.col("_call").isNotNull() | (plain(F.col("target")) != plain(F.col("_variable"))))
    names = known.select("file", "block", plain(F.col("name")).alias("_k"), "device").dropDuplicates(["file", "block", "_k"])
    d = d.withColumn("_k", plain(F.col("target"))).join(names, ["file", "block", "_k"], "left")
    fam = F.when(F.col("_call").isNotNull() & F.col("device").isNull(), family(F.col("target")))
    kind = F.when(F.col("_call").isNull(), "ASSIGNMENT").when(F.col("device").isNotNull(), "DEVICE_CALL").when(fam.isNotNull(), "STANDARD_BLOCK_CALL").otherwise("BLOCK_CALL")
    dev = F.when(F.col("_call").isNotNull(), F.col("device")).alias("device")
    return d.select("file", "block", F.col("_variable").alias("variable"), F.col("_state").alias("state"), kind.alias("kind"), "target", "line", dev, fam.alias("family"))


def causal_chains(moves: DataFrame, actions: DataFrame, raised: DataFrame) -> DataFrame:
    """For each transition (file, block, state, target, line, condition): the actions and alarms of the state it leaves, in order of
    lines. raised: alarms with their state, see ``alarm_states``."""
    key = ["file", "block", "state"]
    listed = lambda d, what, into: d.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", what))), lambda x: x[what]).alias(into))
    does = listed(actions, "target", "actions")
    out = moves.join(does, key, "left").join(listed(raised.where("state is not null"), "symbol", "alarms"), key, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"actions": F.coalesce("actions", none), "alarms": F.coalesce("alarms", none)})


def causal_relations(chains: DataFrame) -> DataFrame:
    """Relations (source, relation, target) of a knowledge graph: a state completes when a condition holds, which advances to the
    next state; a state may raise its alarms."""
    state = lambda c: F.concat_ws(":", F.lit("STATE"), "block", c)
    cond = F.concat_ws(":", F.lit("CONDITION"), "block", "state", "line")
    some = chains.where("condition is not null")
    when = some.select(state("state").alias("source"), F.lit("COMPLETES_WHEN").alias("relation"), cond.alias("target"))
    then = some.select(cond.alias("source"), F.lit("ADVANCES_TO").alias("relation"), state("target").alias("target"))
    each = chains.select("block", "state", F.explode("alarms").alias("alarm"))
    may = each.select(state("state").alias("source"), F.lit("MAY_RAISE").alias("relation"), F.concat_ws(":", F.lit("ALARM"), "block", plain(F.col("alarm"))).alias("target"))
    return when.unionByName(then).unionByName(may).distinct()


def causal_graph(moves: DataFrame, raised: DataFrame) -> DataFrame:
    """Relations (source, relation, target, line) as of ``causal_relations``, with ids that tell machines of one block and alarms of one
    symbol apart. moves: see ``transitions``; raised: alarms with their state, see ``alarm_states``."""
    machine = lambda m, v: F.concat_ws(":", F.lit("STATE_MACHINE"), F.concat_ws(":", F.lit("BLOCK"), F.lower("block")), m, plain(v))
    state = lambda c: F.concat_ws(":", F.lit("STATE"), machine("machine", F.col("variable")), plain(F.col(c)))
    some = moves.where("condition is not null").withColumns({"_s": state("state"), "_t": state("target")})
    cond = F.concat_ws(":", F.lit("CONDITION"), "_s", "line")
    when = some.select(F.col("_s").alias("source"), F.lit("COMPLETES_WHEN").alias("relation"), cond.alias("target"), "line")
    then = some.select(cond.alias("source"), F.lit("ADVANCES_TO").alias("relation"), F.col("_t").alias("target"), "line")
    alarm = F.concat_ws(":", F.lit("ALARM"), F.concat_ws(":", F.lit("BLOCK"), F.lower("block")), "line", plain(F.col("symbol")))
    may = raised.where("machine is not null").select(state("state").alias("source"), F.lit("MAY_RAISE").alias("relation"), alarm.alias("target"), "line")
    return when.unionByName(then).unionByName(may).distinct()


def narratives(moves: DataFrame, actions: DataFrame, raised: DataFrame) -> DataFrame:
    """What happens in each transition, in a sentence: (file, block, variable, state, target, line, summary). The state's devices,
    standard blocks, variables and other blocks come in that order, each named once."""
    key = ["file", "block", "variable", "state"]
    kinds = [("DEVICE_CALL", "operates "), ("STANDARD_BLOCK_CALL", "calls standard block "), ("ASSIGNMENT", "writes "), ("BLOCK_CALL", "calls ")]

    def named(k: str, verb: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("line", "target"))))
        names = F.array_join(F.array_distinct(F.transform(rows, lambda x: x["target"])), ", ")
        return F.when(names != "", F.concat(F.lit(verb), names))

    does = actions.groupBy(*key).agg(F.concat_ws("; ", *[named(*k) for k in kinds]).alias("_does"))
    alarm = F.array_sort(F.collect_list(F.struct("line", F.concat_ws(" ", "category", "symbol").alias("a"))))
    warns = raised.where("state is not null").groupBy("file", "block", "state").agg(F.array_join(F.array_distinct(F.transform(alarm, lambda x: x["a"])), ", ").alias("_warns"))
    out = moves.join(does, key, "left").join(warns, ["file", "block", "state"], "left")
    goes = F.concat(F.lit("; when "), F.coalesce("condition", F.lit("no condition is given")), F.lit(", goes to state "), "target", F.lit("."))
    text = F.concat(F.col("variable"), F.lit(" in state "), "state", F.lit(": "), F.coalesce(F.nullif("_does", F.lit("")), F.lit("no action found")), goes)
    return out.select(*key, "target", "line", F.concat(text, F.coalesce(F.concat(F.lit(" It may raise "), "_warns", F.lit(".")), F.lit(""))).alias("summary"))


def xref(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Uses (block, name, scope, access, line): declarations, writes (before ``:=``) and reads."""
    own = declared.select("file", "block", F.lower("name").alias("_k")).distinct().withColumn("_own", F.lit(True))
    decl = declared.select("file", "block", "name", F.lit("DECLARE").alias("access"), "line")
    w = F.regexp_extract_all("code", F.lit(r'#?"?([A-Za-z_]\w*)"?[\w.\[\]"]*\s*:='), F.lit(1))
    names = F.regexp_extract_all("code", F.lit(r'#"?([A-Za-z_]\w*)|"([A-Za-z_]\w*)"'), F.lit(0))
    used = F.transform(names, lambda x: F.regexp_replace(x, '[#"]', ""))
    code = blocks.where(~F.rlike("code", F.lit(HEAD)))
    wrote = code.select("file", "block", F.explode(w).alias("name"), F.lit("WRITE").alias("access"), "line")
    read = code.select("file", "block", F.explode(F.array_except(used, w)).alias("name"), F.lit("READ").alias("access"), "line")
    uses = wrote.unionByName(read).unionByName(decl).withColumn("_k", F.lower("name"))
    out = uses.join(own, ["file", "block", "_k"], "left")
    return out.select("file", "block", "name", F.when(F.col("_own"), "LOCAL").otherwise("GLOBAL").alias("scope"), "access", "line").distinct()


def tag_issues(declared: DataFrame, uses: DataFrame) -> DataFrame:
    """(block, name, rule): bad names, variables without a comment (where ``declared`` has their notes), names declared twice whatever
    their case, variables that nothing uses."""
    naming = declared.select("block", "name", F.explode(fn.naming_issues(F.col("name"))).alias("rule"))
    twice = declared.groupBy("block", F.lower("name").alias("_k")).agg(F.count("*").alias("n"), F.min_by("name", "line").alias("name"))
    twice = twice.where("n > 1").select("block", "name", F.lit("duplicate").alias("rule"))
    if "note" in declared.columns:
        twice = twice.unionByName(declared.where("note = ''").select("block", "name", F.lit("missing-comment").alias("rule")))
    used = uses.where("access <> 'DECLARE'").select("block", F.lower("name").alias("_k")).distinct()
    idle = declared.withColumn("_k", F.lower("name")).join(used, ["block", "_k"], "left_anti").select("block", "name", F.lit("unused").alias("rule"))
    return naming.unionByName(twice).unionByName(idle)


def line_index(*found: DataFrame) -> DataFrame:
    """What stands on each line: rows (file, line, what) gathered by place."""
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    return both.groupBy("file", "line").agg(F.array_sort(F.collect_set("what")).alias("objects"))


def verify_manifest(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """Files below a folder against a manifest (path relative to it, listed digest)."""
    from skein.operators.search import verify_manifest as verify

    have = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("file://", "") + "/", "")
    return verify(have.select(path.alias("path"), F.sha2("content", 256).alias("digest")), listed, "path")
