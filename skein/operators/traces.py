"""Trace reduction: one event log of many kinds to linked tables, whatever order the events came in.

Every event is routed to an object (a turn, a call, a cell ...) and has a role there; one aggregate over all objects folds them, so
the log is shuffled once for all tables. What an event only hints at, such as the thread of its turn, is found by joins
with the folded turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import Scratch

#: For each kind of event: the object, the role, the field of its body that names the object (None: the event's thread or turn), and the
#: status it leaves (None: the body tells).
KINDS = {
    "rollout_started": ("rollout", "start", "trace_id", "running"), "rollout_ended": ("rollout", "end", "trace_id", None),
    "thread_started": ("thread", "start", "thread_id", "running"), "thread_ended": ("thread", "end", "thread_id", None),
    "turn_started": ("turn", "start", "turn_id", "running"), "turn_ended": ("turn", "end", "turn_id", None),
    "inference_started": ("inference", "start", "inference_id", "running"), "inference_completed": ("inference", "end", "inference_id", "completed"),
    "inference_failed": ("inference", "end", "inference_id", "failed"), "inference_cancelled": ("inference", "end", "inference_id", "cancelled"),
    "tool_started": ("tool", "start", "tool_id", "running"), "tool_correlated": ("tool", "note", "tool_id", None),
    "tool_runtime_started": ("tool", "note", "tool_id", None), "tool_runtime_ended": ("tool", "note", "tool_id", None), "tool_ended": ("tool", "end", "tool_id", None),
    "cell_started": ("cell", "start", "runtime_id", "running"), "cell_responded": ("cell", "note", "runtime_id", None), "cell_ended": ("cell", "end", "runtime_id", None),
    "compaction_started": ("compaction", "start", "compaction_id", "running"), "compaction_completed": ("compaction", "end", "compaction_id", "completed"),
    "compaction_failed": ("compaction", "end", "compaction_id", "failed"), "compaction_installed": ("checkpoint", "start", "compaction_id", "installed"),
    "agent_result": ("edge", "start", "edge_id", "observed"), "protocol_event": ("none", "note", None, None),
}
#: Fields that objects keep: the first event that has one tells it.
FIELDS = ["model", "provider", "tool_kind", "summary", "requester", "mcp_id", "call_id", "agent_path", "child_thread", "child_turn", "parent_thread", "message", "runtime_status", "root_thread"]
PAYLOADS = ["metadata", "request", "response", "invocation", "runtime", "result", "checkpoint", "carried"]


def typed(events: DataFrame) -> DataFrame:
    """Events (trace, seq, at, kind, thread, turn, body: JSON text) with object, role, id and status, and the fields of their bodies.

    ``body`` is read once, as a variant; one that is no JSON gives no fields. Kinds that are not known have a null object.
    """
    made = {k: F.create_map(*[F.lit(x) for kind, v in KINDS.items() if v[i] is not None for x in (kind, v[i])]) for i, k in enumerate(("object", "role", "field", "sets"))}
    d = events.withColumn("_v", F.try_parse_json("body"))
    get = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    names = sorted({v[2] for v in KINDS.values() if v[2]})
    named = F.coalesce(*[F.when(F.try_element_at(made["field"], F.col("kind")) == n, get(n)) for n in names])
    where = {"turn_id": "turn", "thread_id": "thread", "trace_id": "trace"}  # told by the event itself, if not by its body
    own = F.coalesce(*[F.when(F.try_element_at(made["field"], F.col("kind")) == n, F.col(c)) for n, c in where.items()])
    return d.select(
        "trace", "seq", "at", "kind", F.coalesce("thread", get("thread_id")).alias("thread"), F.coalesce("turn", get("turn_id")).alias("turn"),
        F.try_element_at(made["object"], F.col("kind")).alias("object"), F.try_element_at(made["role"], F.col("kind")).alias("role"), F.coalesce(named, own).alias("id"),
        F.coalesce(F.try_element_at(made["sets"], F.col("kind")), get("status")).alias("status"),
        *[get(f).alias(f) for f in FIELDS], F.array_compact(F.array(*[get(f"{p}_payload") for p in PAYLOADS])).alias("payloads"),
    )


def _folded(rows: DataFrame) -> DataFrame:
    """One row per object: its start, its end, its first and last status, its first known fields, and what is wrong with it."""
    on = lambda role: F.col("role") == role
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    start, end = F.when(on("start"), F.col("seq")), F.when(on("end"), F.col("seq"))
    return rows.groupBy("trace", "object", "scope", "id").agg(
        F.min(start).alias("started_seq"), F.min_by("at", start).alias("started"), F.max(end).alias("ended_seq"), F.max_by("at", end).alias("ended"),
        F.max_by("status", end).alias("end_status"), F.min_by("status", start).alias("start_status"), F.max_by("status", F.when(on("note") & F.col("status").isNotNull(), F.col("seq"))).alias("noted"),
        first("thread").alias("thread"), first("turn").alias("turn"), *[first(f).alias(f) for f in FIELDS],
        F.count(start).alias("n_starts"), F.count(end).alias("n_ends"), F.min("seq").alias("first_seq"),
    )


class Trace:
    """The reduced tables of a log, by name; see ``reduce_trace``."""

    def __init__(self, objects: DataFrame, payloads: DataFrame, problems: DataFrame):
        self.objects, self.payloads, self.problems = objects, payloads, problems

    def table(self, name: str) -> DataFrame:
        """rollout, thread, turn, inference, tool, cell, compaction, checkpoint or edge."""
        return self.objects.where(F.col("object") == name).drop("object")


def reduce_trace(scratch: Scratch, events: DataFrame) -> Trace:
    """Linked tables of event logs (trace, seq, at, kind, thread, turn, body).

    Starts and ends meet by id in any order; of several ends the last counts. An event without a thread has that of its
    turn. Cells are named by a runtime within their thread until their start tells the call that made them; their id is that of the
    call. A tool that a cell asked for (``requester``) links to the cell. Inferences, tools and cells that still run when their turn ends
    end with it, with its status. An edge leads from the child's turn, or from its thread where that turn never came, to the parent's
    thread. ``problems`` lists what cannot be right: unknown kinds, events without an id, objects started twice, ended or
    noted but never started, threads and turns that nothing started.
    """
    rows = typed(events)
    # Threads by turn, for events that tell their turn only.
    turns = rows.where("turn is not null and thread is not null").groupBy("trace", "turn").agg(F.min_by("thread", "seq").alias("_of"))
    rows = rows.join(turns, ["trace", "turn"], "left").withColumn("thread", F.coalesce("thread", "_of")).drop("_of")
    scope = F.when(F.col("object") == "cell", F.coalesce("thread", F.lit(""))).otherwise(F.lit(""))
    rows = scratch.keep(rows.withColumn("scope", scope))
    known = rows.where("object is not null and object <> 'none' and id is not null")
    objects = scratch.keep(_folded(known))
    ends = objects.where("object = 'turn' and n_ends > 0").select("trace", F.col("id").alias("turn"), F.col("ended").alias("turn_ended"), F.col("end_status").alias("turn_status"))
    out = objects.join(ends, ["trace", "turn"], "left")
    nested = F.col("object").isin("inference", "tool", "cell") & F.col("ended_seq").isNull() & F.col("turn_ended").isNotNull()
    status = F.when(nested, F.col("turn_status")).otherwise(F.coalesce("end_status", "noted", "start_status"))
    closed = F.when(F.col("ended_seq").isNotNull(), "own").when(nested, "turn")
    out = out.withColumns({"status": status, "closed_by": closed, "ended": F.when(nested, F.col("turn_ended")).otherwise(F.col("ended"))})
    # Cells have the id of the call that made them; tools know them by runtime and thread.
    cells = objects.where("object = 'cell'").select("trace", F.col("scope").alias("thread"), F.col("id").alias("requester"), F.concat(F.lit("cell:"), "call_id").alias("cell"))
    out = out.join(cells, ["trace", "thread", "requester"], "left")
    have = objects.where("object in ('turn', 'thread')").select("trace", F.col("object").alias("_o"), F.col("id").alias("_i"), F.lit(True).alias("_have"))
    source = have.where("_o = 'turn'").select("trace", F.col("_i").alias("child_turn"), F.col("_have").alias("_turn"))
    out = out.join(source, ["trace", "child_turn"], "left")
    edge = F.col("object") == "edge"
    out = out.withColumns({
        "source": F.when(edge, F.when(F.col("_turn"), F.concat(F.lit("turn:"), "child_turn")).otherwise(F.concat(F.lit("thread:"), "child_thread"))),
        "target": F.when(edge, F.concat(F.lit("thread:"), "parent_thread")), "runtime_id": F.when(F.col("object") == "cell", F.col("id")),
        "id": F.when(F.col("object") == "cell", F.coalesce(F.concat(F.lit("cell:"), "call_id"), F.col("id"))).otherwise(F.col("id")),
    })
    keep = ["trace", "object", "id", "thread", "turn", "status", "started", "ended", "closed_by", "cell", "source", "target", "runtime_id", *FIELDS]
    payloads = rows.select("trace", "seq", "kind", F.explode("payloads").alias("payload")).groupBy("trace", "payload").agg(F.min("seq").alias("seq"), F.min_by("kind", "seq").alias("kind"))
    return Trace(out.select(*keep), payloads, _problems(rows, objects, have))


def _problems(rows: DataFrame, objects: DataFrame, have: DataFrame) -> DataFrame:
    """(trace, object, id, problem)."""
    say = lambda d, text: d.select("trace", "object", "id", F.lit(text).alias("problem"))
    out = say(rows.where("object is null").select("trace", F.col("kind").alias("object"), "id"), "unknown kind")
    out = out.unionByName(say(rows.where("object <> 'none' and id is null"), "no id"))
    out = out.unionByName(say(objects.where("n_starts > 1"), "started twice")).unionByName(say(objects.where("n_starts = 0"), "never started"))
    for name in ("turn", "thread"):
        uses = objects.where(f"object <> '{name}' and {name} is not null").select("trace", F.lit(name).alias("_o"), F.col(name).alias("_i")).distinct()
        lost = uses.join(have, ["trace", "_o", "_i"], "left_anti")
        out = out.unionByName(say(lost.select("trace", F.col("_o").alias("object"), F.col("_i").alias("id")), "used but unknown"))
    return out.distinct()
