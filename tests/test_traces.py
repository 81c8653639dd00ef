"""Trace reduction by hand: late and missing starts, cells by runtime, turns that close what runs."""

import json
import random

from skein.operators.traces import reduce_trace
from skein.scratch import Scratch

EVENTS = [
    ("rollout_started", None, None, {"root_thread": "t1"}), ("thread_started", "t1", None, {"agent_path": "/a", "metadata_payload": "p0"}), ("turn_started", "t1", "u1", {}),
    ("cell_ended", None, "u1", {"runtime_id": "7", "status": "done"}), ("tool_started", None, "u1", {"tool_id": "k1", "requester": "7", "tool_kind": "exec", "invocation_payload": "p1"}),
    ("cell_started", "t1", "u1", {"runtime_id": "7", "call_id": "c9"}), ("inference_started", "t1", "u1", {"inference_id": "i1", "model": "m", "request_payload": "p2"}),
    ("inference_completed", "t1", "u1", {"inference_id": "i1", "response_payload": "p3"}), ("inference_started", "t1", "u1", {"inference_id": "i2", "model": "m"}),
    ("tool_correlated", None, "u1", {"tool_id": "k1", "mcp_id": "x"}), ("tool_runtime_ended", None, "u1", {"tool_id": "k1", "runtime_status": "ok"}),
    ("turn_ended", "t1", "u1", {"status": "aborted"}), ("inference_started", "t1", "u2", {"inference_id": "i3"}), ("cell_started", "t2", None, {"runtime_id": "7", "call_id": "c10"}),
    ("agent_result", "t1", None, {"edge_id": "e1", "child_thread": "t2", "child_turn": "u1", "parent_thread": "t1"}),
    ("agent_result", "t1", None, {"edge_id": "e2", "child_thread": "t2", "child_turn": "gone", "parent_thread": "t1"}),
    ("compaction_started", "t1", "u1", {"compaction_id": "z"}), ("compaction_failed", "t1", "u1", {"compaction_id": "z"}), ("compaction_installed", "t1", "u1", {"compaction_id": "z", "checkpoint_payload": "p1"}),
    ("protocol_event", "t1", None, {}), ("strange", None, None, {}), ("tool_ended", "t1", "u1", {"tool_id": "k2", "status": "ok"}), ("tool_ended", "t1", "u1", {}), ("thread_started", "t1", None, {}),
    ("rollout_ended", None, None, {"status": "completed"}),
]


def log(order):
    return [("tr", k, 100 + k, kind, thread, turn, json.dumps(body)) for k in order for kind, thread, turn, body in [EVENTS[k]]]


def test_trace(spark):
    schema, seen = "trace string, seq long, at long, kind string, thread string, turn string, body string", []
    shuffled = list(range(len(EVENTS)))
    random.Random(1).shuffle(shuffled)
    for order in (range(len(EVENTS)), shuffled):
        t = reduce_trace(Scratch(spark), spark.createDataFrame(log(order), schema).repartition(3))
        got = {name: sorted(map(tuple, t.table(name).select(*cols).collect())) for name, cols in {
            "rollout": ["id", "status", "root_thread", "ended"], "thread": ["id", "status", "agent_path"], "turn": ["id", "thread", "status", "closed_by"],
            "inference": ["id", "turn", "status", "closed_by", "ended", "model"], "tool": ["id", "thread", "status", "closed_by", "cell", "mcp_id", "runtime_status"],
            "cell": ["id", "thread", "status", "runtime_id"], "compaction": ["id", "status"], "checkpoint": ["id", "status"], "edge": ["id", "source", "target"],
        }.items()}
        seen.append((got, sorted(map(tuple, t.payloads.collect())), sorted(repr(tuple(r)) for r in t.problems.collect())))
    assert seen[0] == seen[1]
    got, payloads, problems = seen[0]
    assert got["rollout"] == [("tr", "completed", "t1", 124)] and got["thread"] == [("t1", "running", "/a")]
    assert got["turn"] == [("u1", "t1", "aborted", "own")]
    assert got["inference"] == [("i1", "u1", "completed", "own", 107, "m"), ("i2", "u1", "aborted", "turn", 111, "m"), ("i3", "u2", "running", None, None, None)]
    assert got["tool"] == [("k1", "t1", "aborted", "turn", "cell:c9", "x", "ok"), ("k2", "t1", "ok", "own", None, None, None)]
    assert got["cell"] == [("cell:c10", "t2", "running", "7"), ("cell:c9", "t1", "done", "7")]
    assert got["compaction"] == [("z", "failed")] and got["checkpoint"] == [("z", "installed")]
    assert got["edge"] == [("e1", "turn:u1", "thread:t1"), ("e2", "thread:t2", "thread:t1")]
    assert payloads == [("tr", "p0", 1, "thread_started"), ("tr", "p1", 4, "tool_started"), ("tr", "p2", 6, "inference_started"), ("tr", "p3", 7, "inference_completed")]
    assert problems == sorted(map(repr, [
        ("tr", "strange", None, "unknown kind"), ("tr", "tool", None, "no id"), ("tr", "thread", "t1", "started twice"), ("tr", "tool", "k2", "never started"),
        ("tr", "turn", "u2", "used but unknown"), ("tr", "thread", "t2", "used but unknown"),
    ]))
