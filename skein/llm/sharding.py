"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, documents


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (signed 64-bit, ascending) and shards of the virtual nodes; a shard's nodes do not depend on
    how many other shards there are."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), virtual)
    with np.errstate(over="ignore"):
        seed = shard * np.uint64(1_000_003) + np.tile(np.arange(virtual, dtype=np.uint64), shards)
        at = _mix((seed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    order = np.lexsort((shard, at))
    return at[order], shard[order].astype(np.int64)


def fill(load: dict[int, int], owner: np.ndarray, shards: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """Which byte ranges of each arc go to which shard: (arc, low, high, shard).

    Each arc offers its bytes to the shard at its end; what finds that shard full is offered to the next node
    clockwise whose shard has room. All arcs make their n-th offer before any makes its next. The work is
    bounded by the size of the ring, not by the data.
    """
    room, n, out = [capacity] * shards, len(owner), []
    left = [(arc, 0, load[arc], arc) for arc in sorted(load)]
    while left:
        later = []
        for arc, low, high, node in left:
            steps = 0
            while room[owner[node]] == 0 and steps < n:
                node, steps = (node + 1) % n, steps + 1
            take = min(high - low, room[owner[node]])
            out.append((arc, low, low + take, int(owner[node])))
            room[owner[node]] -= take
            if low + take < high:
                later.append((arc, low + take, high, (node + 1) % n))
        left = later
    return out


def bounded_ring(
    scratch: Scratch, rows: DataFrame, key: str, size: str, shards: int = 40, virtual: int = 256, slack: float = 0.001
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    key: a column whose equal values share a ring position; size: a positive long column. A shard takes at most
    (1 + slack) times the mean of the sizes, or, where whole rows do not fit that closely, the fewest bytes more.
    Rows of one key continue clockwise once a shard is full, so one key with a third of all rows spreads over
    several shards, and its rows over many partitions: they are range-sorted by position and a hash of the row.
    Null keys share one position; repeated rows are kept and get slots of their own; an empty table gives an
    empty result. Columns may have any names; those named ``shard`` or ``slot`` are replaced.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    inner = {c: f"c{i}" for i, c in enumerate(cols)}
    own = rows.select(*[F.col(f"`{c}`").alias(inner[c]) for c in cols])
    out = _bounded(scratch, own, inner[key], inner[size], shards, virtual, slack)
    return out.select(*[F.col(inner[c]).alias(c) for c in cols], "shard", "slot")


def _bounded(scratch: Scratch, rows: DataFrame, key: str, size: str, shards: int, virtual: int, slack: float) -> DataFrame:
    spark = scratch.spark
    at, owner = ring(shards, virtual)
    cols = rows.columns
    placed = rows.withColumn("_pos", F.xxhash64(key)).withColumn("_tie", F.xxhash64(*cols))
    placed = placed.repartitionByRange("_pos", "_tie").sortWithinPartitions("_pos", "_tie").drop("_tie")
    placed = placed.withColumn("_pid", F.spark_partition_id())
    schema = placed.drop("_pos").withColumns({"_arc": F.lit(0), "_off": F.lit(0).cast("long")}).schema

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's arc, and the bytes of the arc before it in this partition."""
        last, carried = -1, 0
        for b in batches:
            arc = (np.searchsorted(at, b["_pos"].to_numpy(), "left") % len(at)).astype(np.int32)
            n = b[size].to_numpy(np.int64)
            ends = np.cumsum(n)
            first = np.r_[True, arc[1:] != arc[:-1]] if len(arc) else np.zeros(0, bool)
            base = np.maximum.accumulate(np.where(first, ends - n, 0)) if len(arc) else ends
            off = ends - n - base
            if len(arc):
                if arc[0] == last:
                    off[arc == last] += carried
                last, carried = int(arc[-1]), int(off[-1] + n[-1])
            yield b.drop(columns="_pos").assign(_arc=arc, _off=off)

    t = scratch.keep(placed.mapInPandas(running, schema))
    parts = t.groupBy("_arc", "_pid").agg(F.sum(size).alias("_bytes"))
    load = {r[0]: r[1] for r in parts.groupBy("_arc").agg(F.sum("_bytes")).collect()}  # at most a row per virtual node
    total = sum(load.values())
    capacity = max(1, int(-(-total * (1 + slack) // shards)))
    pieces = fill(load, owner, shards, capacity)
    held = spark.createDataFrame(pieces, "_arc int, _low long, _high long, shard int")
    before = parts.selectExpr(
        "_arc", "_pid", "sum(_bytes) over (partition by _arc order by _pid) - _bytes as _before"
    )
    # Both tables are bounded by the virtual nodes plus the partitions, whatever the number of rows.
    t2 = t.join(F.broadcast(before), ["_arc", "_pid"]).withColumn("_off", F.col("_off") + F.col("_before"))
    t2 = t2.join(F.broadcast(held), "_arc").where("_off >= _low and _off < _high")
    torn = F.col("_off") + F.col(size) > F.col("_high")
    # Rows that reach over the end of a range: one for each range at most.
    over = t2.where(torn).select("_arc", "_off", F.col(size).alias("n")).collect()
    whole = {r[0]: r[1] for r in t2.where(~torn).groupBy("shard").agg(F.sum(size)).collect()}
    moved = spark.createDataFrame(_place(over, whole, owner, shards, capacity), "_arc int, _off long, _moved int")
    t2 = t2.drop("_low", "_high", "_before").join(F.broadcast(moved), ["_arc", "_off"], "left")
    t2 = scratch.keep(t2.withColumn("shard", F.coalesce("_moved", "shard")).drop("_moved"))
    scratch.drop(t)
    counts = t2.groupBy("shard", "_pid").agg(F.count("*").alias("_n"))
    first = counts.selectExpr("shard", "_pid", "sum(_n) over (partition by shard order by _pid) - _n as _first")
    out = t2.selectExpr("*", "row_number() over (partition by _pid, shard order by _arc, _off) - 1 as _rank")
    out = out.join(F.broadcast(first), ["shard", "_pid"])
    return out.select(*cols, "shard", (F.col("_first") + F.col("_rank")).alias("slot"))


def _place(over, whole: dict, owner: np.ndarray, shards: int, capacity: int) -> list[tuple[int, int, int]]:
    """A shard for each torn row: the first clockwise with room for all of it, else the emptiest; largest first."""
    load, n, out = [whole.get(s, 0) for s in range(shards)], len(owner), []
    for arc, off, size in sorted(map(tuple, over), key=lambda r: (-r[2], r[0], r[1])):
        node = next((i % n for i in range(arc, arc + n) if load[owner[i % n]] + size <= capacity), None)
        shard = min(range(shards), key=lambda s: (load[s], s)) if node is None else int(owner[node])
        load[shard] += size
        out.append((arc, off, shard))
    return out


def op5_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes; equal texts share a place on the ring."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    out = bounded_ring(Scratch(spark), rows, "text_key", "size")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op5_ring": op5_ring}
