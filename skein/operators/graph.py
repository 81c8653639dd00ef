"""Graphs: spawn trees, call paths, degrees, knowledge graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.scratch import Scratch


def children(edges: DataFrame, parent: object, status: str | None = None) -> DataFrame:
    """Direct children of a node by id; edges: parent, child, status."""
    rows = edges.where(F.col("parent") == F.lit(parent))
    return (rows if status is None else rows.where(F.col("status") == status)).select("child").orderBy("child")


def descendants(spark: SparkSession, edges: DataFrame, root: int, status: str | None = None) -> DataFrame:
    """(child, depth) below a root, by depth and child. The status holds for every edge on the way, not only for the last.

    Level by level until nothing new is found; what was found before is not followed again, so shared nodes and cycles
    cost nothing more. Levels are written, so each reads only the one before.
    """
    e = edges if status is None else edges.where(F.col("status") == status)
    e, scratch = e.select("parent", "child"), Scratch(spark)
    level = e.where((F.col("parent") == F.lit(root)) & (F.col("child") != F.lit(root))).select("child").distinct()
    known, depth = None, 0
    while True:
        depth += 1
        level = scratch.keep(level.withColumn("depth", F.lit(depth)))
        known = level if known is None else known.unionByName(level)
        if level.isEmpty():
            return known.orderBy("depth", "child")
        found = e.join(level.select(F.col("child").alias("parent")), "parent").select("child").distinct()
        level = found.where(F.col("child") != F.lit(root)).join(known.select("child"), "child", "left_anti")


def root_paths(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """All simple paths from nodes that nothing calls, as arrays; a node stands once in a path. calls: caller, callee.

    Paths grow by one call a round; as none repeats a node, they end by themselves.
    """
    calls, scratch = calls.select("caller", "callee"), Scratch(spark)
    called = calls.where("callee is not null").select(F.col("callee").alias("caller")).distinct()
    paths = calls.select("caller").distinct().join(called, "caller", "left_anti").select(F.array("caller").alias("path"), F.col("caller").alias("last"))
    found = None
    while True:
        on = F.col("caller") == F.col("last")
        longer = paths.join(calls, on).where(~F.array_contains("path", F.col("callee")))
        paths = scratch.keep(longer.select(F.array_append("path", F.col("callee")).alias("path"), F.col("callee").alias("last")))
        found = paths if found is None else found.unionByName(paths)
        if paths.isEmpty():
            return found.select("path")


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct neighbours out of and into each node: (node, n_out, n_in)."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct()
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def diagnostics(blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """(issue, name): blocks defined twice, calls of blocks that are not there, functions nothing calls. blocks: block, kind;
    calls: caller, callee. Names are compared without case."""
    twice = blocks.groupBy(F.lower("block").alias("k")).agg(F.count("*").alias("n"), F.min("block").alias("name")).where("n > 1")
    have = blocks.select(F.lower("block").alias("k")).distinct()
    lost = calls.select(F.lower("callee").alias("k"), F.col("callee").alias("name")).join(have, "k", "left_anti").groupBy("k").agg(F.min("name").alias("name"))
    called = calls.select(F.lower("callee").alias("k")).distinct()
    idle = blocks.where(F.upper("kind").isin("FB", "FC")).select(F.lower("block").alias("k"), F.col("block").alias("name")).join(called, "k", "left_anti").distinct()
    issue = lambda d, what: d.select(F.lit(what).alias("issue"), "name")
    return issue(twice, "duplicate").unionByName(issue(lost, "unresolved")).unionByName(issue(idle, "orphan"))


def build(entities: list[DataFrame], relations: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A knowledge graph: of entities (id, kind, name, seq) the first of each id counts; relations (source, kind, target) are distinct
    and both ends exist."""
    nodes = entities[0]
    for e in entities[1:]:
        nodes = nodes.unionByName(e)
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("kind", "name"), "seq").alias("_e")).select("id", "_e.*")
    edges = relations[0]
    for r in relations[1:]:
        edges = edges.unionByName(r)
    edges = edges.distinct()
    ids = nodes.select(F.col("id"))
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges.select("source", "kind", "target")


def related(nodes: DataFrame, edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    """Entities that a node points to, by relation."""
    e = edges.where(F.col("source") == node)
    e = e if kind is None else e.where(F.col("kind") == kind)
    return e.select(F.col("kind").alias("relation"), F.col("target").alias("id")).join(nodes, "id").orderBy("relation", "id")


def at_line(nodes: DataFrame, refs: str, file: str, line: int) -> DataFrame:
    """Entities one of whose references (file, line) is there."""
    here: Column = F.exists(refs, lambda r: (r["file"] == file) & (r["line"] == line))
    return nodes.where(here)
