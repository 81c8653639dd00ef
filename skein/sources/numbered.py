"""Lines of text files with their numbers, whatever splits Spark reads a file in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, value): all lines of all files; ``line`` counts from 1 in each file. An empty file has no line.

    Lines of a split follow each other in one task, so a line's place in its split is its id less the smallest of the split. A count
    per split, summed over the splits before it, does the rest: no line is sorted or shuffled, and the counts are a row per split.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id")]
    lines = spark.read.text(path).select(*at, "value")
    splits = lines.groupBy("path", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = splits.selectExpr("path as _path", "_split as _at", "_first", "sum(_n) over (partition by path order by _split) - _n as _before")
    same = (F.col("path") == F.col("_path")) & (F.col("_split") == F.col("_at"))
    return lines.join(before, same).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def first_bad(rows: DataFrame, bad: Column) -> tuple[str, int] | None:
    """File and number of the first line that is ``bad``, by path and line; None where none is."""
    at = rows.where(bad).agg(F.min(F.struct("path", "line")).alias("at")).first()["at"]
    return None if at is None else (at["path"], at["line"])


def strict_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines as (path, line, columns of ``schema``); blank lines are skipped but counted. A line that is no JSON of the
    schema raises ValueError with its file and number, before any row is returned."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("_j", parsed)
    if bad := first_bad(rows, F.col("_j").isNull() | F.col("_j._bad").isNotNull()):
        raise ValueError(f"{bad[0]}: line {bad[1]} is not valid")
    return rows.select("path", "line", "_j.*").drop("_bad")


def file_identity(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size, modified, n_lines) of each file; the first three tell whether a file is still the one that was counted."""
    about = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "path"), ("file_size", "size"), ("file_modification_time", "modified"))]
    return spark.read.text(path).select(*about).groupBy("path", "size", "modified").agg(F.count("*").alias("n_lines"))


def line_at(spark: SparkSession, path: str, offset: int, known: DataFrame) -> DataFrame:
    """(path, line, value) of the line ``offset`` (from 0) of an append log. ``known`` is what ``file_identity`` said of it: a
    log that has become smaller since, or has fewer lines, was replaced, and raises ValueError; one that has grown is the same log."""
    now, then = file_identity(spark, path).first(), known.first()
    if then is not None and (now is None or now["size"] < then["size"] or now["n_lines"] < then["n_lines"]):
        raise ValueError(f"{path} is not the log that was counted")
    return numbered_lines(spark, path).where(F.col("line") == offset + 1)
