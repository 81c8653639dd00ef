"""Joins: fallbacks, merges, ranges, nearest rows, completion of unmatched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_found(df: DataFrame, sources: list[DataFrame], key: str, value: str, default: Column | None = None) -> DataFrame:
    """``value`` from the first source (key, value) that has the row's key."""
    found = []
    for i, s in enumerate(sources):
        df = df.join(s.select(key, F.col(value).alias(f"_v{i}")), key, "left")
        found.append(F.col(f"_v{i}"))
    found += [default] if default is not None else []
    return df.withColumn(value, F.coalesce(*found)).drop(*[f"_v{i}" for i in range(len(sources))])


def merge_outer(a: DataFrame, b: DataFrame, key: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides by key: ``a``'s fields where it has them, else ``b``'s; arrays are united and sorted."""
    both = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in a.columns if c != key]).join(
        b.select(key, *[F.col(c).alias(f"_b_{c}") for c in b.columns if c != key]), key, "full_outer"
    )

    def field(c: str) -> Column:
        if c in arrays:
            none = F.array().cast("array<string>")
            return F.array_sort(F.array_union(F.coalesce(f"_a_{c}", none), F.coalesce(f"_b_{c}", none)))
        return F.coalesce(f"_a_{c}", f"_b_{c}")

    return both.select(key, *[field(c).alias(c) for c in a.columns if c != key])


def add_missing(have: DataFrame, ids: DataFrame, key: str, **defaults: Column) -> DataFrame:
    """``have``, and a row of defaults for each id it lacks."""
    new = ids.select(key).distinct().join(have.select(key), key, "left_anti")
    return have.unionByName(new.select(key, *[v.alias(k) for k, v in defaults.items()]))


def renames(baseline: DataFrame, current: DataFrame, origins: DataFrame) -> DataFrame:
    """(path, origin): files that are new now and whose origin was in the baseline and is gone."""
    new = origins.join(current.select("path"), "path", "left_semi").join(baseline.select("path"), "path", "left_anti")
    was = baseline.select(F.col("path").alias("origin"))
    gone = current.select(F.col("path").alias("origin"))
    return new.join(was, "origin", "left_semi").join(gone, "origin", "left_anti").select("path", "origin")


def range_join(points: DataFrame, spans: DataFrame, on: str, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points inside spans of the same ``on``. Spans are dealt into cells of ``width``, so the join is on (on, cell) and a long
    key spreads over many partitions; each point lies in one cell, so no pair comes twice."""
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    s = spans.withColumn("_cell", F.explode(cells))
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    return p.join(s, [on, "_cell"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def nearest(rows: DataFrame, marks: DataFrame, on: str, at: str, reach: int = 2) -> DataFrame:
    """Each row with the nearest mark within ``reach`` places: the closest, and of two as close the one before."""
    m = marks.select(on, F.col(at).alias("_at"), *[c for c in marks.columns if c not in (on, at)])
    places = F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach))
    both = rows.withColumn("_at", places).join(m, [on, "_at"])
    w = Window.partitionBy(on, at).orderBy(F.abs(F.col("_at") - F.col(at)), F.col("_at"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("_at", "mark_at")


def complete_unmatched(calls: DataFrame, outputs: DataFrame, key: list[str], order: str, **made: Column) -> DataFrame:
    """Outputs, and right after each call that has none a made one. ``order`` becomes (order, sub)."""
    none = calls.join(outputs.select(*key), key, "left_anti").select(*key, order, F.lit(1).alias("sub"), *[v.alias(k) for k, v in made.items()])
    rest = outputs.select(*key, order, F.lit(0).alias("sub"), *made)
    return rest.unionByName(none)


def resolve(calls: DataFrame, types: DataFrame, blocks: DataFrame) -> DataFrame:
    """Targets of calls (caller, name), by the type of an instance of that name, else by a block's name; case-insensitive."""
    c = calls.withColumn("_k", F.lower("name")).withColumn("_c", F.lower("caller"))
    i = types.select(F.lower("owner").alias("_c"), F.lower("instance").alias("_k"), F.lower("type").alias("_type"))
    b = blocks.select(F.lower("block").alias("_b"), "block")
    via = b.select(F.col("_b").alias("_type"), F.col("block").alias("_by_type"))
    direct = b.select(F.col("_b").alias("_k"), F.col("block").alias("_by_name"))
    out = c.join(i, ["_c", "_k"], "left").join(via, "_type", "left").join(direct, "_k", "left")
    target = F.coalesce("_by_type", "_by_name", F.concat(F.lit("UNRESOLVED:"), F.col("name")))
    return out.select(*calls.columns, target.alias("target"))
