"""Aggregates: progress counts, counters, histograms, gauges, merges, budgets, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of duration histograms, in milliseconds and in seconds; a value belongs to the first bound that is
#: not below it, or to the overflow behind the last.
MS_BOUNDS = [
    0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 1250.0, 1500.0, 1750.0, 2000.0, 2250.0, 2500.0,
    3000.0, 3500.0, 4000.0, 4500.0, 5000.0, 6000.0, 7000.0, 7500.0, 8000.0, 9000.0, 10000.0, 12000.0, 15000.0, 20000.0,
    30000.0, 60000.0, 120000.0,
]
SECOND_BOUNDS = [0.0, 0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def pivot_counts(df: DataFrame, key: list[str], status: str, names: dict[str, str]) -> DataFrame:
    """Rows in all and by status, in one pass; 0 where there are none."""
    each = [F.coalesce(F.sum((F.col(status) == v).cast("long")), F.lit(0)).alias(k) for k, v in names.items()]
    return df.groupBy(*key).agg(F.count("*").alias("total"), *each)


def bucket(value: Column, bounds: list[float]) -> Column:
    """Place of a value among upper bounds, from 0; len(bounds) is the overflow."""
    below = F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda b: value <= b), F.lit(True))
    return F.when(below == 0, len(bounds)).otherwise(below - 1).cast("int")


def histogram(df: DataFrame, key: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Count and sum of each bucket that has values."""
    return df.groupBy(*key, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def whole(total: Column) -> Column:
    """A sum as a whole number: rounded half away from zero; 0 if it is not finite or not above 0."""
    odd = total.isNull() | F.isnan(total) | (total <= 0) | (F.abs(total) == float("inf"))
    return F.when(odd, 0).otherwise(F.round(total)).cast("long")


def total(value: Column) -> Column:
    """A sum of doubles that does not hang on the order of rows: exact for values below 1e18, taken to nine decimals; null without values."""
    fine = F.abs(value) < 1e18
    exact = F.sum(F.when(fine, value).cast("decimal(28,9)"))
    rest = F.sum(F.when(~fine, value))  # huge, infinite or not a number
    return F.when(rest.isNull(), exact.cast("double")).otherwise(rest + F.coalesce(exact.cast("double"), F.lit(0.0)))


def summary(df: DataFrame, key: list[str], name: str, value: str, fields: dict[str, tuple[str, str]], order: list[str] | None = None) -> DataFrame:
    """One row a key with named fields: each is the number or the whole sum of the points of one name.

    Sums are exact without ``order``. With it they are added up as doubles in the order of these columns, which tell a key's points apart, so
    that a sum near a half is rounded as where points are added as they come. A key's points then pass one task, in files if they are many.
    """
    points = {f: F.when(F.col(name) == metric, F.col(value).cast("double")) for f, (metric, what) in fields.items() if what == "sum"}
    sums = {f: total(x) for f, x in points.items()}
    if order and points:
        into = "_run"
        while into in df.columns:
            into += "_"
        so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(into, F.struct(F.struct(*order).alias("at"), *[F.sum(x).over(so_far).alias(f) for f, x in points.items()]))
        sums = {f: F.max_by(F.col(into)[f], F.col(into)["at"]) for f in points}
    counts = {f: F.count(F.when(F.col(name) == metric, 1)) for f, (metric, what) in fields.items() if what == "count"}
    return df.groupBy(*key).agg(*[(whole(sums[f]) if f in sums else counts[f]).alias(f) for f in fields])


def merge_summaries(df: DataFrame, key: list[str], seq: str, totals: list[str], gauges: list[str]) -> DataFrame:
    """Summaries of a key as one: totals add; of a gauge, the last value above 0 counts (0 if there is none)."""
    last = [F.coalesce(F.max_by(g, F.when(F.col(g) > 0, F.col(seq))), F.lit(0)).alias(g) for g in gauges]
    return df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in totals], *last)


def measure(df: DataFrame, key: list[str], size: Column, keep: Column) -> DataFrame:
    """Rows and bytes before and after a filter."""
    one = keep.cast("long")
    return df.groupBy(*key).agg(
        F.count("*").alias("n_before"), F.sum(size).cast("long").alias("bytes_before"),
        F.sum(one).alias("n_after"), F.sum(size * one).cast("long").alias("bytes_after"),
    )


def budget(df: DataFrame, key: list[str], order: list, cost: Column, limit: float, thresholds: list[float]) -> DataFrame:
    """Running cost, whether the limit is reached, and how many thresholds are not below what remains."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("spent", F.sum(cost).over(w))
    left = F.lit(limit) - F.col("spent")
    crossed = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: left <= t))
    return out.withColumn("exhausted", F.col("spent") >= limit).withColumn("crossed", crossed)


def ordered_distinct(df: DataFrame, key: list[str], order: str, value: str, into: str) -> DataFrame:
    """The distinct values of each key in the order they first came. Firsts are found before rows are gathered."""
    first = df.groupBy(*key, value).agg(F.min(order).alias("_at"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda s: s[value]).alias(into))


def partitioned(df: DataFrame, key: list[str], order: str, kind: str, kinds: list[str]) -> DataFrame:
    """For each key, the places of each kind of row, in order."""
    return df.groupBy(*key).agg(*[F.sort_array(F.collect_list(F.when(F.col(kind) == k, F.col(order)))).alias(k) for k in kinds])


def coalesce_group(df: DataFrame, key: list[str], seq: str, fields: list[str], names: str, default: object = None) -> DataFrame:
    """First value of each field that is not null (nor ``default``), and the sorted distinct names."""
    fine = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.lit(default is None) | (F.col(c) != F.lit(default))), F.col(seq))).alias(c) for c in fields]
    return df.groupBy(*key).agg(*fine, F.array_sort(F.collect_set(names)).alias(names))


def group_recency(df: DataFrame, group: str, at: str, row: str, first: object, groups: int, rows: int) -> DataFrame:
    """The most recent groups, one of them before all others, and the newest rows of each."""
    tops = df.groupBy(group).agg(F.max(at).alias("_latest"), F.count("*").alias("n_in_group"))
    tops = tops.orderBy(F.desc(F.col(group) == F.lit(first)), F.desc("_latest"), group).limit(groups)
    w = Window.partitionBy(group).orderBy(F.desc(at), row)
    out = df.join(F.broadcast(tops), group).withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows)
    return out.drop("_latest")
