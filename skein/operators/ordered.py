"""Operators over ordered rows of a key: numbering, deltas, segments, windows between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.offsets import truncate_tokens

from skein.scratch import Scratch


def numbered(df: DataFrame, key: list[str], order: list, into: str = "n") -> DataFrame:
    """Rows of each key numbered from 1. Without a key all rows go through one partition; give one where there is."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(into, F.row_number().over(w))


def monotonic(df: DataFrame, key: list[str], order: list, base: Column, into: str) -> DataFrame:
    """Strictly rising times: each is at least its base and one more than the one before. The recursion has the closed form
    max over the rows so far of (base - number), plus number."""
    w = Window.partitionBy(*key).orderBy(*order)
    n = F.row_number().over(w)
    low = df.withColumn("_n", n).withColumn("_d", base - F.col("_n"))
    return low.withColumn(into, F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).drop("_n", "_d")


def gaps(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Rows whose ordinal is not the one after the row before, with the one ``expected``."""
    w = Window.partitionBy(*key).orderBy(ordinal)
    out = df.withColumn("expected", F.lag(ordinal).over(w) + 1)
    return out.where(F.col("expected").isNotNull() & (F.col(ordinal) != F.col("expected")))


def counter_deltas(df: DataFrame, key: list[str], order: list, counter: str, into: str) -> DataFrame:
    """What a cumulative counter gained since the row before; a counter that fell gained nothing."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(into, F.greatest(F.col(counter) - F.coalesce(F.lag(counter).over(w), F.lit(0)), F.lit(0)))


def segments(df: DataFrame, key: list[str], order: list, starts: Column, into: str) -> DataFrame:
    """Rows numbered by segment; a row where ``starts`` holds begins one, and rows before the first are in segment 1 too."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.greatest(F.sum(starts.cast("int")).over(w), F.lit(1)))


def turns_by_markers(df: DataFrame, key: list[str], order: list, kind: str, start: str, end: list[str], into: str) -> DataFrame:
    """Turn of each row: rows after an end belong to the next turn, as those before its start do."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col(kind).isin(*end).cast("int")).over(w), F.lit(0))
    return df.withColumn(into, ended + 1)


def phase_times(df: DataFrame, key: list[str], order: list, at: Column, phase: str, into: str) -> DataFrame:
    """Time until the next row of the key, summed by phase; the last row's phase has no time of its own."""
    w = Window.partitionBy(*key).orderBy(*order)
    spans = df.withColumn("_t", F.lead(at).over(w) - at)
    return spans.groupBy(*key, phase).agg(F.coalesce(F.sum("_t"), F.lit(0)).alias(into))


def prefix_before(df: DataFrame, key: list[str], order: list, counts: Column, n: int) -> DataFrame:
    """Rows before the n-th (from 0) one that counts; all rows where there are fewer."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", F.sum(counts.cast("int")).over(w)).where(F.col("_c") <= n).drop("_c")


def tail_from(df: DataFrame, key: list[str], order: list, counts: Column, n: int) -> DataFrame:
    """Rows from the n-th last one that counts; all rows where there are fewer. ``order`` is newest first."""
    w = Window.partitionBy(*key).orderBy(*order)
    seen = F.sum(counts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_c", seen).withColumn("_m", counts)
    return out.where((F.col("_c") < n) | ((F.col("_c") == n) & F.col("_m"))).drop("_c", "_m")


def token_budget(df: DataFrame, key: list[str], order: str, counts: Column, text: str, most: int) -> DataFrame:
    """Texts of rows that count share ``most`` tokens of each key, in order: the one that crosses the budget is cut in its middle, and
    what comes after goes. Other rows stay as they are; null texts cost nothing."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.when(counts, F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0))).otherwise(0)).over(w), F.lit(0))
    out = df.withColumn("_left", (F.lit(most) - used).cast("int")).where(~counts | (F.col("_left") > 0))
    cut = F.when(counts, truncate_tokens(F.col(text), F.col("_left"))).otherwise(F.col(text))
    return out.withColumn(text, cut).drop("_left")


def since_last(df: DataFrame, key: list[str], position: str, marker: Column) -> DataFrame:
    """Rows from the last marker of each key on; all rows of keys without one."""
    last = df.where(marker).groupBy(*key).agg(F.max(position).alias("_last"))
    out = df.join(last, key, "left")
    return out.where(F.col("_last").isNull() | (F.col(position) >= F.col("_last"))).drop("_last")


def latest_then(df: DataFrame, key: str, seq: str, field: str, wanted: list[str]) -> DataFrame:
    """Keys whose latest ``field`` is wanted; what a key was called before never matches."""
    return df.groupBy(key).agg(F.max_by(field, seq).alias(field)).where(F.col(field).isin(*wanted))


def windows_with_all(lines: DataFrame, key: list[str], terms: list[str], line: str, text: str, within: int) -> DataFrame:
    """Smallest line windows (start, stop) of at most ``within`` lines that hold all terms; none holds another of them."""
    w = Window.partitionBy(*key).orderBy(line)
    ahead = w.rangeBetween(0, within - 1)
    hits = [F.min(F.when(F.contains(F.lower(text), F.lit(x.lower())), F.col(line))).over(ahead).alias(f"_t{i}") for i, x in enumerate(terms)]
    some = lines.select(*key, line, text, *hits)
    found = some.where(" and ".join(f"_t{i} is not null" for i in range(len(terms))))
    stop = F.greatest(*[F.col(f"_t{i}") for i in range(len(terms))], F.col(line))
    found = found.select(*key, F.col(line).alias("start"), stop.alias("stop"))
    later = Window.partitionBy(*key).orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    return found.withColumn("_next", F.min("stop").over(later)).where("_next is null or _next > stop").drop("_next")


def rolled_back(df: DataFrame, key: str, order: str, is_turn: Column, back: Column) -> DataFrame:
    """Rows left when each marker takes away the last ``back`` turns before it that are left; rows before a key's first turn stay.

    Forward, a running sum less its own minimum so far tells how many turns are left, and so how many a marker takes. From
    the newest row on, markers add these and turns use them up; a row goes while some are owed. Windows do what a stack would.
    """
    columns = df.columns
    oldest, newest = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))

    def level(w: Window, change: str) -> Column:
        """What a sum that never falls below 0 has come to before each row."""
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.lag(change).over(w), F.lit(0)) - F.least(F.coalesce(F.min(change).over(before), F.lit(0)), F.lit(0))

    rows = df.withColumn("_back", F.greatest(F.coalesce(back, F.lit(0)).cast("long"), F.lit(0)))
    rows = rows.withColumn("_turn", (is_turn & (F.col("_back") == 0)).cast("long"))
    rows = rows.withColumn("_sum", F.sum(F.col("_turn") - F.col("_back")).over(oldest.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_takes", F.least("_back", level(oldest, "_sum")))
    rows = rows.withColumn("_sum", F.sum(F.col("_takes") - F.col("_turn")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("_owed", level(newest, "_sum")).where("_back = 0 and _owed = 0").select(*columns)


def numbered_all(scratch: Scratch, df: DataFrame, order: list, into: str = "n") -> DataFrame:
    """All rows numbered from 1 without a key: sorted in ranges, each of which is counted on from those before."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.keep(rows.select("*", F.monotonically_increasing_id().alias("_id")))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = counts.selectExpr("_part", "sum(_c) over (order by _part) - _c as _before")  # a row per range
    out = rows.withColumn("_part", part).join(before, "_part")
    return out.withColumn(into, F.col("_before") + place + 1).drop("_id", "_part", "_before")
