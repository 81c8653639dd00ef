"""Shared pieces of the training-data operators: scratch tables, ranked rows, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.scratch import Scratch, shared_dir  # noqa: F401
from skein.session import small_batches  # noqa: F401

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names; ``unpacked`` gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def unpacked(columns: list[str], row: str) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def bits_for(rows: int, most: int = 26) -> int:
    """Bits (as a power of two) of a bitmap for so many hashes: 16 each, at most 2**``most`` (a table of 2**``most`` / 64 rows)."""
    return min(most, max(12, (16 * rows).bit_length()))


def _marks(wanted: DataFrame, h: str, bits: int) -> DataFrame:
    """Hashes as marks in a bitmap of 2**bits bits. It has at most 2**bits / 64 rows however many hashes there
    are, so it can be broadcast."""
    marks = wanted.select(_word(F.col(h), bits).alias("_word"), _bit(F.col(h)).alias("_bit"))
    return F.broadcast(marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def _word(h: Column, bits: int) -> Column:
    return F.shiftright(F.pmod(h, F.lit(1 << bits)), 6).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def likely(df: DataFrame, h: str, wanted: DataFrame, bits: int = 22) -> DataFrame:
    """Rows of ``df`` whose hash ``h`` may be among those of ``wanted``, kept back before a shuffle; a join must follow.
    Where the bitmap fills up, more rows pass."""
    out = df.withColumn("_word", _word(F.col(h), bits)).join(_marks(wanted, h, bits), "_word")
    return out.where(F.col("_bits").bitwiseAND(_bit(F.col(h))) != 0).drop("_word", "_bits")


def parted(df: DataFrame, h: str, wanted: DataFrame, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose hash ``h`` may be among those of ``wanted``, and those that need no join."""
    out = df.withColumn("_word", _word(F.col(h), bits)).join(_marks(wanted, h, bits), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(F.col(h))) != 0, F.lit(False))
    return tuple(out.where(c).drop("_word", "_bits") for c in (hit, ~hit))


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v): one row (id, component) per id that has an edge; the
    component is its smallest id.

    Alternates the large-star and small-star steps; each is an aggregate that combines before the shuffle and
    a join that adaptive execution can split, so a hub with many links needs no large group anywhere.
    """
    e = scratch.keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    total = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
    before = total(e)
    cores = scratch.spark.sparkContext.defaultParallelism
    for _ in range(most_rounds):
        parts = max(cores, before[0] // 100_000 + 1)  # few links: few files
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join deals both sides anew and can split a hub's rows.
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v"), parts)
        scratch.drop(low)
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), parts)
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v")
        new = scratch.keep(small.distinct(), parts)
        now = total(new)
        scratch.drop(e, large, low)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
