"""Folds of event streams to rows: metadata, sessions, spans, claims, incremental loads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, key: list[str], seq: str, first: dict[str, Column], last: dict[str, Column], most: dict[str, Column]) -> DataFrame:
    """One row a key: the first, the last and the largest of values that are null where they do not apply."""
    return df.groupBy(*key).agg(
        *[F.min_by(c, F.when(c.isNotNull(), F.col(seq))).alias(k) for k, c in first.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.col(seq))).alias(k) for k, c in last.items()],
        *[F.greatest(F.max(c), F.lit(0)).alias(k) for k, c in most.items()],
    )


def reconcile(new: DataFrame, old: DataFrame, key: str, keep_known: list[str], explicit: dict[str, str]) -> DataFrame:
    """New rows, with what the old row knew where the new one does not, and old values that were set on purpose (``explicit``: column to its
    flag)."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in {*keep_known, *explicit, *explicit.values()}])
    out = new.join(o, key, "left")
    cols = []
    for c in new.columns:
        if c in explicit:
            cols.append(F.when(F.col(f"_o_{explicit[c]}"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c))
        elif c in keep_known:
            cols.append(F.coalesce(c, f"_o_{c}").alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def row_diff(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Names of the columns in which two versions of a row differ; null equals null."""
    other = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    return a.join(other, key).select(*key, names.alias("changed"))


def since(df: DataFrame, watermark: str, last: object, size: int) -> DataFrame:
    """The next batch after a watermark."""
    return df.where(F.col(watermark) > F.lit(last)).orderBy(watermark).limit(size)


def pair_spans(starts: DataFrame, ends: DataFrame, key: list[str], turn_end: DataFrame | None = None) -> DataFrame:
    """Each start with its end, in whatever order they came; what is still open ends with its turn (``turn_end``: key[0], turn_end)."""
    out = starts.join(ends, key, "left")
    if turn_end is None:
        return out.withColumn("state", F.when(F.col("ended").isNull(), "open").otherwise("closed"))
    out = out.join(turn_end, key[0], "left")
    state = F.when(F.col("ended").isNotNull(), "closed").when(F.col("turn_end").isNotNull(), "with_turn").otherwise("open")
    return out.withColumn("state", state).withColumn("ended", F.coalesce("ended", "turn_end")).drop("turn_end")


def transitions(df: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """How often each state follows each."""
    w = Window.partitionBy(*key).orderBy(order)
    pairs = df.select(F.col(state).alias("source"), F.lead(state).over(w).alias("target")).where("target is not null")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


def claim(jobs: DataFrame, now: int) -> DataFrame:
    """What a worker that asks for each job is told. jobs: input_watermark, done_watermark, lease_until, retry_at."""
    outcome = (
        F.when(F.col("done_watermark") >= F.col("input_watermark"), "up_to_date")
        .when(F.coalesce("lease_until", F.lit(0)) > now, "running")
        .when(F.coalesce("retry_at", F.lit(0)) > now, "backoff")
        .otherwise("claimed")
    )
    return jobs.withColumn("outcome", outcome)


def not_imported(df: DataFrame, ledger: DataFrame, content: Column) -> DataFrame:
    """Rows whose content hash is not in the ledger, with the hash."""
    return df.withColumn("hash", F.sha2(content, 256)).join(ledger.select("hash").distinct(), "hash", "left_anti")


def map_job(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, slots: int = 16) -> DataFrame:
    """``work`` over batches of rows in ``slots`` tasks; a row whose work raises is ``failed`` with the error, others go on."""

    full = f"{schema}, status string, error string"
    arrow = to_arrow_schema(T.StructType.fromDDL(full))

    def done(rows: pd.DataFrame, status: str, error: str | None) -> list[dict]:
        return [{k: None if v is None or v != v else v for k, v in r.items()} | {"status": status, "error": error} for r in rows.to_dict("records")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.to_pandas()
            try:
                rows = done(work(b), "completed", None)
            except Exception:
                rows = []
                for i in range(len(b)):
                    one = b.iloc[i : i + 1]
                    try:
                        rows += done(work(one), "completed", None)
                    except Exception as e:
                        rows += done(one, "failed", str(e))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.repartition(min(max(slots, 1), 64)).mapInArrow(run, full)


def snapshot_match(old: DataFrame, new: DataFrame, key: str, seq: str, content: str) -> DataFrame:
    """Items of a new snapshot with the old item of equal content, the k-th with the k-th, each used once; null: new."""
    w = Window.partitionBy(key, content).orderBy(seq)
    o = old.select(key, content, F.col(seq).alias("old_seq"), F.row_number().over(w).alias("_k"))
    n = new.select(key, content, seq, F.row_number().over(w).alias("_k"))
    return n.join(o, [key, content, "_k"], "left").select(key, seq, "old_seq")
