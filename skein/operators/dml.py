"""Writes as functions from tables to tables: upserts, deletes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.published import Store


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """All columns of the row with the largest ``seq`` of each key. An aggregate, so rows combine before the shuffle."""
    rest = [c for c in old.columns if c not in key]
    last = old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_fields(rows: DataFrame, key: list[str], seq: str, first: dict[str, str], last: dict[str, str]) -> DataFrame:
    """Of each key, some fields of the first row and others of the last."""
    return rows.groupBy(*key).agg(
        *[F.min_by(c, seq).alias(k) for k, c in first.items()], *[F.max_by(c, seq).alias(k) for k, c in last.items()]
    )


def insert_ignore(have: DataFrame, come: DataFrame, key: list[str]) -> DataFrame:
    """``have`` and those rows of ``come`` whose key it lacks."""
    return have.unionByName(come.join(have.select(*key), key, "left_anti"))


def insert_job(job: dict[str, object], items: DataFrame, item_id: str, row: list[str], order: str, at: str) -> tuple[DataFrame, DataFrame]:
    """A new job and its items, all pending, as rows of the tables jobs and job items. ``row`` are the columns kept as JSON.

    ``publish_job`` shows both at once or neither.
    """
    when = F.lit(at).cast("timestamp_ntz")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    head = items.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in job.items()], F.lit("pending").alias("status"), when.alias("created_at"), when.alias("updated_at"), *none("timestamp_ntz", "started_at", "completed_at"), *none("string", "last_error"))
    rows = items.select(
        F.lit(job["id"]).alias("job_id"), F.col(item_id).cast("string").alias("item_id"), F.col(order).cast("long").alias("row_index"), F.to_json(F.struct(*row)).alias("row_json"),
        F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempt_count"), when.alias("created_at"), when.alias("updated_at"),
        *none("string", "assigned_thread_id", "result_json", "last_error"), *none("timestamp_ntz", "completed_at", "reported_at"),
    )
    return head, rows


def publish_job(store: Store, job: dict[str, object], items: DataFrame, item_id: str, row: list[str], order: str, at: str) -> int:
    """``insert_job`` into the tables ``jobs`` and ``job_items`` of a store, in one version; its number."""
    head, rows = insert_job(job, items, item_id, row, order, at)
    return store.commit(add={"jobs": head, "job_items": rows})


def publish_delete(store: Store, gone: DataFrame, tables: dict[str, str], key: str) -> int:
    """Delete the rows of some keys from several tables (name to its key column) in one version; its number."""
    have = {k: (store.read(k), c) for k, c in tables.items()}
    return store.commit(replace=cascade_delete(gone, have, key))


def accept_until(rows: DataFrame, key: list[str], seq: str, terminal: Column, flag: str) -> DataFrame:
    """Whether each change is accepted: none is after the first terminal one of its key."""
    end = rows.where(terminal).groupBy(*key).agg(F.min(seq).alias("_end"))
    return rows.join(end, key, "left").withColumn(flag, F.coalesce(F.col(seq) <= F.col("_end"), F.lit(True))).drop("_end")


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted keys."""
    return {k: d.join(gone.select(F.col(key).alias(c)).distinct(), c, "left_anti") for k, (d, c) in tables.items()}


def csv_ready(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns as CSV text: structs and arrays as JSON, times as RFC 3339, null as an empty string."""

    def text(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[F.col(f.name) if f.name in keep else text(f) for f in df.schema])


def retain_tail(df: DataFrame, key: list[str], position: str, size: Column, cap: int, soft: float = 0.8) -> DataFrame:
    """The newest rows of each log that fit in ``soft`` of the cap where the log is over it; the newest always stays."""
    newest = Window.partitionBy(*key).orderBy(F.desc(position))
    running = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_b", running).withColumn("_n", F.row_number().over(newest))
    rows = rows.withColumn("_all", F.sum(size).over(Window.partitionBy(*key)))
    return rows.where((F.col("_all") <= cap) | (F.col("_n") == 1) | (F.col("_b") <= int(cap * soft))).drop("_b", "_n", "_all")


def prune_caps(df: DataFrame, key: list[str], order: list[Column], size: Column, rows: int, cap: int) -> DataFrame:
    """Of each partition, the newest rows within both a number of rows and a number of bytes."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("_n") <= rows) & (F.col("_b") <= cap)).drop("_n", "_b")


def retain_since(df: DataFrame, when: Column, cutoff: str) -> DataFrame:
    """Rows later than the cutoff, and those whose time cannot be read. A row exactly at the cutoff goes."""
    return df.where(when.isNull() | (when > F.lit(cutoff).cast("timestamp")))


def derived(df: DataFrame, column: str, default: Column) -> DataFrame:
    """``column`` where it is neither null nor 0, else the default."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0)), default))
