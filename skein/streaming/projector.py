"""Structured Streaming: projecting an event log to tables, once each and in order of arrival; waiting for what an event needs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema: str, files: int = 4) -> DataFrame:
    """New files of a folder of Parquet event logs, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(path)


def append(stream: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows of a stream to a folder, once each, in micro-batches: by an interval (``every``), else all there is at once; how many
    rows a batch has at most is set where it is read (see ``tail``)."""
    w = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def project(
    stream: DataFrame, target: str, checkpoint: str, key: list[str], seq: str, first: dict[str, str], last: dict[str, str],
    parts: int = 16, every: str | None = None, contiguous: bool = False,
) -> StreamingQuery:
    """Keep a table of one row a key: some fields of its first event, others of its last.

    Keys are dealt by hash to ``parts`` parts, and a batch writes only the parts it has keys of, to a folder of its own number: a
    batch that runs again reads what was there before it and overwrites itself. Versions that no batch can ask for any
    more are deleted. ``contiguous``: the stream fails, and nothing is written, unless the events of each key follow one another
    from 0 without gaps, also from batch to batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*key).agg(
            F.count("*").alias("_n"), F.min(seq).alias("_first"), F.max(seq).alias("_last"),
            *[F.min_by(c, seq).alias(k) for k, c in first.items()], *[F.max_by(c, seq).alias(k) for k, c in last.items()],
        ).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("_part").distinct().collect()]  # at most ``parts``
            have = _versions(spark, target)
            before = {p: [v for v in have.get(p, []) if v < number] for p in touched}
            old = [f"{target}/{max(v)}/_part={p}" for p, v in before.items() if v]
            merged = new.drop("_n", "_part")
            if old:
                state = spark.read.parquet(*old)
                merged = merged.unionByName(state)
            if contiguous:
                upto = state.select(*key, F.col("_last").alias("_upto")) if old else new.select(*key, F.lit(-1).alias("_upto")).limit(0)
                gap = (F.col("_first") != F.coalesce("_upto", F.lit(-1)) + 1) | (F.col("_n") != F.col("_last") - F.col("_first") + 1)
                bad = new.join(upto, key, "left").where(gap).limit(1).collect()
                if bad:
                    raise ValueError(f"events of {[bad[0][k] for k in key]} do not follow what was projected")
            merged = merged.groupBy(*key).agg(
                F.min("_first").alias("_f"), F.max("_last").alias("_l"), *[F.min_by(k, "_first").alias(k) for k in first], *[F.max_by(k, "_last").alias(k) for k in last]
            )
            merged = merged.withColumnsRenamed({"_f": "_first", "_l": "_last"}).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
            merged.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{target}/{number}")
        finally:
            new.unpersist()
        for p, v in before.items():
            for gone in sorted(v)[:-1]:  # the last of these is what this batch would read if it ran again
                _delete(spark, f"{target}/{gone}/_part={p}")

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _folder(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, where: str) -> None:
    path, fs = _folder(spark, where)
    fs.delete(path, True)


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Numbers of the batches that wrote each part and have ended (Spark marks their folders last); few, as old ones are deleted."""
    path, fs = _folder(spark, f"{target}/*/_SUCCESS")
    ended = {f.getPath().getParent().getName() for f in fs.globStatus(path) or []}
    path, fs = _folder(spark, f"{target}/*/_part=*")
    out: dict[int, list[int]] = {}
    for f in fs.globStatus(path) or []:
        if (number := f.getPath().getParent().getName()) in ended:
            out.setdefault(int(f.getPath().getName().split("=")[1]), []).append(int(number))
    return out


def projected(spark: SparkSession, target: str, batches: int | None = None) -> DataFrame:
    """The table as it was after so many batches (the last or the one before), or now. What a batch that has not ended wrote does not
    count."""
    have = {p: [x for x in v if batches is None or x < batches] for p, v in _versions(spark, target).items()}
    return spark.read.parquet(*[f"{target}/{max(v)}/_part={p}" for p, v in have.items() if v]).drop("_first", "_last")


def dedup(stream: DataFrame, keys: list[str], at: str, within: str = "10 minutes") -> DataFrame:
    """Each combination of keys once; what was seen is forgotten after ``within`` of event time."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def ordered(stream: DataFrame, key: str, ordinal: str, payload: str) -> DataFrame:
    """Events of each key in the order of their ordinals from 0: one that comes early waits for those before it."""
    kind = stream.schema[key].dataType.simpleString()

    def release(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, held = state.get if state.exists else (0, "{}")
        wait = {int(i): p for i, p in pd.read_json(held, typ="series", dtype=False).items()} if held != "{}" else {}
        for b in batches:
            wait.update({int(i): p for i, p in zip(b[ordinal], b[payload], strict=True) if i >= due})
        out = []
        while due in wait:
            out.append((k[0], due, wait.pop(due)))
            due += 1
        state.update((due, pd.Series(wait).to_json() if wait else "{}"))
        yield pd.DataFrame(out, columns=[key, ordinal, payload])

    return stream.groupBy(key).applyInPandasWithState(
        release, f"{key} {kind}, {ordinal} long, {payload} string", "due long, held string", "append", GroupStateTimeout.NoTimeout
    )
