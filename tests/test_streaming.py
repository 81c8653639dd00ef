import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import dml
from skein.streaming import projector


def test_projection_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
    for i in range(3):
        e.where(f"event_id % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / "log" / f"p{i}"))
    stream = projector.tail(spark, str(tmp_path / "log" / "*"), "event_id long, user_id long, event_type string, value double", 1)
    q = projector.project(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["user_id"], "event_id", {"first_ordinal": "event_id"}, {"status": "event_type", "value": "value"})
    q.awaitTermination(120)
    got = projector.projected(spark, str(tmp_path / "out"), 3)
    want = dml.upsert_fields(e, ["user_id"], "event_id", {"first_ordinal": "event_id"}, {"status": "event_type", "value": "value"})
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_early_events_wait(spark, tmp_path):
    for n, part in enumerate([[("k", 1, "b"), ("k", 3, "d")], [("k", 0, "a")], [("k", 2, "c")]]):
        spark.createDataFrame(pd.DataFrame(part, columns=["k", "i", "p"])).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = projector.tail(spark, str(tmp_path / "in" / "*"), "k string, i long, p string", 1)
    q = projector.ordered(stream, "k", "i", "p").writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.p for r in spark.table("released").orderBy("i").collect()] == ["a", "b", "c", "d"]


def test_dedup_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], "k string, t string")
    rows.select("k", F.to_timestamp("t").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = projector.tail(spark, str(tmp_path / "in"), "k string, t timestamp")
    q = projector.dedup(stream, ["k"], "t").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("once").collect()) == ["a", "b"]


def test_projection_of_gapless_logs(spark, tmp_path):
    schema = "k string, i long, p string"
    for n, part in enumerate([[("a", 0, "x"), ("b", 0, "y")], [("a", 1, "z"), ("a", 2, "w")], [("b", 2, "v")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "log" / f"p{n}"))

    def run(files):
        stream = projector.tail(spark, str(tmp_path / "log" / files), schema, 1)
        return projector.project(stream, str(tmp_path / "out"), str(tmp_path / f"ck{len(files)}"), ["k"], "i", {"start": "p"}, {"end": "p"}, parts=3, contiguous=True)

    run("p[01]").awaitTermination(120)
    assert sorted(map(tuple, projector.projected(spark, str(tmp_path / "out")).select("k", "start", "end").collect())) == [("a", "x", "w"), ("b", "y", "y")]
    with pytest.raises(Exception, match="do not follow"):
        stream = projector.tail(spark, str(tmp_path / "log" / "p2"), schema, 1)
        q = projector.project(stream, str(tmp_path / "other"), str(tmp_path / "ck"), ["k"], "i", {"start": "p"}, {"end": "p"}, contiguous=True)
        q.awaitTermination(120)


def test_old_versions_go(spark, tmp_path):
    for n in range(4):
        spark.createDataFrame([("a", n, "x")], "k string, i long, p string").coalesce(1).write.parquet(str(tmp_path / "log" / f"p{n}"))
    stream = projector.tail(spark, str(tmp_path / "log" / "*"), "k string, i long, p string", 1)
    projector.project(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "i", {"s": "p"}, {"e": "p"}, parts=4).awaitTermination(120)
    assert len(list((tmp_path / "out").glob("*/_part=*"))) == 2


def test_append_by_interval(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n,)], "i int").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    q = projector.append(projector.tail(spark, str(tmp_path / "in" / "*"), "i int", 1), str(tmp_path / "out"), str(tmp_path / "ck"), "200 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
