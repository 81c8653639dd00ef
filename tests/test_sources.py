"""Line numbers over splits, tables published together, loads taken up again."""

import pytest
from pyspark.sql import functions as F

from skein.operators import dml
from skein.sources import files, numbered
from skein.sources.published import Store, backfill


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "4096")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_numbers_of_several_splits(spark, tmp_path, small_splits):
    want = {}
    for name, n in (("a", 3000), ("b", 1), ("c", 777), ("d", 0)):
        text = [f"{name} line {k} " + "x" * (k % 50) if k % 7 else "" for k in range(n)]
        (tmp_path / name).write_text("\r\n".join(text) + ("\n" if n else ""))
        want |= {(name, k + 1): t for k, t in enumerate(text)}
    df = numbered.numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 8
    got = df.collect()
    assert {(r.path.rsplit("/")[-1], r.line): r.value for r in got} == want and len(got) == len(want)
    counts = {r.path.rsplit("/")[-1]: (r.size, r.n_lines) for r in numbered.file_identity(spark, str(tmp_path)).collect()}
    assert counts == {n: ((tmp_path / n).stat().st_size, k) for n, k in (("a", 3000), ("b", 1), ("c", 777))}


def test_strict_json_tells_the_line(spark, tmp_path, small_splits):
    p = tmp_path / "a.jsonl"
    lines = [f'{{"a": {k}}}' if k % 10 else " " for k in range(4000)]
    p.write_text("\n".join(lines))
    assert sorted(r.a for r in files.read_jsonl(spark, str(p), "a int", strict=True).collect()) == [k for k in range(4000) if k % 10]
    assert {(r.line, r.a) for r in numbered.strict_json(spark, str(p), "a int").collect()} == {(k + 1, k) for k in range(4000) if k % 10}
    lines[3120] = '{"a": '
    lines[3501] = "[]"
    p.write_text("\n".join(lines))
    with pytest.raises(ValueError, match="a.jsonl: line 3121 is not valid"):
        files.read_jsonl(spark, str(p), "a int", strict=True)


def test_csv_jobs_of_several_splits(spark, tmp_path, small_splits):
    p = tmp_path / "a.csv"
    rows = [f'{k},"name, {k}"' if k % 9 else (',""' if k % 2 else "") for k in range(2000)]
    p.write_text('﻿id,"last, first"\n' + "\n".join(rows) + "\n", encoding="utf-8")
    df = files.read_csv_job(spark, str(p))
    assert df.columns == ["row_index", "id", "last, first"]
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [(n, str(k), f"name, {k}") for n, k in enumerate(k for k in range(2000) if k % 9)]
    rows[1500] = "1,2,3"
    rows[1700] = "1"
    p.write_text("id,name\n" + "\n".join(rows) + "\n")
    with pytest.raises(ValueError, match="csv row 1502 has"):
        files.read_csv_job(spark, str(p))
    p.write_text('a,"a"\n1,2\n')
    with pytest.raises(ValueError, match="repeated"):
        files.read_csv_job(spark, str(p))


def test_line_at_guards_the_file(spark, tmp_path):
    p = tmp_path / "log"
    p.write_text("a\nb\nc\n")
    known = spark.createDataFrame(numbered.file_identity(spark, str(p)).collect())
    p.write_text("a\nb\nc\nd\n")
    assert [r.value for r in numbered.line_at(spark, str(p), 3, known).collect()] == ["d"]
    assert numbered.line_at(spark, str(p), 9, known).count() == 0
    p.write_text("z\n")
    with pytest.raises(ValueError, match="not the log"):
        numbered.line_at(spark, str(p), 0, known)


def items(spark, n, fail=False):
    df = spark.range(n).select("id", F.concat(F.lit("n"), "id").alias("name"))
    return df.withColumn("name", F.when(F.col("id") < 10**9, F.raise_error(F.lit("lost"))).otherwise(F.col("name")).cast("string")) if fail else df


def publish(store, name, df):
    return dml.publish_job(store, {"id": name}, df, "id", ["name"], "id", "2024-01-02 03:04:05")


def test_job_and_items_show_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="no table"):
        store.read("jobs")
    assert publish(store, "one", items(spark, 5)) == 1
    with pytest.raises(Exception, match="lost"):  # the job's row is written, its items fail
        publish(store, "two", items(spark, 5, fail=True))
    assert store.versions() == [1]
    assert [r.id for r in store.read("jobs").collect()] == ["one"] and store.read("job_items").count() == 5
    assert publish(store, "two", items(spark, 3)) == 2
    assert store.read("job_items").count() == 8 and store.read("job_items", 1).count() == 5
    gone = spark.createDataFrame([("one",)], "id string")
    bad = {"jobs": "id", "nothing": "job_id"}
    with pytest.raises(ValueError, match="no table nothing"):
        dml.publish_delete(store, gone, bad, "id")
    assert dml.publish_delete(store, gone, {"jobs": "id", "job_items": "job_id"}, "id") == 3
    assert [r.id for r in store.read("jobs").collect()] == ["two"] and {r.job_id for r in store.read("job_items").collect()} == {"two"}
    assert store.vacuum(keep=1) == 6 and store.read("job_items").count() == 3  # four of older versions, two that nobody saw
    with pytest.raises(ValueError, match="no version 1"):
        store.read("jobs", 1)


def test_slower_writer_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(add={"t": spark.range(2)})
    now = store.manifest()
    other = Store(spark, store.root)
    other.manifest = lambda version=None: now
    store.commit(add={"t": spark.range(3)})
    with pytest.raises(ValueError, match="another writer"):
        other.commit(add={"t": spark.range(100)})
    assert store.read("t").count() == 5
    with pytest.raises(ValueError, match="other columns"):
        store.commit(add={"t": spark.range(1).select(F.lit("x").alias("y"))})
    store.rewrite("t", lambda d: d.withColumn("twice", F.col("id") * 2))
    assert store.read("t").columns == ["id", "twice"] and store.read("t", 2).columns == ["id"]
    store.compact("t")
    assert store.read("t").count() == 5 and len(store.manifest()["tables"]["t"]["folders"]) == 1


def test_backfill_is_taken_up_again(spark, tmp_path):
    source = spark.createDataFrame([(f"2024/{k // 3:03d}.jsonl", k) for k in range(50)] + [(None, 99)], "path string, k long")
    store, seen = Store(spark, f"file://{tmp_path}/s"), []

    def make(fail):
        def rows(batch, number):
            seen.append(number)
            if number == fail:
                batch = batch.withColumn("k", F.raise_error(F.lit("lost")).cast("long"))
            return {"rows": batch, "counts": batch.groupBy().agg(F.count("*").alias("n"))}

        return rows

    with pytest.raises(Exception, match="lost"):
        backfill(store, "load", source, "path", make(3), 10)
    assert store.manifest()["notes"]["load"]["batch"] == 2 and store.read("rows").count() == 24
    loaded = backfill(store, "load", source, "path", make(None), 10)
    assert seen[:3] == [1, 2, 3] and seen[3:] == list(range(3, 3 + loaded))
    assert sorted(r.k for r in store.read("rows").collect()) == list(range(50))
    assert sum(r.n for r in store.read("counts").collect()) == 50
    assert backfill(store, "load", source, "path", make(None), 10) == 0
    later = source.union(spark.createDataFrame([("2025/000.jsonl", 50)], source.schema))
    assert backfill(store, "load", later, "path", make(None), 10) == 1 and store.read("rows").count() == 51
