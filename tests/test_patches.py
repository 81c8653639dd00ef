from pyspark.sql import functions as F

from skein.operators import patches

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,5 @@
 keep
-old line
+new line
+++ odd = 1
+}
 end
"""


def test_diff(spark):
    df = spark.createDataFrame([(1, DIFF)], "id int, diff string")
    assert [(r.path, r.sign, r.text) for r in patches.diff_lines(df).collect()] == [("x.py", "-", "old line"), ("x.py", "+", "new line"), ("x.py", "+", "++ odd = 1"), ("x.py", "+", "}")]
    r = patches.diff_summary(df, "repo").first()
    assert (r.added, r.deleted, len(r.fingerprints)) == (3, 1, 2)


def test_seek(spark):
    files = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "b  ", "c"]), (3, [" b", "c "]), (4, ["“b”", "c"]), (5, [])], "id int, lines array<string>")
    got = {r.id: (r.place, r.level) for r in patches.seek(files, ["b", "c"]).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (0, 2), 4: (None, None), 5: (None, None)}
    assert [r.level for r in patches.seek(files.where("id = 4"), ['"b"', "c"]).collect()] == [3]
    assert patches.seek(files, []).where("place <> 0").count() == 0


def test_best_part(spark):
    df = spark.createDataFrame([("motor | 电机启动 | 电机",), ("a|bb",), ("",)], "t string")
    assert [r.b for r in df.select(patches.best_part(F.col("t")).alias("b")).collect()] == ["电机启动", "a", None]
