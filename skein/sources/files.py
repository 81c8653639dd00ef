"""Sources: JSON lines, session trees, CSV jobs, line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.offsets import truncate_tokens
from skein.sources.numbered import first_bad, numbered_lines, strict_json


def jsonl_permissive(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of JSON text parsed to ``schema``; blank and malformed lines are left out."""
    parsed = F.from_json(F.col(column), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fine = lines.where(F.trim(column) != "").withColumn("_j", parsed).where("_j is not null and _j._bad is null")
    return fine.select(*[c for c in lines.columns if c != column], "_j.*").drop("_bad")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; ``strict`` raises ValueError with the number of the first malformed line, else such lines are left out. Blank
    lines give no row."""
    if strict:
        return strict_json(spark, path, schema).drop("path", "line")
    return jsonl_permissive(spark.read.text(path), "value", schema)


def newest_first(df: DataFrame, position: str, n: int, accept: Column | None = None) -> DataFrame:
    """The ``n`` newest accepted records of an append log; rejected ones do not count."""
    return (df if accept is None else df.where(accept)).orderBy(F.desc(position)).limit(n)


def session_files(spark: SparkSession, root: str, archived: str = "archived_sessions") -> DataFrame:
    """All session files below ``root``: path (their watermark), size, and whether they lie in the archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return files.select("path", "length", F.col("path").contains(f"/{archived}/").alias("archived"))


def read_csv_job(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings, a byte order mark allowed; a row is a line, blank ones are skipped. Ragged rows and repeated
    headers raise ValueError, the first with the number of its line (the header is 1), on files of any number of splits; rows of
    empty fields only are skipped. Adds ``row_index`` from 0 of all rows kept."""
    head = spark.read.option("header", "false").csv(path).first()
    if head is None:
        raise ValueError("csv has no header")
    names = [(h or "").strip() for h in head]
    names[0] = names[0].lstrip("\ufeff")
    if len(set(names)) != len(names):
        raise ValueError("csv header has a repeated column")
    bad = "_ragged"
    while bad in names:
        bad += "_"
    fields = [T.StructField(n, T.StringType()) for n in [*names, bad]]
    lines = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim("value") != ""))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in fields)
    rows = lines.select("path", "line", F.from_csv("value", F.lit(ddl), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("_r"))
    if first := first_bad(rows, F.col("_r").isNull() | F.col("_r").getField(bad).isNotNull()):
        raise ValueError(f"csv row {first[1]} has a wrong number of fields")
    field = lambda n: F.coalesce(F.col("_r").getField(n), F.lit(""))
    rows = rows.where(F.greatest(*[F.length(field(n)) for n in names], F.lit(0)) > 0)
    # Rows skipped are few: numbers are those of lines, less the rows skipped before, summed by blocks of lines.
    block = F.floor(F.col("line") / 100_000)
    counts = rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_c"))
    before = counts.selectExpr("_block", "sum(_c) over (order by _block) - _c as _before")  # a row per 100,000 lines
    place = F.row_number().over(Window.partitionBy("_block").orderBy("line")) - 1
    rows = rows.withColumn("_block", block).withColumn("_place", place).join(before, "_block")
    return rows.select((F.col("_before") + F.col("_place")).alias("row_index"), *[field(n).alias(n) for n in names])


def nth_row(df: DataFrame, order: list[str], n: int, within: list[str] | None = None) -> DataFrame:
    """The row at place ``n`` (from 0) of an ordered log, for each key of ``within``; without keys, of the whole log."""
    if not within:
        return df.orderBy(*order).offset(n).limit(1)
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") == n).drop("_n")


def line_window(text: Column, first: int, most: int) -> Column:
    """Struct of ``content`` (at most ``most`` lines from line ``first``, counted from 1) and ``truncated`` (more follow)."""
    lines = F.split(text, "\n")
    return F.struct(
        F.array_join(F.slice(lines, first, most), "\n").alias("content"), (F.size(lines) > first - 1 + most).alias("truncated")
    )


def line_window_tokens(text: Column, first: int, most: int, tokens: int) -> Column:
    """``line_window`` whose content has at most ``tokens`` tokens of about four bytes; ``truncated`` also where these cut it."""
    w = line_window(text, first, most)
    content = truncate_tokens(w["content"], tokens)
    return F.struct(content.alias("content"), (w["truncated"] | (content != w["content"])).alias("truncated"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings: UTF-8 with or without a byte order mark, else GB 18030. A file is UTF-8 unless some of its
    bytes are not."""
    other = spark.read.text(path).where(~F.is_valid_utf8("value"))  # lines keep their bytes
    encoding = "UTF-8" if other.isEmpty() else "GB18030"
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark reads Unicode and Latin sets only
    out = spark.read.option("header", "true").option("encoding", encoding).option("multiLine", "true").csv(path)
    return out.toDF(*[c.lstrip("\ufeff") for c in out.columns])


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark before it, in one file per task, for spreadsheet programs."""
    named = df.select(*[F.col(f"`{c}`").alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(df.columns)])
    named.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)
