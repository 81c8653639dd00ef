"""Unified diffs and places of line sequences in files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as fn


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Added and deleted lines of unified diffs (id, diff): (id, path, sign, text). Inside a hunk a line that begins with ``+++``
    or ``---`` is content; a hunk lasts for as many lines as its head says."""
    each = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("p", "x"))
    w = Window.partitionBy("id").orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    head = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"
    is_head = F.rlike("x", F.lit(head))
    size = lambda g: F.when(F.regexp_extract("x", head, g) == "", 1).otherwise(F.regexp_extract("x", head, g).try_cast("int"))
    d = each.withColumn("hunk", F.sum(is_head.cast("int")).over(upto))
    of = Window.partitionBy("id", "hunk").orderBy("p")
    d = d.withColumn("old", F.first(F.when(is_head, size(1)), True).over(of)).withColumn("new", F.first(F.when(is_head, size(2)), True).over(of))
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    body = ~is_head & (F.col("hunk") > 0)
    sign = F.substr("x", F.lit(1), F.lit(1))
    used = lambda signs: F.coalesce(F.sum((body & sign.isin(*signs)).cast("int")).over(before), F.lit(0))
    d = d.withColumn("_o", used(["-", " "])).withColumn("_n", used(["+", " "]))
    inside = body & ((F.col("_o") < F.col("old")) | (F.col("_n") < F.col("new")))
    name = F.when(~inside & F.rlike("x", F.lit(r"^\+\+\+ ")), F.regexp_extract("x", r"^\+\+\+ (?:b/)?(\S+)", 1))
    d = d.withColumn("path", F.last(name, True).over(upto)).withColumn("_in", inside)
    return d.where(F.col("_in") & sign.isin("+", "-")).select("id", "path", sign.alias("sign"), F.expr("substr(x, 2)").alias("text"))


def diff_summary(diffs: DataFrame, domain: str) -> DataFrame:
    """Added and deleted lines of each diff, and fingerprints of the added lines that say something."""
    d = diff_lines(diffs).withColumn("_e", fn.effective_line(F.col("text")))
    plus = F.col("sign") == "+"
    return d.groupBy("id").agg(
        F.count(F.when(plus, 1)).alias("added"), F.count(F.when(~plus, 1)).alias("deleted"),
        F.sort_array(F.collect_list(F.when(plus & F.col("_e").isNotNull(), fn.fingerprint(domain, F.col("_e"))))).alias("fingerprints"),
    )


def _plain(x: Column) -> Column:
    """Trimmed, with typographic dashes, quotes and spaces as their ASCII forms."""
    dashes, single, double, blanks = "‐‑‒–—―−", "‘’‚‛", "“”„‟", "     　"
    to = "-" * len(dashes) + "'" * len(single) + '"' * len(double) + " " * len(blanks)
    return F.trim(F.translate(x, dashes + single + double + blanks, to))


def seek(files: DataFrame, pattern: list[str], start: int = 0) -> DataFrame:
    """Where a sequence of lines first stands in each file (id, lines) from ``start`` on: place and how strict the match is
    (0 as it is, 1 without blanks at the end, 2 trimmed, 3 in plain characters). An empty sequence stands at ``start``."""
    if not pattern:
        return files.select("id", F.lit(start).alias("place"), F.lit(0).alias("level"))
    forms = [lambda x: x, lambda x: F.rtrim(x), lambda x: F.trim(x), _plain]
    places = F.sequence(F.lit(start), F.size("lines") - len(pattern))
    found = []
    for form in forms:
        wanted = [form(F.lit(p)) for p in pattern]

        def at(i: Column, form=form, wanted=wanted) -> Column:
            return reduce(lambda a, b: a & b, [form(F.get("lines", i + k)) == v for k, v in enumerate(wanted)])

        found.append(F.when(F.size("lines") >= start + len(pattern), F.array_min(F.filter(places, _one(at)))))
    level = F.coalesce(*[F.when(f.isNotNull(), F.lit(k)) for k, f in enumerate(found)])
    return files.select("id", F.coalesce(*found).alias("place"), level.alias("level"))


def _one(f):
    """As a function of one argument, which is what Spark's lambdas look at."""
    return lambda i: f(i)


def best_part(text: Column, most: int = 240) -> Column:
    """Of the parts of a text between bars: one with CJK characters, with the most of these, the shortest; cut at ``most``."""
    parts = F.filter(F.array_distinct(F.transform(F.split(text, r"\|"), lambda p: fn.collapse(p))), lambda p: p != "")
    n = lambda p: F.regexp_count(p, F.lit(fn.CJK))
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-n(p)).alias("n"), F.length(p).alias("size"), i.alias("i"), p.alias("p"))))
    return F.substr(F.get(ranked, 0)["p"], F.lit(1), F.lit(most))
