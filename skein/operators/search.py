"""Search over texts, lines and threads; budgets, ids and manifests of listed items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as fn
from skein.operators import paging
from skein.scratch import Scratch


def within_budget(df: DataFrame, key: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Items in order while a budget lasts: whole, the one that crosses it cut, the rest omitted."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    fate = F.when(F.col("_before") >= budget, "omitted").when(F.col("_before") + F.col(size) > budget, "cut").otherwise("whole")
    tokens = F.when(F.col("_before") >= budget, 0).otherwise(F.least(F.col(size), budget - F.col("_before"))).cast("long")
    return out.withColumns({"fate": fate, "tokens": tokens}).drop("_before")


def unique_ids(df: DataFrame, base: str, order: str, into: str) -> DataFrame:
    """Each row's name, or with the first of -2, -3 ... that no row before it has got, in order.

    Only names with a common stem (the name without numbers behind hyphens) can meet. Rows whose stem has one name
    only are numbered by a window; the others pass sorted through their task in batches, which holds the ids of one stem.
    """
    stem = F.regexp_replace(base, r"(-\d+)+$", "")
    rows = df.withColumn("_stem", stem)
    mixed = rows.groupBy("_stem").agg(F.min(base).alias("_a"), F.max(base).alias("_b")).where("_a <> _b").select("_stem")
    plain = rows.join(mixed, "_stem", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("_stem").orderBy(order)))
    plain = plain.withColumn(into, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_n").cast("string"))))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken, following = None, set(), {}
        for b in batches:
            out = []
            for s, name in zip(b["_stem"], b[base], strict=True):
                if s != at:
                    at, taken, following = s, set(), {}
                new, k = name, following.get(name, 2)
                while new in taken:
                    new, k = f"{name}-{k}", k + 1
                following[name] = k
                taken.add(new)
                out.append(new)
            yield b.assign(**{into: out})

    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    folded = rows.join(mixed, "_stem", "left_semi").repartition("_stem").sortWithinPartitions("_stem", order).select(*rows.columns).mapInPandas(fold, schema)
    return plain.drop("_n", "_stem").select(*df.columns, into).unionByName(folded.drop("_stem"))


def verify_manifest(have: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Files (key, digest) against a manifest (key, listed): ok, mismatch, unlisted or missing."""
    both = have.join(listed, key, "full_outer")
    verdict = F.when(F.col("digest").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("digest") == F.col("listed"), "ok")
    return both.withColumn("verdict", verdict.otherwise("mismatch"))


def prepared(text: Column, case_sensitive: bool = False, normalized: bool = False) -> Column:
    """A text as it is compared: in lower case unless case counts, letters and digits alone if ``normalized``."""
    out = text if case_sensitive else F.lower(text)
    return F.regexp_replace(out, r"[^\p{L}\p{N}]+", "") if normalized else out


def line_search(df: DataFrame, key: list[str], text: str, needles: list[str], every: bool, case_sensitive: bool = False, normalized: bool = False) -> DataFrame:
    """Lines (from 1) that hold any, or every, of the needles, compared as ``prepared``; a needle of which nothing is left
    raises a ValueError."""
    low = prepared(F.col("content"), case_sensitive, normalized)
    wanted = [n if case_sensitive else n.lower() for n in needles]
    wanted = ["".join(c for c in n if c.isalnum()) for n in wanted] if normalized else wanted
    if not all(wanted):
        raise ValueError("an empty query")
    lines = df.select(*key, F.posexplode(F.split(text, "\n")).alias("_p", "content"))
    hits = [F.contains(low, F.lit(n)) for n in wanted]
    test = F.forall(F.array(*hits), lambda x: x) if every else F.exists(F.array(*hits), lambda x: x)
    return lines.where(test).select(*key, (F.col("_p") + 1).cast("long").alias("line"), "content")


def with_context(df: DataFrame, key: list[str], text: str, needle: str, around: int, normalized: bool = False) -> DataFrame:
    """Each line that holds the needle (``line``, from 1) with ``around`` lines on either side (``content``, from line ``first``).

    Lines are looked up in the row's own text, so nothing is shuffled.
    """
    wanted = "".join(c for c in needle.lower() if c.isalnum()) if normalized else needle.lower()
    ls = F.split(text, "\n")
    at = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.contains(prepared(F.get(ls, i), normalized=normalized), F.lit(wanted)))
    rows = df.select(*key, ls.alias("_ls"), F.explode(at).alias("_i"))
    first = F.greatest(F.col("_i") - around, F.lit(0))
    content = F.array_join(F.slice("_ls", first + 1, F.col("_i") + around + 1 - first), "\n")
    return rows.select(*key, (F.col("_i") + 1).cast("long").alias("line"), (first + 1).cast("long").alias("first"), content.alias("content"))


def eligible_ids(df: DataFrame, key: list[str], ids: str, eligible: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` distinct ids of each row's list that are in ``eligible`` (a column of that name), in the list's order."""
    each = df.select(*key, F.posexplode(ids).alias("_p", ids)).groupBy(*key, ids).agg(F.min("_p").alias("_p")).join(eligible.select(ids), ids, "left_semi")
    few = each.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_p"))).where(F.col("_n") <= most)
    listed = few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", ids))), lambda x: x[ids]).alias(ids))
    return df.select(*key).join(listed, key, "left").withColumn(ids, F.coalesce(ids, F.array().cast(listed.schema[ids].dataType)))


def thread_occurrences(turns: DataFrame, needle: str, size: int, after: tuple[int, int, int] | None = None) -> DataFrame:
    """Matches in user messages and each thread's final answer, by (conv_id, turn, idx), from behind a cursor; one row more
    than the page tells that there are others."""
    final = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("_final"))
    seen = turns.join(final, "conv_id", "left").where("role = 'user' or turn = _final")
    hits = seen.select("conv_id", "turn", F.posexplode(fn.occurrences(F.col("text"), needle)).alias("idx", "at"))
    hits = hits.select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), F.col("at").cast("long").alias("at"))
    return paging.keyset(hits, [("conv_id", True), ("turn", True), ("idx", True)], after, size)


def search_threads(docs: DataFrame, needle: str, anchor: tuple | None, size: int) -> DataFrame:
    """A page of threads whose text holds the needle, newest first, each with a snippet."""
    hits = docs.withColumn("snippet", fn.snippet(F.col("text"), needle)).where("snippet is not null")
    return paging.keyset(hits, [("n_chars", False), ("doc_id", False)], anchor, size)


class FuzzySession:
    """A search over names (key, name) whose query is edited step by step, as while a user types; case does not count.

    A query that begins with an earlier one reads only what that one found, as its matches are among those: each query's matches
    are a table, and tables of queries that do not begin the present one go. Null names never match; rows of equal names all do.
    """

    def __init__(self, names: DataFrame, key: str, name: str):
        self.scratch, self.key, self.name = Scratch(names.sparkSession), key, name
        self.found: list[tuple[str, DataFrame]] = [("", names.select(key, name))]

    def update(self, query: str, most: int = 50) -> DataFrame:
        """The best ``most`` names for the query now: (key, name, score, places) by score, name and key; none for an empty query.
        A result is a small table of its own and outlives later queries, until ``close``."""
        if not self.found:
            raise ValueError("the session is closed")
        low = "".join(c.lower() for c in query)
        while not low.startswith(self.found[-1][0]):
            self.scratch.drop(self.found.pop()[1])
        rows = self.found[-1][1].select(self.key, self.name)
        if self.found[-1][0] != low:
            rows = self.scratch.keep(rows.where(fn.fuzzy(F.col(self.name), query).isNotNull()))
            self.found.append((low, rows))
        if not low:
            rows = rows.limit(0)
        hits = rows.withColumn("_m", fn.fuzzy(F.col(self.name), query)).select(self.key, self.name, "_m.score", "_m.places")
        return self.scratch.keep(hits.orderBy("score", self.name, self.key).limit(most))

    def close(self) -> None:
        """Delete all tables of the session, its results among them."""
        self.scratch.clear()
        self.found = []
