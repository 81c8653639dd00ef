"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, bind, bits_for, documents, parted, whole_row, words

#: Measures that are judged: the quantile (in thousandths) from which its upper limit starts, the one its spread is taken
#: to, how many spreads the limit lies above, the quantile of the tail and which part of the way to it the limit lies above at least, and
#: whether a lower limit mirrors the upper one. Most texts have no symbols, so that most quantiles of a group are 0: its limit is then
#: a quarter of what its worst fiftieth has. Repeats are rare even in good sources: the hundredth of a group with most of them goes.
MEASURES = {
    "word_length": (750, 250, 4, 750, 1, True), "symbols": (900, 500, 6, 980, 4, False), "dup_lines": (990, 990, 0, 990, 1, False), "repeats": (990, 990, 0, 990, 1, False),
}
#: The last bin of word length (hundredths) holds all that is longer, so a sketch has at most some 8,000 bins.
LONGEST = 5000


def window_hashes(ws: Column, size: int) -> Column:
    """A hash of the ``size`` (a power of two) words from each word on; the last ``size`` - 1 words begin none."""
    h, step = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while step < size:
        h, step = bind(h, _joined(step)), step * 2
    return h


def _joined(gap: int) -> Callable[[Column], Column]:
    """Hashes of neighbours ``gap`` apart."""
    return lambda x: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(x) - gap - 1, F.lit(0))), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + gap))
    )


def repeated_words(ws: Column, n: Column, size: int = 8) -> Column:
    """Words in windows of ``size`` words that are found twice or more in the text.

    Windows are sorted by hash with their places; equal neighbours are repeats; the places in order give
    the words covered, each counted once.
    """

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-size).cast("int").alias("last"), F.lit(0).cast("long").alias("total")),
            lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(p - s["last"], F.lit(size))).cast("long").alias("total")),
        )["total"]

    def equal(pairs: Column) -> Column:
        kept = F.filter(
            pairs,
            lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]),
        )
        return F.sort_array(F.transform(kept, lambda p: p["p"]))

    # Most texts have no window twice; they need no sorting.
    some = bind(window_hashes(ws, size), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
        bind(bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), equal), covered)
    ))
    return F.when(n < size, F.lit(0).cast("long")).otherwise(some)


def judged_by(docs: DataFrame) -> list[Column]:
    """Two hashes (_a, _b) of all that a verdict depends on."""
    of = [x for c in ("text", "lang", "source") for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*of).alias("_a"), F.xxhash64(F.lit(1), *of).alias("_b")]


def measured(docs: DataFrame, keys: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; with ``keys``, ``judged_by`` too."""
    row = judged_by(docs) if keys else []
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ws = words(F.col("text"))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        *row,
        *[
            bind(ws, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w, F.size(w)).alias("n_repeat_words"))).alias("_w"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        ],
    ).select(
        "doc_id", "lang", "source", F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"), F.col("_l.n").alias("_n_lines"),
        *["_a", "_b"] * keys,
    )


def rates() -> dict[str, Column]:
    """Whole-number measures; each is a bin of the sketch."""
    return {
        "word_length": F.expr(f"least(word_chars * 100 div greatest(n_words, 1), {LONGEST})"),
        "symbols": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(_n_lines, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
    }


def sketch(rows: DataFrame) -> DataFrame:
    """Counts by language, source, measure and bin. Two sketches merge by adding the counts of equal bins, so the
    sketch of a language is the sum of those of its sources; quantiles are exact to a bin, and the number of bins is bounded."""
    values = [F.struct(F.lit(k).alias("measure"), v.cast("long").alias("bin")) for k, v in rates().items()]
    return rows.select("lang", "source", F.explode(F.array(*values)).alias("v")).groupBy("lang", "source", "v.measure", "v.bin").agg(
        F.count("*").alias("n")
    )


def limits(bins: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Limits (``_low``, ``_top``: maps by measure) of each group of at least ``least`` rows, from the quantiles of its sketch."""
    by = ", ".join([*keys, "measure"])
    ranked = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    ranked = ranked.selectExpr("*", f"sum(n) over (partition by {by} order by bin) as upto", f"sum(n) over (partition by {by}) as total")
    groups = []
    for m, (start, to, spread, far, part, lower) in MEASURES.items():
        at = lambda p: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * p, F.col("bin")))
        q = ranked.where(f"total >= {least} and measure = '{m}'").groupBy(*keys, "measure").agg(
            at(start).alias("a"), at(to).alias("b"), at(1000 - start).alias("c"), at(1000 - to).alias("d"), at(far).alias("e")
        )
        top = F.expr(f"a + greatest({spread} * (a - b), (e - a) div {part})")
        low = F.col("c") - spread * (F.col("d") - F.col("c")) if lower else F.lit(0)
        groups.append(q.select(*keys, "measure", top.cast("long").alias("top"), low.cast("long").alias("low")))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("measure", c)))  # noqa: E731  four entries
    return out.groupBy(*keys).agg(as_map("low").alias("_low"), as_map("top").alias("_top"))


def group_limits(scratch: Scratch, rows: DataFrame, least: int) -> DataFrame:
    """Limits of every language and source of ``rows``: its own, or those of its language, or those of the whole table."""
    bins = scratch.keep(sketch(rows))
    out = bins.select("lang", "source").distinct()
    for n, keys in enumerate((["lang", "source"], ["lang"], [])):
        # Also where no group has rows enough, a row of nulls must be found: hence left joins.
        some = limits(bins, keys, least).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_low").alias(f"_low{n}"), F.col("_top").alias(f"_top{n}"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(some, on, "left").drop(*[f"_k_{k}" for k in keys])
    pick = lambda c: F.coalesce(*[F.col(f"_{c}{n}") for n in range(3)]).alias(f"_{c}")
    return out.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), pick("low"), pick("top"))


def judged(scratch: Scratch, rows: DataFrame, least: int = 100) -> DataFrame:
    """``measured`` rows with ``base_failed`` and ``kept``.

    A text fails if one of its measures is beyond a limit of its language and source; if these have fewer
    than ``least`` rows, of its language; else of the whole table, and if that is smaller too, only the base rule counts.
    All limits come from quantiles of the rows that the base rule leaves. Null languages and sources are groups like
    others; null texts have no words and fail; repeated rows are judged alike; an empty table gives an empty result.
    """
    # Read from a table, the limits have a known size: Spark broadcasts them only if they are small.
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    top = scratch.keep(group_limits(scratch, rows.where(~base), least))
    out = rows.withColumn("base_failed", base)
    out = out.join(top, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for m, v in rates().items():
        fine = fine & F.coalesce(v.between(F.col("_low")[m], F.col("_top")[m]), F.lit(True))
    return out.withColumn("kept", ~base & fine).drop("_lang", "_source", "_low", "_top")


def quality(scratch: Scratch, docs: DataFrame, least: int = 100) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each row of ``docs`` (doc_id, text, lang, source); other columns are ignored."""
    return judged(scratch, scratch.keep(measured(docs)), least)


def keep_good(scratch: Scratch, docs: DataFrame, least: int = 100) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names. Only what stands for the rejected ones is
    written: rows of one text, language and source are judged alike."""
    work = Scratch(scratch.spark)
    rows = work.keep(measured(docs, keys=True))
    gone = scratch.keep(judged(work, rows, least).where("not kept").select("_a", "_b").distinct())
    work.clear()
    each = docs.select(whole_row(docs).alias("row"), *judged_by(docs))
    maybe, fine = parted(each, "_a", gone, bits_for(gone.count()))
    return fine.select("row.*").unionByName(maybe.join(gone, ["_a", "_b"], "left_anti").select("row.*"))


def op2_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents."""
    out = quality(Scratch(spark), documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op2_adaptive": op2_adaptive}
ORACLES = {
    "op2_adaptive": r"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, k, md5(array_to_string(ws[k:k + 7], ' ')) as s from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as k from w where len(ws) >= 8)),
twice as (select doc_id, s from win group by 1, 2 having count(*) > 1),
rep as (select doc_id, count(distinct p) as n from (select win.doc_id, unnest(range(k, k + 8)) as p from win join twice using (doc_id, s)) group by 1),
b as (select w.doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
  coalesce(rep.n, 0)::bigint as n_repeat_words from w left join rep on rep.doc_id = w.doc_id),
c as (select *, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
m as (select *, least(word_chars * 100 // greatest(n_words, 1), 5000) as m1, n_symbols * 1000 // greatest(word_chars, 1) as m2,
  n_dup_lines * 1000 // greatest(len(ls), 1) as m3, n_repeat_words * 1000 // greatest(n_words, 1) as m4 from c),
v as (select doc_id, lang, source, unnest([1, 2, 3, 4]) as k, unnest([m1, m2, m3, m4]) as bin from m where not base_failed),
g as (select 0 as lv, lang, source, k, bin from v union all select 1, lang, null, k, bin from v union all select 2, null, null, k, bin from v),
r as (select *, row_number() over (partition by lv, lang, source, k order by bin) as upto, count(*) over (partition by lv, lang, source, k) as total from g),
p as (select *, [750, 900, 990, 990][k] as qs, [250, 500, 990, 990][k] as qt, [4, 6, 0, 0][k] as f, [750, 980, 990, 990][k] as qe, [1, 4, 1, 1][k] as g from r where total >= 100),
q as (select lv, lang, source, k, f, g, min(bin) filter (where upto * 1000 >= total * qs) as a, min(bin) filter (where upto * 1000 >= total * qt) as b,
  min(bin) filter (where upto * 1000 >= total * (1000 - qs)) as c, min(bin) filter (where upto * 1000 >= total * (1000 - qt)) as d,
  min(bin) filter (where upto * 1000 >= total * qe) as e from p group by 1, 2, 3, 4, 5, 6),
t as (select lv, lang, source, k, a + greatest(f * (a - b), (e - a) // g) as top, case when k = 1 then c - f * (d - c) else 0 end as low from q),
j as (select v.doc_id, bool_and(coalesce(v.bin between coalesce(a.low, l.low, o.low) and coalesce(a.top, l.top, o.top), true)) as fine from v
  left join t a on a.lv = 0 and a.lang is not distinct from v.lang and a.source is not distinct from v.source and a.k = v.k
  left join t l on l.lv = 1 and l.lang is not distinct from v.lang and l.k = v.k left join t o on o.lv = 2 and o.k = v.k group by 1)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and fine as kept from m left join j on j.doc_id = m.doc_id"""
}
