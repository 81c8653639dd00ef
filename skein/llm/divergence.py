"""How sources of a language differ in their terms: sketched document frequencies, exact counts of what may matter, pair sums.

A count-min sketch of document frequencies is summed over all tasks. It never underestimates, so a term whose cells do not
all reach the least frequency is rare, and is not shuffled. Of the others, counts are exact. Divergence is a sum of
differences; sum |x - y| = sum x + sum y - 2 sum min(x, y), and the last needs a join only where two sources both have a term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Scratch, documents

#: All bytes that are no letters of ASCII and no part of a longer character, as spaces; A-Z lower-cased.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Rows of the sketch, and how many different terms a task counts before it passes them on.
DEPTH, MOST = 2, 1 << 19


def terms(text: bytes) -> list[bytes]:
    """``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of UTF-8 text, only A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def cells(keys: list[bytes], width: int) -> np.ndarray:
    """DEPTH cells (columns) of each key, in a table of DEPTH rows of ``width`` cells, a power of two."""
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    parts = np.frombuffer(digests, ">u8").reshape(-1, DEPTH).astype(np.int64)
    return (parts & (width - 1)) + np.arange(DEPTH) * width


def _cleaned(docs: DataFrame) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(fill("text").cast("binary").alias("text"), fill("lang").alias("lang"), fill("source").alias("source"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str, str]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py()


def _key(lang: str, term: bytes) -> bytes:
    return lang.encode() + b" " + term


def sketched(rows: DataFrame, width: int, least: int) -> DataFrame:
    """Cells (cell, n) of the count-min sketch of document frequencies by language; a task counts up to ``least`` in each cell, so
    sums of tasks reach it where the true count does."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            at, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lang, count in seen.items():
                if count:
                    at.append(cells([_key(lang, t) for t in count], width).ravel())
                    n.append(np.repeat(np.fromiter(count.values(), np.int64, len(count)), DEPTH))
            found, which = np.unique(np.concatenate(at), return_inverse=True)
            total = np.bincount(which, np.concatenate(n), len(found)).astype(np.int64)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(total, least))], schema=schema)

        held = 0
        for text, lang, _ in _rows(batches):
            count = seen.setdefault(lang, Counter())
            before = len(count)
            count.update(set(terms(text)))
            held += len(count) - before
            if held > MOST:
                held = 0
                yield flush()
        yield flush()

    return rows.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def possible(scratch: Scratch, rows: DataFrame, width: int, least: int) -> np.ndarray:
    """Which cells of the sketch reach ``least``: DEPTH * ``width`` bits, however much text there is."""
    full = sketched(rows, width, least).where(F.col("n") >= least)
    word = F.shiftright("cell", 5)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 32).cast("int"))
    marks = full.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))  # at most DEPTH * width / 32 rows
    out = np.zeros(DEPTH * width // 32, np.uint32)
    for b in marks.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    return out


def counted(scratch: Scratch, rows: DataFrame, width: int, least: int) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with it, of each term that may stand in ``least`` documents of its
    language; and a row with an empty term for each group that occurs."""
    marks = scratch.spark.sparkContext.broadcast(possible(scratch, rows, width, least))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in seen.items():
                keys = list(n)
                at = cells([_key(lang, t) for t in keys], width) if keys else np.zeros((0, DEPTH), np.int64)
                hit = ((marks.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(1)
                some = [t for t, h in zip(keys, hit, strict=True) if h]
                m = len(some) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * m), pa.array([source] * m), pa.array([b"", *some]).cast(pa.string()), pa.array([0, *(n[t] for t in some)], pa.int64()), pa.array([0, *(docs[t] for t in some)], pa.int64())
                ], schema=schema)
            seen.clear()

        held = 0
        for text, lang, source in _rows(batches):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(n), terms(text)
            n.update(found)
            docs.update(set(found))
            held += len(n) - before + 1
            if held > MOST:
                held = 0
                yield from flush()
        yield from flush()

    out = rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, vocabulary: str) -> str:
    """1 + floor(10**9 (count + 5) / (total + 5 V)), in decimals, as longs do not hold the product at any size."""
    return f"1 + (cast(1000000000 as decimal(10)) * cast({count} + 5 as decimal(20))) div cast(greatest({total} + 5 * {vocabulary}, 1) as decimal(20))"


def divergence(scratch: Scratch, docs: DataFrame, least: int = 30, top: int = 50, width: int = 1 << 22) -> DataFrame:
    """How each source of each language differs: (lang, source, part, item, value, rank).

    Terms count that stand in at least ``least`` documents of their language. Part ``pair``: each other source of the language, by the
    sum of differences of smoothed shares over all these terms, in billionths. Part ``term``: the ``top`` terms that the source has more
    of than its language. Ranks are by value, largest first, then by item.

    ``width``: cells in each of DEPTH rows of the sketch; with more different terms more pass the sketch, none is lost, and
    DEPTH * ``width`` bits are all that the driver and the tasks hold of it. Null texts, languages and sources are empty ones. Repeated
    rows count each; other columns are ignored; groups without terms have pairs of their own; an empty table gives an empty result.
    """
    rows = _cleaned(docs)
    exact = scratch.keep(counted(scratch, rows, width, least))
    groups, found = exact.select("lang", "source").distinct(), exact.where("term <> ''")
    kept = scratch.keep(found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("total"))
    some = scratch.keep(found.join(kept.select("lang", "term", "lang_n"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    per = some.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("has"))
    info = groups.join(per, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["own", "has", "v", "total"])
    info = scratch.keep(info.withColumn("zero", F.expr(_share("0", "own", "v"))))
    scratch.drop(exact, kept)
    shares = some.join(info, ["lang", "source"]).withColumn("p", F.expr(_share("n", "own", "v")))
    shares = scratch.keep(shares.select("lang", "source", "term", "p", "zero", F.expr(_share("lang_n", "total", "v")).alias("q")))
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    more = more.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    pairs = _pairs(shares, info).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(more)


def _pairs(shares: DataFrame, info: DataFrame) -> DataFrame:
    """(lang, source, other, value) of all ordered pairs of sources of a language; value: the sum of |p - q| over its terms.

    A term that only one of them has meets the other's share of nothing; how many there are of each share is enough for these.
    """
    mass = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    least = lambda *c: F.least(*[F.col(x) for x in c])
    b = info.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    # Sums of min(p, the other's share of nothing) over the terms of each source, and the source's own sum.
    met = mass.join(b, "lang").groupBy("lang", "source", "other").agg(F.sum(F.col("m") * least("p", "other_zero")).alias("low"))
    own = info.join(mass.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("p")).alias("s")), ["lang", "source"], "left").na.fill(0, ["s"])
    own = own.select("lang", "source", "zero", "has", "v", (F.col("s") + (F.col("v") - F.col("has")) * F.col("zero")).alias("s"))
    x = shares.select("lang", "term", "source", F.col("p").alias("p"), F.col("zero").alias("z"))
    y = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_z"))
    both = x.join(y, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(
        F.sum(least("p", "other_p") - least("p", "other_z") - least("other_p", "z")).alias("more"), F.count("*").alias("common")
    )
    right = own.select("lang", *[F.col(c).alias(f"other_{c}") for c in ("source", "zero", "has", "s")]).withColumnRenamed("other_source", "other")
    pairs = own.join(right, "lang").where("source < other").join(both, ["lang", "source", "other"], "left")
    pairs = pairs.join(met, ["lang", "source", "other"], "left")
    back = met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("low").alias("other_low"))
    pairs = pairs.join(back, ["lang", "source", "other"], "left").na.fill(0, ["more", "common", "low", "other_low"])
    neither = (F.col("v") - F.col("has") - F.col("other_has") + F.col("common")) * least("zero", "other_zero")
    value = F.col("s") + F.col("other_s") - 2 * (F.col("low") + F.col("other_low") + F.col("more") + neither)
    half = pairs.select("lang", "source", "other", value.alias("value"))
    return half.withColumn("e", F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"))))).select("lang", "e.*", "value")


def op13_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources, in full."""
    return divergence(Scratch(spark), documents(spark, sf_dir))


QUERIES = {"op13_sketch": op13_sketch}
ORACLES = {
    "op13_sketch": r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
o as (select id, lang, source, unnest(ts) as term from d),
k as (select lang, term, count(*) as lang_n from o group by 1, 2 having count(distinct id) >= 30),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by 1, 2, 3),
gs as (select distinct lang, source from d),
ls as (select lang, count(k.term) as v, coalesce(sum(lang_n), 0) as total from (select distinct lang from d) left join k using (lang) group by 1),
ns as (select lang, source, coalesce(sum(n), 0) as own from gs left join c using (lang, source) group by 1, 2),
p as (select gs.lang, gs.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (own + 5 * v)::hugeint as p,
  1 + (1000000000::hugeint * (lang_n + 5)) // (total + 5 * v)::hugeint as q
  from gs join k using (lang) join ls using (lang) join ns using (lang, source) left join c on c.lang = gs.lang and c.source = gs.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from gs a join gs b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
u as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 50"""
}
