"""Periodic runs: aligned blocks of power-of-two lengths, searched across the document, lead to exact extensions.

A run of period q and length 4 q or more holds a whole block of B words, aligned to multiples of B, for the power of
two B with B <= q < 2 B, and the same block again q words on. So for each B all aligned blocks are keys of one
automaton over sequences of word numbers; occurrences at distances from B to 2 B - 1 are seeds, and each seed is extended in both
directions while words q apart are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import bind, documents, words

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
#: What is said of each text.
MADE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())])


def _left(ids: np.ndarray, i: int, q: int) -> int:
    """The first place from which on, up to ``i``, all words equal those q further on."""
    step = 32
    while i > 0:
        j = max(0, i - step)
        other = ids[j:i] != ids[j + q : i + q]
        if other.any():
            return i - int(other[::-1].argmax())
        i, step = j, step * 2
    return 0


def _right(ids: np.ndarray, i: int, q: int) -> int:
    """The first place from ``i`` on whose word differs from that q further on."""
    step, n = 32, len(ids) - q
    while i < n:
        j = min(n, i + step)
        other = ids[i:j] != ids[i + q : j + q]
        if other.any():
            return i + int(other.argmax())
        i, step = j, step * 2
    return n


def _next(ids: np.ndarray) -> np.ndarray:
    """How many words on each word stands again; where it does not, more than there are."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), 2 * len(ids) + 2)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(ids: np.ndarray, low: int, stop: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks of ``size`` words in ids[low:stop], and the distances, from ``size`` to 2 * ``size`` - 1, at
    which the same words stand again."""
    seq, search = tuple(ids[low:stop].tolist()), ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple, int] = {}
    places = range(-(-low // size) * size, stop - size + 1, size)
    kinds = [number.setdefault(seq[p - low : p - low + size], len(number)) for p in places]
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block, k in number.items():
        search.add_word(block, k)
    search.make_automaton()
    hits = np.array([(k, end) for end, k in search.iter(seq)], np.int64)
    wide = len(ids) + 2 * size + 1  # places of one kind of block, in order, then those of the next
    found = np.sort(hits[:, 0] * wide + hits[:, 1] - size + 1 + low)
    at = np.fromiter(places, np.int64)
    key = np.array(kinds, np.int64) * wide + at
    a, b = np.searchsorted(found, key + size), np.searchsorted(found, key + 2 * size)
    many = b - a
    which = np.repeat(np.arange(len(at)), many)
    each = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + a[which]
    return at[which], found[each] - key[which]


def runs(ids: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all longest runs: smallest period q, at least ``times`` q and ``least`` words; by start, then period.

    Where a run of period q begins, all but its last q words stand again within q words; only stretches of such words are searched.
    """
    n = len(ids)
    if n < least:
        return []
    again, size, found = _next(ids), 1, {}
    reach, of = np.zeros(n, np.int64), np.ones(n, np.int64)  # per word, the end and the period of the run that reaches furthest
    while times * size <= n:
        need = min(max(least, times * q) - q for q in range(size, min(2 * size, size + least)))
        near = np.diff(np.r_[0, again < 2 * size, 0].astype(np.int8))
        begins, ends = np.flatnonzero(near == 1), np.flatnonzero(near == -1)
        for low, end in zip(*(x[ends - begins >= need].tolist() for x in (begins, ends)), strict=True):
            at, gap = _seeds(ids, low, min(n, end + 2 * size - 1), size)
            # Within a run of a period that divides the distance, the seed leads to that run again.
            fresh = (reach[at] < at + gap + size) | (gap % of[at] != 0)
            done: dict[int, int] = {}
            for p, q in zip(at[fresh].tolist(), gap[fresh].tolist(), strict=True):
                if p + q + size <= done.get(q, 0):
                    continue
                start, stop = _left(ids, p, q), _right(ids, p + size, q) + q
                done[q] = stop
                if stop - start >= max(least, times * q) and (start, stop) not in found:
                    found[start, stop] = q
                    part = slice(start, stop)
                    longer = reach[part] < stop
                    of[part][longer], reach[part][longer] = q, stop
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length for its period; of equal ones the first, then that of the smallest period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def periodic_runs(docs: DataFrame, text: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``_periodic``: n_words, runs (of RUN, by start and period), best (its longest run for its
    period, or null) and collapsed: the words, joined by one space, without those that a run holds after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``; they are numbered in each document as they come, so equal numbers are equal words. Null and
    blank texts have no words and no runs. Nothing is shuffled; a document of any length is one row of one task; rows of equal ids
    are worked on one by one; columns may have any names but ``_periodic``; an empty table gives an empty result.
    """
    carried = [f"`{c.replace('`', '``')}`" for c in docs.columns if c != text]
    row = F.struct(*carried) if carried else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text).cast("binary").alias("text"))
    kind = to_arrow_type(MADE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                ws, number = (t.as_py() or b"").split(), {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
                got = runs(ids, times, least) if len(number) < len(ws) else []
                if got:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    for s, n, q in got:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    ws = [w for w, g in zip(ws, np.cumsum(gone), strict=False) if not g]
                as_row = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
                out.append({"n_words": len(ids), "runs": [as_row(r) for r in got], "best": as_row(best(got)) if got else None, "collapsed": b" ".join(ws).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["row", "made"])

    back = rows.mapInArrow(work, T.StructType([rows.schema["row"], T.StructField("made", MADE)]))
    return back.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != text], F.col("made").alias("_periodic"))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text, for a tenth of the doc_ids with its words from some place on repeated with some period; both follow from crc32 of
    the doc_id alone. Null doc_ids are left as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def changed(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        a = x["g"] % n
        p = 1 + ((n - a) / (3 + x["g"] % 8)).cast("long")
        return bind(F.struct(x["w"].alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p")), lambda y: F.array_join(
            F.transform(y["w"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["w"], y["a"] + (i - y["a"]) % y["p"]))), " "
        ))

    some = bind(F.struct(words(text).alias("w"), g.alias("g")), lambda x: F.when(F.size(x["w"]) > 0, bind(x, changed)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, some).otherwise(text)


def op12_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents: how many, the one most repeated, and digests of all and of what is left."""
    docs = documents(spark, sf_dir).select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    out, r = periodic_runs(docs), F.col("_periodic.best")
    lines = F.transform("_periodic.runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("_periodic.runs").cast("long").alias("n_runs"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"),
        F.expr("_periodic.best.length * 1000 div _periodic.best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("_periodic.collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_blocks": op12_blocks}
