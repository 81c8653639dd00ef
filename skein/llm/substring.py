"""Substring dedup by recompression: equal passages get equal interior symbols, and shared symbols lead to them.

A round pairs neighbouring symbols whose hashed sides are left and right, and names maximal runs of an equal
symbol among the rest. A name is a 64-bit hash of what it stands for, so it is the same all over the corpus without a
dictionary. A symbol's *context* is the stretch of words that decides that it is there: wherever
these words stand, the symbol stands at the same place. So two equal windows hold the same symbols
among those whose contexts lie inside; each window is found by those of the highest round that has any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, documents, small_batches
from skein.llm.wordhash import buffers, mix, pair, spans, split, text_slices

_FAR = np.int64(1) << np.int64(40)


class Level:
    def __init__(self, sym, doc, low, high):
        self.sym, self.doc, self.low, self.high = sym, doc, low, high

    def next(self, r: int) -> Level:
        """Pair, then name runs; ``low`` and ``high`` bound the words of each symbol's context."""
        n, sym, doc = len(self.sym), self.sym, self.doc
        if n < 2:
            return self
        right = (mix(sym + np.uint64(r * 2 + 1)) & np.uint64(1)).astype(bool)
        near = doc[1:] == doc[:-1]
        joins = ~right[:-1] & right[1:] & near  # at i: i and i + 1 become one
        first, second = np.r_[joins, False], np.r_[False, joins]
        alone = ~(first | second)
        again = np.r_[False, alone[1:] & alone[:-1] & near & (sym[1:] == sym[:-1])]
        heads = np.flatnonzero(~(second | again))
        size = np.diff(np.r_[heads, n])
        name, paired = sym[heads].copy(), first[heads]
        p = heads[paired]
        name[paired] = pair(sym[p], sym[p + 1], r)
        run = ~paired & (size > 1)
        name[run] = pair(sym[heads[run]], size[run].astype(np.uint64), r + 1000)
        low, high = np.minimum.reduceat(self.low, heads), np.maximum.reduceat(self.high, heads)
        # What is not a pair also depends on both neighbours; at the edge of a text, on what may stand elsewhere.
        new_doc = doc[heads]
        out_low, out_high = low.copy(), high.copy()
        tail = heads + size - 1
        before = np.where(np.r_[False, new_doc[1:] == new_doc[:-1]], self.low[np.maximum(heads - 1, 0)], -_FAR)
        after = np.where(np.r_[new_doc[1:] == new_doc[:-1], False], self.high[np.minimum(tail + 1, n - 1)], _FAR)
        out_low[~paired] = np.minimum(low, before)[~paired]
        out_high[~paired] = np.maximum(high, after)[~paired]
        return Level(name, new_doc, out_low, out_high)


class Chosen:
    """Which symbols find which windows, for the words of several texts.

    valid: places where a window begins. picks: (names, documents, first window, last window) of the symbols
    taken of each round, with the windows that have nothing higher. bare: windows without any such symbol.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, window: int, rounds: int, lowest: int):
        n = len(hashes)
        length = np.diff(first)
        doc = np.repeat(np.arange(len(length)), length)
        self.doc, self.valid, self.picks = doc, np.arange(n) + window <= np.repeat(first[1:], length), []
        levels, level = [], Level(hashes, doc, np.arange(n), np.arange(n) + 1)
        for r in range(1, rounds + 1):
            level = level.next(r)
            levels.append((r, level))
        need = self.valid.copy()
        for r, lv in reversed(levels):
            if r < lowest or not need.any():
                break
            ok = np.flatnonzero((lv.low >= 0) & (lv.high - lv.low <= window))
            a = np.maximum(lv.high[ok] - window, first[:-1][lv.doc[ok]])
            b = np.minimum(lv.low[ok], first[1:][lv.doc[ok]] - window)
            good = a <= b
            ok, a, b = ok[good], a[good], b[good]
            served = need & (self._cover(a, b) > 0)
            before = np.r_[0, np.cumsum(served)]
            take = before[b + 1] > before[a]
            ok, a, b = ok[take], a[take], b[take]
            self.picks.append((pair(lv.sym[ok], np.full(len(ok), r, np.uint64), 77), lv.doc[ok], a, b, served))
            need = need & ~served
        self.bare = need

    def _cover(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.valid)
        return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b + 1, minlength=n + 1))[:n]


def _names(c: Chosen, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, name) of all symbols taken; a bare window is its own symbol."""
    name, doc = [p[0] for p in c.picks], [p[1] for p in c.picks]
    if c.bare.any():
        at = np.flatnonzero(c.bare)
        name.append(spans(hashes, window, 5)[at])
        doc.append(c.doc[at])
    if not name:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    name, doc = np.concatenate(name), np.concatenate(doc)
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    keep = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])] if len(name) else np.zeros(0, bool)
    return doc[keep], name[keep]


def _shared_windows(c: Chosen, hashes: np.ndarray, window: int, shared: np.ndarray) -> np.ndarray:
    """Windows all of whose symbols are shared. shared: sorted hashes of (name, document)."""

    def known(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
        key = pair(name, doc.astype(np.uint64), 9)
        at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        return shared[at] == key

    out = np.zeros(len(c.valid), bool)
    if not len(shared):
        return np.flatnonzero(out)
    for name, doc, a, b, served in c.picks:
        not_shared = ~known(name, doc)
        out |= served & (c._cover(a[not_shared], b[not_shared]) == 0)
    if c.bare.any():
        at = np.flatnonzero(c.bare)
        out[at] = known(spans(hashes, window, 5)[at], c.doc[at])
    return np.flatnonzero(out)


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """A list array: the values of each of n documents (``of`` ascending)."""
    at = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def repeats(
    scratch: Scratch, docs: DataFrame, window: int = 50, rounds: int = 10, lowest: int = 5, slice_bytes: int = 4_000_000
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed and the kept words joined by one space (``kept_sha256``).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Null and blank texts have no words. Rows without doc_id keep all words and take none from others. Repeated
    rows (equal doc_id) never take from each other and have equal results. Texts of equal words count
    once, under their smallest doc_id. Windows are compared by two 64-bit hashes. An empty table gives an empty result.
    """
    small_batches(scratch.spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for i, j in text_slices(offsets, slice_bytes):
                part = batch.slice(i, j - i)
                w = split(part["text"])
                c = Chosen(w.hashes, w.first, window, rounds, lowest)
                doc, name = _names(c, w.hashes, window)
                n = np.diff(w.first)
                sha, r1, r2 = [], np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                place = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], n)
                full = n > 0
                if full.any():
                    at = w.first[:-1][full]
                    for out, seed in ((r1, 11), (r2, 12)):
                        with np.errstate(over="ignore"):
                            out[full] = np.add.reduceat(mix(w.hashes + mix(place.astype(np.uint64) * np.uint64(977) + np.uint64(seed))), at)
                for t in part["text"].to_pylist():
                    sha.append(hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["th"], pa.array(n.astype(np.int64)), pa.array(sha), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64)), _lists(name, doc, len(n))],
                    names=["doc_id", "th", "n_words", "sha", "r1", "r2", "names"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    p = docs.mapInArrow(first_pass, f"doc_id {kind}, th long, n_words long, sha string, r1 long, r2 long, names array<long>")
    p = scratch.keep(p.withColumn("uid", F.monotonically_increasing_id()))
    known = p.where("doc_id is not null")
    whole = ["r1", "r2", "n_words"]
    many = known.groupBy(whole).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
    copies = scratch.keep(known.select("uid", "doc_id", *whole).join(many, whole).where("doc_id > a").select("uid"))
    own = known.where("size(names) > 0").select("uid", "names").join(copies, "uid", "left_anti")
    names = own.select("uid", F.explode("names").alias("name"))  # a name once a row
    shared = names.groupBy("name").count().where("count > 1").select("name")
    wanted = names.join(shared, "name").groupBy("uid").agg(F.collect_list("name").alias("names"))  # one document's
    wanted = wanted.join(p.select("uid", "doc_id", "th"), "uid").drop("uid").dropDuplicates(["doc_id", "th"])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for i, j in text_slices(offsets, slice_bytes):
                part = batch.slice(i, j - i)
                w = split(part["text"])
                c = Chosen(w.hashes, w.first, window, rounds, lowest)
                lists = part["names"]
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(len(lists)), np.array(lists.value_lengths().fill_null(0)))
                at = _shared_windows(c, w.hashes, window, np.sort(pair(flat, of.astype(np.uint64), 9)))
                doc = c.doc[at]
                one, two = (spans(w.hashes, window, s)[at] if len(at) else np.zeros(0, np.uint64) for s in (21, 22))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(doc)), part["th"].take(pa.array(doc)), pa.array((at - w.first[:-1][doc]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["doc_id", "th", "pos", "h1", "h2"],
                )

    w = docs.join(wanted, ["doc_id", "th"]).mapInArrow(second_pass, f"doc_id {kind}, th long, pos int, h1 long, h2 long")
    w = scratch.keep(w)
    again = w.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
    hit = w.join(again, ["h1", "h2"]).where("doc_id > a").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("at"))

    def third_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, th, text, at in zip(b["doc_id"], b["th"], b["text"], b["at"], strict=True):
                words = text.encode().split()
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, np.asarray(at), 1)
                np.add.at(mark, np.asarray(at) + window, -1)
                keep = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
                kept = b" ".join([words[i] for i in keep])
                out.append((doc, th, len(words) - len(keep), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "th", "cut", "cut_sha"])

    cut = docs.join(hit, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).mapInPandas(third_pass, f"doc_id {kind}, th long, cut long, cut_sha string")
    out = p.select("uid", "doc_id", "th", "n_words", "sha").join(cut, ["doc_id", "th"], "left")
    out = out.join(copies.withColumn("copy", F.lit(True)), "uid", "left")
    whole = F.col("copy") & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeated passages of 50 words stay only in the first document."""
    return repeats(Scratch(spark), documents(spark, sf_dir))


QUERIES = {"op10_recompression": op10_recompression}
ORACLES = {
    "op10_recompression": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, k, md5(array_to_string(ws[k:k + 49], ' ')) as s from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as k from w where len(ws) >= 50)),
first as (select s, min(doc_id) as m from win group by s),
gone as (select distinct doc_id, unnest(range(k, k + 50)) as p from win join first using (s) where m < doc_id),
kept as (select e.doc_id, count(*) as n, string_agg(e.ws[e.p], ' ' order by e.p) as t
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from w) e left join gone g on g.doc_id = e.doc_id and g.p = e.p where g.p is null group by 1)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id"""
}
