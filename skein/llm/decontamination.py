"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted-shingle similarity.

A window that shares no shingle with an item has similarity 0 to it. So of each text, the windows that hold a shingle of an
item anywhere are fingerprinted, at the length of that item and from every word on; no other window can match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, small_batches, unpacked, whole_row
from skein.llm.wordhash import Words, buffers, mix, spans, split, text_slices


class Shingles:
    """Shingles of texts: hash, weight (bytes of its words) and word place of each; texts of fewer words are one shingle."""

    def __init__(self, w: Words, size: int):
        n = np.diff(w.first)
        doc = np.repeat(np.arange(len(n)), n)
        self.doc, self.words = doc, w
        letters = np.r_[0, np.cumsum(w.stop - w.start)]
        count = len(w.hashes)
        self.hash, self.weight = np.zeros(count, np.uint64), np.zeros(count, np.float64)
        if count >= size:
            whole = np.flatnonzero(np.arange(count - size + 1) + size <= w.first[1:][doc[: count - size + 1]])
            self.hash[whole] = spans(w.hashes, size, 41)[whole]
            self.weight[whole] = (letters[size:] - letters[:-size])[whole]


def signs(h: np.ndarray) -> np.ndarray:
    """The 128 bits of each hash as +1 and -1."""
    both = np.stack([mix(h + np.uint64(1)), mix(h ^ np.uint64(0x2545F4914F6CDD1D))], 1)
    return np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.float32) * 2 - 1


def fingerprints(h: np.ndarray, weight: np.ndarray, first: np.ndarray, most: int = 20_000) -> np.ndarray:
    """128-bit SimHashes (16 bytes) of weighted bags of shingles that follow one another."""
    out, i = np.zeros((len(first) - 1, 16), np.uint8), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1)
        a, b = first[i], first[j]
        full = np.flatnonzero(np.diff(first[i : j + 1]) > 0)
        if len(full):
            sums = np.add.reduceat(signs(h[a:b]) * weight[a:b, None].astype(np.float32), first[i:j][full] - a, axis=0)
            out[i + full] = np.packbits(sums > 0, axis=1)
        i = j
    return out


def rolling(h: np.ndarray, weight: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 20_000) -> np.ndarray:
    """SimHashes of windows of ``count`` shingles from ``start`` (ascending): differences of running sums over the shingles.

    Weights are whole numbers, so the sums are exact and equal those of ``fingerprints``.
    """
    out, stop = np.zeros((len(start), 16), np.uint8), start + count
    # Windows that overlap share their sums; at a gap, or after ``most`` shingles, new ones begin.
    gap = np.flatnonzero(start[1:] > np.maximum.accumulate(stop)[:-1]) + 1
    for i, end in zip(np.r_[0, gap], np.r_[gap, len(start)], strict=True):
        while i < end:
            j = min(end, int(np.searchsorted(start, start[i] + most, "right")))
            a, b = start[i], stop[i:j].max()
            sums = np.zeros((b - a + 1, 128))
            np.cumsum(signs(h[a:b]) * weight[a:b, None], axis=0, out=sums[1:])
            out[i:j] = np.packbits(sums[stop[i:j] - a] - sums[start[i:j] - a] > 0, axis=1)
            i = j
    return out


class Index:
    """A block of benchmark items. ``size`` words make a shingle; items of fewer words are left to smaller sizes."""

    def __init__(self, ids: list, texts: list[str], size: int, longer: bool):
        w = split(pa.array(texts, pa.string()), lower=True, marks=True)
        n = np.diff(w.first)
        use = np.flatnonzero(n >= size if longer else n == size)
        self.size, self.ids, self.n = size, [ids[k] for k in use], n[use]
        s = Shingles(w, size)
        shingles = self.n - size + 1
        self.first = np.r_[0, np.cumsum(shingles)]
        at = np.repeat(w.first[:-1][use], shingles) + np.arange(int(self.first[-1])) - np.repeat(self.first[:-1], shingles)
        self.hash, self.weight = s.hash[at], s.weight[at]
        self.item = np.repeat(np.arange(len(use)), shingles)
        self.place = np.arange(len(at)) - np.repeat(self.first[:-1], shingles)
        self.order = np.argsort(self.hash, kind="stable")
        self.sorted = self.hash[self.order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        self.prints = fingerprints(self.hash, self.weight, self.first)
        # For each of 16 blocks and each of its values, the items whose block differs in at most one bit.
        flips = np.r_[0, 1 << np.arange(8)].astype(np.uint8)
        self.near = np.zeros((16, 256, len(use)), bool)
        for b in range(16):
            for f in flips:
                self.near[b, self.prints[:, b] ^ f, np.arange(len(use))] = True

    def windows(self, s: Shingles) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of each window that holds a shingle of an item of that length, by length and place."""
        hit = np.flatnonzero(self.seen[(s.hash >> np.uint64(42)).astype(np.int64)] & (s.weight > 0))
        a, b = np.searchsorted(self.sorted, s.hash[hit], "left"), np.searchsorted(self.sorted, s.hash[hit], "right")
        many = b - a
        k = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at, n = np.repeat(hit, many), self.n[self.item[self.order[k]]]
        if not len(at):
            return at, n
        low, high = np.maximum(at - (n - self.size), s.words.first[:-1][s.doc[at]]), at
        order = np.lexsort((high, low, n))
        low, high, n = low[order], high[order], n[order]
        starts, lengths = [], []
        for edge in np.split(np.arange(len(n)), np.flatnonzero(np.diff(n)) + 1):  # a turn for each length of items
            x, y = low[edge], np.maximum.accumulate(high[edge])
            x = np.maximum(x, np.r_[-1, y[:-1]] + 1)
            some = np.maximum(y - x + 1, 0)
            starts.append(np.repeat(x - (np.cumsum(some) - some), some) + np.arange(int(some.sum())))
            lengths.append(np.full(len(starts[-1]), n[edge[0]]))
        return np.concatenate(starts), np.concatenate(lengths)

    def matches(self, s: Shingles, similarity: float, radius: int) -> list[tuple]:
        """(text, item, first word, words, similarity) of each item in each text, at its best window."""
        start, length = self.windows(s)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for n in np.unique(length).tolist():
            of = np.flatnonzero(self.n == n)
            all_at = start[length == n]
            for i in range(0, len(all_at), 50_000):
                at = all_at[i : i + 50_000]
                stop = np.minimum(at + n, s.words.first[1:][s.doc[at]])
                prints = rolling(s.hash, s.weight, at, stop - at - self.size + 1)
                close = np.zeros((len(at), len(of)), bool)
                for b in range(16):
                    close |= self.near[b][:, of][prints[:, b]]
                win, item = np.nonzero(close)
                item = of[item]
                near = np.bitwise_count(prints[win] ^ self.prints[item]).sum(1) <= radius
                win, item = win[near], item[near]
                for w, t, sim in zip(win.tolist(), item.tolist(), self._similarity(s, at, stop, win, item).tolist(), strict=True):
                    key = (int(s.doc[at[w]]), t)
                    if sim >= similarity and (key not in best or sim > best[key][0]):
                        best[key] = (sim, int(at[w]), int(stop[w]))
        return [(doc, self.ids[t], a - int(s.words.first[doc]), b - a, sim) for (doc, t), (sim, a, b) in sorted(best.items())]

    def _similarity(self, s: Shingles, start: np.ndarray, stop: np.ndarray, win: np.ndarray, item: np.ndarray, most: int = 500_000) -> np.ndarray:
        """Weighted Jaccard similarity of the shingle bags of windows and items."""
        out, i = np.zeros(len(win)), 0
        size = np.cumsum(stop[win] - start[win] + self.n[item])
        while i < len(win):
            j = max(i + 1, int(np.searchsorted(size, size[i] + most)))
            out[i:j] = self._bags(s, start[win[i:j]], stop[win[i:j]] - start[win[i:j]] - self.size + 1, item[i:j])
            i = j
        return out

    def _bags(self, s: Shingles, start: np.ndarray, count: np.ndarray, item: np.ndarray) -> np.ndarray:
        def bag(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(n)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

        pa_, ka = bag(start, count)
        pb, kb = bag(self.first[item], self.first[item + 1] - self.first[item])
        pair = np.r_[pa_, pb]
        h = np.r_[s.hash[ka], self.hash[kb]]
        a = np.r_[s.weight[ka], np.zeros(len(kb))]
        b = np.r_[np.zeros(len(ka)), self.weight[kb]]
        order = np.lexsort((h, pair))
        pair, h, a, b = pair[order], h[order], a[order], b[order]
        heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])])
        a, b, pair = np.add.reduceat(a, heads), np.add.reduceat(b, heads), pair[heads]
        return np.bincount(pair, np.minimum(a, b), len(item)) / np.maximum(np.bincount(pair, np.maximum(a, b), len(item)), 1e-9)


def item_blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of at most ``most`` items: what is held or sent at once doesn't grow with it."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator()
    while part := list(islice(rows, most)):
        yield [r[0] for r in part], [r[1] for r in part]


def contaminated(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, radius: int = 31, size: int = 5, into: str = "matches", block: int = 2000, most: int = 20_000, slice_bytes: int = 4_000_000
) -> DataFrame:
    """``docs`` with the column ``into``: the items (item_id, start, words, similarity) of which a window of the text is a copy.

    Words are compared in lower case without ASCII marks. A window of as many words as the item, cut at the end of the
    text, matches if the 128-bit SimHashes of their weighted shingles differ in at most ``radius`` bits (16 blocks of 8 bits: at
    least one then differs in one bit or none) and their weighted Jaccard similarity is at least ``similarity``. At a
    similarity of just 0.8 SimHashes differ in 19 bits on average, with a deviation of 4, so some 3 in 1000 such windows
    are missed. Items of fewer words than ``size`` must stand word for word. Null and empty texts match nothing; null items are left
    out; repeated rows match alike; all columns are kept, whatever their names, but for one named ``into``; an empty benchmark
    matches nothing. One pass over the texts takes up to ``most`` items, indexed ``block`` by block.
    """
    small_batches(docs.sparkSession)
    ids = items.schema["item_id"].dataType.simpleString()
    kind = f"array<struct<item_id:{ids},start:bigint,words:bigint,similarity:double>>"
    out = docs.select(whole_row(docs).alias("row"), F.col("text").alias("text"), F.array().cast(kind).alias("found"))
    for all_ids, all_texts in item_blocks(items, most):

        def scan(batches: Iterator[pa.RecordBatch], all_ids: list = all_ids, all_texts: list[str] = all_texts) -> Iterator[pa.RecordBatch]:
            indexes = [Index(all_ids[i : i + block], all_texts[i : i + block], k, k == size) for i in range(0, len(all_ids), block) for k in range(1, size + 1)]
            indexes = [x for x in indexes if len(x.ids)]
            for batch in batches:
                _, offsets = buffers(batch["text"])
                for i, j in text_slices(offsets, slice_bytes):
                    part = batch.slice(i, j - i)
                    w = split(part["text"], lower=True, marks=True)
                    shingles = {k: Shingles(w, k) for k in {x.size for x in indexes}}
                    found = part["found"].to_pylist()
                    for index in indexes:
                        for doc, *m in index.matches(shingles[index.size], similarity, radius):
                            found[doc].append(dict(zip(("item_id", "start", "words", "similarity"), m, strict=True)))
                    k = part.schema.get_field_index("found")
                    yield part.set_column(k, part.schema.field(k), pa.array(found, part.schema.field(k).type))

        out = out.mapInArrow(scan, out.schema)
    return out.select(*unpacked([c for c in docs.columns if c != into], "row"), F.col("found").alias(into))


def uncontaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, whatever their names."""
    rows = docs.select(F.col("text").alias("text"), whole_row(docs).alias("row"))
    return contaminated(rows, items, into="matches", **settings).where(F.size("matches") == 0).select("row.*")


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items they hold."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contaminated(documents(spark, sf_dir).select("doc_id", "text"), items)
    return out.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", "m.start", "m.words", F.round("m.similarity", 6).alias("similarity")
    )


QUERIES = {"op8_simhash_windows": op8_simhash_windows}
