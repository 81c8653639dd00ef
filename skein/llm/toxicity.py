"""Toxicity by subword bags: embeddings of character n-grams, averaged over a few words, in a linear softmax.

A text is as toxic as its most toxic stretch of words, so a few words in a long text count as much as in a short one. A
word never seen shares its n-grams, and so their vectors, with words that were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, small_batches
from skein.llm.wordhash import _LOWER, buffers, split, text_slices

_KEYS = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n * 0x51ED27) for n in (3, 4, 5)}


class Bags:
    """Words of texts in marks (``<word>``), lower-cased in ASCII, with their n-grams' buckets.

    first: where each text's words begin; start: where each word begins among all marked characters.
    """

    def __init__(self, texts: pa.Array, bits: int):
        w = split(texts)
        self.first, self.shift = w.first, np.uint64(64 - bits)
        size = w.stop - w.start + 2
        self.start = np.cumsum(size) - size
        n = int(size.sum())
        self.chars = np.full(n, 60, np.uint8)
        ends = self.start + size - 1
        self.chars[ends] = 62
        inner = np.ones(n, bool)
        inner[self.start] = inner[ends] = False
        covered = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(covered, w.start, 1)
        np.add.at(covered, w.stop, -1)
        self.chars[inner] = _LOWER[w.data[np.cumsum(covered[:-1]).astype(bool)]]
        self.left = (np.repeat(ends + 1, size) - np.arange(n)).astype(np.int32)  # characters of the word from here on

    def buckets(self, at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n: buckets of the n-grams at the given places (all by default), and which are within a word."""
        wide = np.r_[self.chars, np.zeros(8, np.uint8)].astype(np.uint64)
        n = len(self.chars)
        code = None
        for k in range(5):
            part = wide[k : k + n] if at is None else wide[at + k]
            code = part if code is None else code | (part << np.uint64(8 * k))
            if k + 1 in _KEYS:
                with np.errstate(over="ignore"):
                    yield ((code + np.uint64(1)) * _KEYS[k + 1]) >> self.shift, (self.left if at is None else self.left[at]) >= k + 1

    def sums(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the n-grams' values for each word."""
        total, count = np.zeros(len(self.chars), np.float32), np.zeros(len(self.chars), np.float32)
        for bucket, ok in self.buckets():
            total += np.where(ok, value[bucket], np.float32(0))
            count += ok
        if not len(self.start):
            return np.zeros(0), np.zeros(0)
        return np.add.reduceat(total, self.start, dtype=np.float64), np.add.reduceat(count, self.start, dtype=np.float64)


def stretches(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping runs of ``width`` words: text, first word, word after the last; the last run ends with the text."""
    n = np.diff(first)
    step = max(1, width // 2)
    many = np.where(n > 0, np.maximum(0, -(-(n - width) // step)) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    low = first[:-1][text] + k * step
    return text, low, np.minimum(low + width, first[1:][text])


class Model:
    """value: each bucket's embedding times the difference of the softmax's two weight vectors."""

    def __init__(self, bits: int, width: int, value: np.ndarray, bias: float):
        self.bits, self.width, self.value, self.bias = bits, width, value, bias

    def logits(self, bags: Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest logit, and the stretch that has it (first word, word after the last; or -1)."""
        text, low, high = stretches(bags.first, self.width)
        total, count = (np.r_[0.0, np.cumsum(x)] for x in bags.sums(self.value))
        z = (total[high] - total[low]) / np.maximum(count[high] - count[low], 1) + self.bias
        n = len(bags.first) - 1
        best = np.full(n, self.bias)
        order = np.lexsort((z, text))
        last = order[np.r_[text[order][1:] != text[order][:-1], True]] if len(order) else order
        best[text[last]] = z[last]
        a, b = np.full(n, -1), np.full(n, -1)
        a[text[last]], b[text[last]] = low[last], high[last]
        return best, a, b, text


def _sums(to: np.ndarray, value: np.ndarray, of: np.ndarray, n: int, step: int = 1_000_000) -> np.ndarray:
    """Sum of value[of] at each place of ``to``, a part at a time."""
    out = np.zeros(n)
    for i in range(0, len(to), step):
        out += np.bincount(to[i : i + step], value[of[i : i + step]], n)
    return out


def train(
    texts: list[str], toxic: np.ndarray, bits: int = 17, dim: int = 8, width: int = 6, rounds: int = 10, steps: int = 12, rate: float = 0.15, decay: float = 2e-4, seed: int = 3
) -> Model:
    """Embeddings and softmax fitted jointly by full-batch steps; each text stands for its most toxic stretch so far.

    The first round uses the whole text as one stretch, as nothing is known yet of where its toxic words are.
    """
    rng = np.random.default_rng(seed)
    _, offsets = buffers(pa.array(texts, pa.string()))
    parts = [(i, Bags(pa.array(texts[i:j], pa.string()), bits)) for i, j in text_slices(offsets, 400_000)]
    emb = rng.uniform(-1, 1, (1 << bits, dim)).astype(np.float32) / dim
    soft = rng.standard_normal((2, dim)).astype(np.float32)
    y = toxic.astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    bias = 0.0
    square, square_soft, square_bias = np.full((1 << bits, 1), 1e-6, np.float32), np.full((2, dim), 1e-6, np.float32), 1e-6
    model = Model(bits, width, emb @ (soft[1] - soft[0]), bias)
    for r in range(rounds):
        ids, own = [], []
        for i, bags in parts:
            if r == 0:
                a, b = bags.first[:-1], bags.first[1:]
            else:
                _, a, b, _ = model.logits(bags)
                a, b = np.maximum(a, 0), np.maximum(b, 0)
            size = np.r_[bags.start, len(bags.chars)]
            low, high = size[a], size[b]
            n = high - low
            of = np.repeat(np.arange(i, i + len(a), dtype=np.int32), n)
            at = np.arange(len(of)) + np.repeat(low - (np.cumsum(n) - n), n)
            for bucket, ok in bags.buckets(at):
                ids.append(bucket[ok].astype(np.int32))
                own.append(of[ok])
        ids, own = np.concatenate(ids), np.concatenate(own)
        count = np.maximum(_sums(own, np.ones(len(y)), own, len(y)), 1)
        for _ in range(steps):
            diff = soft[1] - soft[0]
            value = emb @ diff
            z = _sums(own, value, ids, len(y)) / count + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = (p - y) * weight / len(y)
            per = _sums(ids, g / count, own, 1 << bits)  # each bucket's share; its gradient is this times diff
            grad_soft = (per[:, None] * emb).sum(0)
            touched = np.flatnonzero(per)
            grad = per[touched, None] * diff + decay * emb[touched] / len(y)
            square[touched] += (grad**2).mean(1, keepdims=True)
            emb[touched] -= rate * grad / np.sqrt(square[touched])
            both = np.stack([-grad_soft, grad_soft])
            square_soft += both**2
            soft -= rate * both / np.sqrt(square_soft)
            square_bias += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(square_bias)
        model = Model(bits, width, (emb @ (soft[1] - soft[0])).astype(np.float32), float(bias))
    return model


def calibrate(model: Model, texts: list[str], toxic: np.ndarray, share: float, cut: float) -> float:
    """The shift of logits that puts the best F1, at the given share of toxic texts, on the score ``cut``."""
    _, offsets = buffers(pa.array(texts, pa.string()))
    z = np.concatenate([model.logits(Bags(pa.array(texts[i:j], pa.string()), model.bits))[0] for i, j in text_slices(offsets, 400_000)])
    y = toxic.astype(bool)
    if not y.any() or y.all():
        return 0.0
    levels = np.unique(z)
    mids = np.r_[levels[0] - 1, (levels[1:] + levels[:-1]) / 2, levels[-1] + 1]
    hit = np.array([(z[y] >= m).mean() for m in mids]) * share
    wrong = np.array([(z[~y] >= m).mean() for m in mids]) * (1 - share)
    f1 = 2 * hit / np.maximum(hit + wrong + share, 1e-9)
    best = mids[f1 >= f1.max() - 1e-12]
    return float(np.log(cut / (1 - cut)) - (best.min() + best.max()) / 2)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 1200, longest: int = 3000, cut: float = 0.3) -> Model | None:
    """Fit on a bounded sample: at most ``most`` toxic and as many other labelled texts of up to ``longest`` bytes, by a
    hash of their ids; one text of an id, the smallest. Rows whose crc32(doc_id) mod 4 is 2 are never read. None if either class is missing."""
    known = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    picked = [known.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # 2 * most rows
    rows = sample.where(f"octet_length(text) <= {longest}").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    texts, toxic = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    fold = np.arange(len(texts)) % 5 == 4
    part = [t for t, f in zip(texts, fold, strict=True) if not f]
    trial = train(part, toxic[~fold]) if len(set(toxic[~fold].tolist())) == 2 else None
    model = train(texts, toxic)
    if trial is not None:
        model.bias += calibrate(trial, [t for t, f in zip(texts, fold, strict=True) if f], toxic[fold], share, cut)
    return model


def score(docs: DataFrame, model: Model | None, slice_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` (doc_id, text) with ``score`` from 0 to 1. Null, empty and blank texts get the score of no evidence;
    repeated rows equal scores; without a model all scores are 0. Extra columns are ignored."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for i, j in text_slices(offsets, slice_bytes):
                part = batch.slice(i, j - i)
                z = model.logits(Bags(part["text"], model.bits))[0]
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def op9_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    small_batches(spark)
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(spark, docs, labels))
    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_subword": op9_subword}
