"""Packing along a space-filling curve: neighbours in meaning become neighbours in a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, documents, small_batches
from skein.llm.tokens import encoder
from skein.llm.wordhash import buffers, text_slices


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of unsigned coordinates below 2**bits (dimensions * bits <= 63)."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (one << np.uint64(b))) != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(ids: list[np.ndarray], buckets: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Hilbert keys of documents: counts of hashed ids, damped and scaled to length 1, projected to few dimensions."""
    if not ids:
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    project = np.linalg.qr(rng.standard_normal((buckets, dims)))[0]
    of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    flat = np.concatenate(ids).astype(np.uint64)
    hashed = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
    counts = np.bincount(of * buckets + hashed.astype(np.int64), minlength=len(ids) * buckets)
    v = np.sqrt(counts.reshape(len(ids), buckets))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cells = ((v @ project + 1) / 2 * (2**bits - 1)).clip(0, 2**bits - 1)
    return hilbert(cells.astype(np.uint64), bits)


def pack(
    scratch: Scratch,
    docs: DataFrame,
    tokenizer: str,
    end: int | None = 2,
    length: int = 4096,
    buckets: int = 256,
    dims: int = 3,
    bits: int = 20,
    seed: int = 7,
    slice_bytes: int = 500_000,
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, in the order of the Hilbert key.

    docs: ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. The documents' ids, each ended by ``end``, stand in one
    stream that is cut at every ``length``-th token, so only the last sequence has padding. Null and empty texts
    are the end id alone (nothing at all if ``end`` is None). Repeated rows are packed as often as they occur;
    null doc_ids are kept. Documents with equal keys stand by doc_id. An empty table gives no pieces.

    Token ids are written once; only keys and counts are range-sorted. Places in the stream come from running sums
    within partitions plus the totals of the partitions before, so no task sees more than its share, however
    many documents have the same key.
    """
    spark = scratch.spark
    small_batches(spark)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = np.uint16 if len(enc.ends) <= 65536 and (end or 0) < 65536 else np.uint32
        for b in batches:
            _, offsets = buffers(b["text"])
            for i, j in text_slices(offsets, slice_bytes):
                part = b.slice(i, j - i)
                ids = list(enc.encode(part["text"]))
                keys = curve_keys(ids, buckets, dims, bits, seed)
                if end is not None:
                    ids = [np.append(x, np.uint32(end)) for x in ids]
                n = [len(x) for x in ids]
                raw = pa.array([x.astype(width).tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(keys), pa.array(n, pa.int64()), pa.array([width().itemsize] * len(n), pa.int32()), raw],
                    names=["doc_id", "key", "n", "width", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    t = docs.select("doc_id", "text").mapInArrow(tokenised, f"doc_id {kind}, key long, n long, width int, ids binary")
    t = scratch.keep(t.withColumn("uid", F.monotonically_increasing_id()))

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for b in batches:
            ends = before + b["n"].cumsum()
            yield b[["uid", "pid"]].assign(at=ends - b["n"], n=b["n"])
            before = int(ends.iloc[-1]) if len(b) else before

    order = ["key", "doc_id", "uid"]
    r = t.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
    r = scratch.keep(r.withColumn("pid", F.spark_partition_id()).mapInPandas(running, "uid long, pid int, at long, n long"))
    before = r.groupBy("pid").agg(F.sum("n").alias("n"))
    before = before.selectExpr("pid", "sum(n) over (order by pid) - n as base")  # a row per partition
    r = r.join(F.broadcast(before), "pid").selectExpr("uid", "at + base as at")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, n, width, raw, at in zip(b["doc_id"], b["n"], b["width"], b["ids"], b["at"], strict=True):
                ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    place = at + start
                    size = min(n - start, length - place % length)
                    out.append((doc, start, size, ids[start : start + size].tobytes(), n, place // length, place % length))
                    start += size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    full = t.join(r, "uid").select("doc_id", "n", "width", "ids", "at")
    return full.mapInPandas(
        cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    pieces = pack(Scratch(spark), documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op4_hilbert": op4_hilbert}
