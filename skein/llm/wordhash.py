"""Words of many texts as 64-bit hashes, computed over their bytes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: All of ASCII but letters and digits.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MULTIPLIERS = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))


def _multipliers(n: int) -> np.ndarray:
    """An odd random multiplier for each place in a word."""
    global _MULTIPLIERS
    if len(_MULTIPLIERS) < n:
        _MULTIPLIERS = mix(np.arange(1, max(64, 2 * n) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _MULTIPLIERS


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """hashes: of all words in order; first: where each text's words begin (one entry more than texts);
    start, stop: each word's bytes in ``data``."""

    def __init__(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.data, self.hashes, self.first, self.start, self.stop = data, hashes, first, start, stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of an Arrow string array; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, raw = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array, lower: bool = False, marks: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower`` lowers A-Z before hashing; with ``marks``, ASCII marks
    and control characters separate words too."""
    data, offsets = buffers(texts)
    inside = ~(_MARKS if marks else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's first byte never continues the word before
    begin = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    start = np.flatnonzero(begin)
    ends = inside & (edge[1:] | ~np.r_[inside[1:], False])
    stop = np.flatnonzero(ends) + 1
    if not len(start):
        return Words(data, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), start, stop)
    size = stop - start
    letters = data[inside]
    if lower:
        letters = _LOWER[letters]
    at = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(_BYTE[letters] * _multipliers(int(size.max()))[place], at)
        hashes = mix(total + size.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    return Words(data, hashes, np.searchsorted(start, offsets), start, stop)


def spans(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n elements that begin at each place of ``x`` (len(x) - n + 1 of them)."""
    out, done, power, width = None, 0, x, 1
    while width <= n:
        if n & width:
            out = power if out is None else pair(out[: len(out) - width], power[done:], seed + width)
            done += width
        if width * 2 <= n:
            power = pair(power[:-width], power[width:], seed)
        width *= 2
    return out


def text_slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, or one longer text."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out
