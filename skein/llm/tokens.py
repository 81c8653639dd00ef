"""Token ids of whole texts by a word-level BPE file of ``tokenizers``, with each word encoded once a worker.

The file's rule splits at white space and lower-cases, so a text's ids are the ids of its chunks in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skein.llm.wordhash import Words, split

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its cache lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Table:
    """Places of words by their 64-bit hashes: open addressing over arrays, many at a time."""

    def __init__(self, bits: int = 16):
        self.n, self.mask = 0, np.uint64((1 << bits) - 1)
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        slot = (h & self.mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == h, self.places[slot], -1)
        left = np.flatnonzero((held != h) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            held = self.keys[slot[left]]
            same = held == h[left]
            out[left[same]] = self.places[slot[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def add(self, h: np.ndarray, places: np.ndarray) -> None:
        """Hashes not in the table, each once."""
        self.n += len(h)
        if self.n * 2 > len(self.keys):
            full = self.keys != 0
            old, at = self.keys[full], self.places[full]
            self.__init__(int(self.n * 4).bit_length())
            self.n = 0
            self.add(np.r_[old, h], np.r_[at, places])
            return
        slot = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.places[slot[put]] = h[put], places[put]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


def put(old: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``old`` with new values behind its first ``n``; a full array is doubled, so that all is not copied each time."""
    if n + len(new) > len(old):
        grown = np.zeros(2 * (n + len(new)), old.dtype)
        grown[:n] = old[:n]
        old = grown
    old[n : n + len(new)] = new
    return old


def texts_of(w: Words, some: np.ndarray) -> list[str]:
    """The words at certain places, in lower case (A-Z), read from one text with a space behind each."""
    size = w.stop[some] - w.start[some]
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]), 32, np.uint8)
    at = np.arange(int(size.sum()))
    first = np.cumsum(size) - size
    out[np.repeat(ends - size - 1 - first, size) + at] = w.data[np.repeat(w.start[some] - first, size) + at]
    return out[:-1].tobytes().lower().decode().split(" ")


class WordEncoder:
    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.plain, self.most = Tokenizer.from_file(path), most
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at = _Table()
        self.words, self.held = 0, 0  # used of the arrays below
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _places(self, w: Words) -> np.ndarray:
        """Places of words; those not seen before are learnt."""
        h = np.maximum(w.hashes, np.uint64(1))
        out = self.at.find(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, one = np.unique(h[missing], return_index=True)
            self._learn(new, texts_of(w, missing[one]))
            out[missing] = self.at.find(h[missing])
        return out

    def _learn(self, hashes: np.ndarray, new: list[str]) -> None:
        """Words of letters are encoded many at a time, each ending with its end-of-word id; a word and the stop
        behind it come from their parts; others are encoded one by one."""
        simple, other, parts = [], [], []
        for k, w in enumerate(new):
            if w.isalpha():
                simple.append(k)
            elif w[-1] in ".," and w.isascii() and w[:-1].isalpha():
                parts.append(k)
            else:
                other.append(k)
        if parts:
            text = " ".join([new[k][:-1] + " " + new[k][-1] for k in parts])
            both = self._places(split(pa.array([text])))
            known = self.at.find(hashes)
            if (known >= 0).any():  # a stem that is itself among the new words
                rest = np.flatnonzero(known < 0)
                return self._learn(hashes[rest], [new[k] for k in rest])
        first, length, found = self.words, np.zeros(len(new), np.int64), []
        order: list[int] = []
        for i in range(0, len(simple), 2000):
            part = simple[i : i + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join([new[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                length[part] = np.diff(np.r_[0, stops])
                found.append(ids)
                order += part
            else:
                other += part
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            got = [e.ids for e in self.plain.encode_batch_fast([new[k] for k in part], add_special_tokens=False)]
            length[part] = [len(g) for g in got]
            found.append(np.array([x for g in got for x in g], np.uint32))
            order += part
        if parts:
            ids, n = self._gather(both)
            length[parts] = n.reshape(-1, 2).sum(1)
            found.append(ids)
            order += parts
        start = np.zeros(len(new), np.int64)
        start[order] = self.held + np.cumsum(length[order]) - length[order]
        ids = np.concatenate([*found, np.zeros(0, np.uint32)])
        self.ids = put(self.ids, self.held, ids)
        self.start, self.length = put(self.start, first, start), put(self.length, first, length)
        self.words, self.held = first + len(new), self.held + len(ids)
        self.at.add(hashes, first + np.arange(len(new)))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in order, and how many each has."""
        n = self.length[places]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[places] - (ends - n), n) + np.arange(total)], n

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null: none."""
        if self.words > self.most:
            self.clear()
        # A text with a special token keeps its letters' case.
        special = {i: t for i, t in enumerate(texts.to_pylist()) if t and "<|" in t}
        if special:
            texts = pa.array(["" if i in special else t for i, t in enumerate(texts.to_pylist())], pa.string())
        w = split(texts, lower=True)
        places = self._places(w)
        for i in range(len(texts)):
            if i in special:
                yield np.array(self.plain.encode(special[i], add_special_tokens=False).ids, np.uint32)
            else:
                yield self._gather(places[w.first[i] : w.first[i + 1]])[0]
