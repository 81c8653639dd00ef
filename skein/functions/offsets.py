"""Places in a text by code points, bytes and UTF-16 units, and cuts at whole characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import comparable, find_all


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text: characters of four bytes have two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


_RANGE = ("start", "end", "start_byte", "end_byte", "start_utf16", "end_utf16")


def ranges(text: str, low: str, needle: str) -> list[tuple[int, ...]]:
    """Matches of a needle in ``low``, a text in lower case, as places in ``text``: see ``match_ranges``. One pass over the pieces between them."""
    places, size = find_all(low, needle), len(needle)
    if text.isascii():
        return [(a, a + size) * 3 for a in places]
    out, at, b, u = [], 0, 0, 0
    for a in places:
        row = []
        for to in (a, a + size):
            piece = text[at:to]
            b, u, at = b + len(piece.encode()), u + len(piece.encode("utf-16-le")) // 2, to
            row.append((to, b, u))
        out.append(tuple(x for pair in zip(*row, strict=True) for x in pair))
    return out


def match_ranges(text: Column, needle: str) -> Column:
    """All matches of a literal that do not overlap, whatever their case: an array of structs start, end (code points from 0, end
    excluded), start_byte, end_byte (in UTF-8), start_utf16, end_utf16. Null and empty texts have none."""
    low = needle.lower()

    @F.arrow_udf("array<struct<" + ", ".join(f"{k}: int" for k in _RANGE) + ">>")
    def found(texts: pa.Array, lows: pa.Array) -> pa.Array:
        borders, flat = [0], []
        for t, x in zip(texts, lows, strict=True):
            flat += ranges(t.as_py(), x.as_py(), low)
            borders.append(len(flat))
        columns = zip(*flat, strict=True) if flat else [[]] * len(_RANGE)
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=_RANGE)
        return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), rows)

    filled = F.coalesce(text, F.lit(""))
    return found(filled, comparable(filled))


def _follows(raw: Column, at: Column) -> Column:
    """Whether the byte at a place (from 1) continues a character."""
    return F.coalesce(F.conv(F.hex(F.substr(raw, at, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))


def cut_bytes(text: Column, most: Column | int) -> Column:
    """How many bytes of the longest start of a text have at most ``most`` bytes and whole characters."""
    most = F.lit(most) if isinstance(most, int) else most

    def border(x: Column) -> Column:
        cut = F.least(x["most"], F.octet_length(x["raw"]))
        return F.coalesce(*[F.when(~_follows(x["raw"], cut - k + 1), F.greatest(cut - k, F.lit(0))) for k in range(4)])

    return _bind(F.struct(F.encode(text, "UTF-8").alias("raw"), most.alias("most")), border)


def truncate_bytes(text: Column, most: Column | int, tokens: bool = False) -> Column:
    """At most ``most`` bytes of a text, half from its start (rounded down) and the rest from its end, cut at whole characters, and
    between them how many characters were left out; with ``tokens``, how many tokens of about four bytes. Texts within the budget and null stay."""
    most = F.lit(most) if isinstance(most, int) else most
    left = F.floor(most / 2).cast("int")
    right = most - left

    def cut(x: Column) -> Column:
        n = F.octet_length(x["raw"])
        head = cut_bytes(x["text"], left)
        start = n - right
        begin = F.coalesce(*[F.when(~_follows(x["raw"], start + k + 1), start + k) for k in range(4)])
        return _bind(F.struct(head.alias("h"), begin.alias("t"), n.alias("n")), lambda y: _bind(F.struct(
            F.decode(F.substr(x["raw"], F.lit(1), y["h"]), "UTF-8").alias("a"), F.decode(F.substr(x["raw"], F.greatest(y["t"], y["h"]) + 1, y["n"]), "UTF-8").alias("b"), y["n"].alias("n"),
        ), lambda z: F.concat(z["a"], F.lit("…"), (
            F.ceil((z["n"] - most) / 4).cast("string") if tokens else (F.length(x["text"]) - F.length(z["a"]) - F.length(z["b"])).cast("string")
        ), F.lit(" tokens truncated…" if tokens else " chars truncated…"), z["b"])))

    return F.when(F.octet_length(text) <= most, text).otherwise(_bind(F.struct(text.alias("text"), F.encode(text, "UTF-8").alias("raw")), cut))


def truncate_tokens(text: Column, most: Column | int) -> Column:
    """``truncate_bytes`` by tokens of about four bytes."""
    return truncate_bytes(text, most * 4, tokens=True)
