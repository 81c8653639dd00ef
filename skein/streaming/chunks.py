"""Texts that come in chunks of bytes: whole characters, hidden tags and what they hold, whatever the chunks are."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a chunk gives: text to show, contents of tags that ended, and why it was refused, if it was.
PIECE = "visible string, extracted array<struct<tag: string, content: string>>, error string"


class Parser:
    """What is known of a text between two chunks: bytes of a character that is not whole yet, text that may begin a tag, and the
    open tag with its content so far. Tags (name to its opening and closing mark) are literal and do not nest."""

    def __init__(self, tags: dict[str, tuple[str, str]], state: str | None = None):
        self.tags = tags
        self.rest, self.held, self.open, self.content = json.loads(state) if state else ("", "", None, "")
        self.rest = bytes.fromhex(self.rest)

    def state(self) -> str:
        return json.dumps([self.rest.hex(), self.held, self.open, self.content])

    def push(self, chunk: bytes) -> dict:
        """A chunk's piece. One that makes the text invalid UTF-8 is refused whole: nothing of it is kept."""
        data, cut = self.rest + chunk, 0
        for k in range(4):  # a character may lack its last bytes
            try:
                text, cut = data[: len(data) - k].decode(), k
                break
            except UnicodeDecodeError as e:
                bad = e
                if e.reason != "unexpected end of data":
                    return {"visible": "", "extracted": [], "error": f"invalid UTF-8 after {e.start} bytes"}
        else:
            return {"visible": "", "extracted": [], "error": f"invalid UTF-8 after {bad.start} bytes"}
        self.rest = data[len(data) - cut :]
        return self._text(text)

    def _text(self, text: str) -> dict:
        shown, out, text = [], [], self.held + text
        while True:
            if self.open is None:
                at, name = min(((text.find(a), n) for n, (a, _) in self.tags.items() if a in text), default=(-1, None))
                if at < 0:
                    keep = _overlap(text, [a for a, _ in self.tags.values()])
                    shown.append(text[: len(text) - keep])
                    break
                shown.append(text[:at])
                self.open, self.content, text = name, "", text[at + len(self.tags[name][0]) :]
            else:
                close = self.tags[self.open][1]
                at = text.find(close)
                if at < 0:
                    keep = _overlap(text, [close])
                    self.content += text[: len(text) - keep]
                    break
                out.append({"tag": self.open, "content": self.content + text[:at]})
                self.open, self.content, text = None, "", text[at + len(close) :]
        self.held = text[len(text) - keep :]
        return {"visible": "".join(shown), "extracted": out, "error": None}

    def finish(self) -> dict:
        """What the end of the text gives: an open tag ends there; a character that is not whole is an error."""
        error = "incomplete UTF-8 at the end" if self.rest else None
        shown, out = (self.held, []) if self.open is None else ("", [{"tag": self.open, "content": self.content + self.held}])
        self.rest, self.held, self.open, self.content = b"", "", None, ""
        return {"visible": shown, "extracted": out, "error": error}


def _overlap(text: str, marks: list[str]) -> int:
    """Characters at the end of a text that may begin one of the marks."""
    return max((k for m in marks for k in range(1, min(len(m) - 1, len(text)) + 1) if text.endswith(m[:k])), default=0)


def parse_chunks(chunks: DataFrame, key: str, ordinal: str, chunk: str, tags: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, ordinal, PIECE) of chunks of bytes, in the order of their ordinals; a null chunk ends its text, and what follows is another.

    Rows are dealt by key and sorted, and a task goes through them with the state of one key at a time, so a text of any length needs
    no more than that. A text without a null chunk ends with its key, and its last chunk's row has what that gives. Chunks that are refused have an error and change nothing.
    """
    rows = chunks.select(key, ordinal, chunk).repartition(key).sortWithinPartitions(key, ordinal)
    schema = T.StructType([rows.schema[key], rows.schema[ordinal], *T.StructType.fromDDL(PIECE)])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parser = None, Parser(tags)  # the last chunk's row waits for what the end of its text gives

        def ended() -> dict:
            end = parser.finish()
            return last | {"visible": last["visible"] + end["visible"], "extracted": last["extracted"] + end["extracted"], "error": last["error"] or end["error"]}

        for b in batches:
            out = []
            for k, n, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if last is not None:
                    out.append(last if last[key] == k else ended())
                    parser = parser if last[key] == k else Parser(tags)
                last = {key: k, ordinal: n} | (parser.finish() if c is None else parser.push(c))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=arrow)

    return rows.mapInArrow(work, schema)


def parse_stream(stream: DataFrame, key: str, ordinal: str, chunk: str, tags: dict[str, tuple[str, str]]) -> DataFrame:
    """``parse_chunks`` of a stream: the state of each key lives from batch to batch until a null chunk ends its text. Within a batch
    chunks are taken by their ordinals; what comes in a later batch is later in the text."""
    schema = T.StructType([stream.schema[key], stream.schema[ordinal], *T.StructType.fromDDL(PIECE)])

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parser = Parser(tags, state.get[0] if state.exists else None)
        rows = sorted(((n, c) for b in batches for n, c in zip(b[ordinal], b[chunk], strict=True)), key=lambda x: x[0])
        out = [{key: k[0], ordinal: n} | (parser.finish() if c is None else parser.push(bytes(c))) for n, c in rows]
        state.update((parser.state(),))
        yield pd.DataFrame(out, columns=schema.names)

    return stream.groupBy(key).applyInPandasWithState(work, schema, "state string", "append", GroupStateTimeout.NoTimeout)
