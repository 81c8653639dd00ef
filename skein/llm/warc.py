"""WARC archives as seekable Zstandard bundles: records in independent frames, a seek table at the end, an index by record.

A bundle is a file of Zstandard frames, each of whole records, closed by the seek table of the public seekable
format (a skippable frame, so that plain decoders read bundles too). The index maps a record to its bundle, its frame and its
place within the frame, so one record is read with one ranged read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, bits_for, likely, parted

#: Fixed values of the seekable format: the magic numbers of its skippable frame and of its footer, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = "record_id string, page_id string, kind string, bundle string, frame int, frame_at long, frame_size long, at long, size long"
RECORD = "record_id string, page_id string, kind string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _header(value: str) -> str:
    """A value on one line: what is not visible ASCII or UTF-8 is percent-encoded, and so is the percent sign."""
    return "".join(c if c > " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in value)


def _plain(value: str) -> str:
    out, rest = "", value
    while "%" in rest:
        head, _, rest = rest.partition("%")
        out, rest = out + head + chr(int(rest[:2], 16)), rest[2:]
    return out + rest


def record(row: dict, date: str) -> bytes:
    """One WARC record. A response holds its payload; a revisit names the response that does, and keeps the length and digest."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"" if row["kind"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['kind']}", f"WARC-Record-ID: <urn:uuid:{row['record_id']}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_header(row['url'])}"] if row["url"] is not None else []
    lines += [f"Page-ID: {_header(row['page_id'])}"] if row["page_id"] is not None else []
    if row["kind"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{row['refers_id']}>"]
        lines += [f"Refers-To-Page-ID: {_header(row['refers_to'])}"] if row["refers_to"] is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: memoryview, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one does; a payload that is not what its digest says raises ValueError."""
    end = bytes(data[at : at + 65536]).find(b"\r\n\r\n")
    end = at + end if end >= 0 else bytes(data).index(b"\r\n\r\n", at)
    version, *lines = bytes(data[at:end]).decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    begin, size = end + 4, int(head["Content-Length"])
    block = bytes(data[begin : begin + size])
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    text = lambda k: _plain(head[k]) if k in head else None
    out = {"record_id": head["WARC-Record-ID"][10:-1], "page_id": text("Page-ID"), "kind": kind, "url": text("WARC-Target-URI"), "payload_digest": digest}
    return out | {"payload_bytes": length, "refers_to": text("Refers-To-Page-ID"), "payload": payload if kind == "response" else None}, begin + size + 4


def _opened(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


class Bundle:
    """A bundle that is being written: frames, then their seek table."""

    def __init__(self, root: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        fs, path = _opened(root)
        fs.create_dir(path, recursive=True)
        self.out, self.frames, self.at = fs.open_output_stream(f"{path}/{self.name}", compression=None), [], 0

    def frame(self, data: bytes, level: int) -> tuple[int, int, int]:
        """Write a frame; its number, place and size."""
        packed = zstandard.ZstdCompressor(level=level).compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.at += len(packed)
        return len(self.frames) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """(place, compressed size, size, checksum) of each frame of an open bundle, from its last bytes alone."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table with checksums")
    file.seek(end - 9 - 12 * n)
    out, at = [], 0
    for packed, size, check in struct.iter_unpack("<III", file.read(12 * n)):
        out.append((at, packed, size, check))
        at += packed
    return out


def _frame(file, at: int, packed: int, check: int | None = None) -> bytes:
    file.seek(at)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed))
    if check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame is damaged")
    return data


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def records(scratch: Scratch, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row for each record to write: who it is, and the payload of those that hold it.

    Only digests are grouped; payloads are shuffled for the first of equal ones alone, all others go where they stand.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").alias("id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    who = ["key", "id", "url", "sha1", "bytes"]
    seen = scratch.keep(rows.where(F.col("bytes") >= least_bytes).groupBy(*who).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("key")))
    lead = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "url")).alias("lead")
    equal = scratch.keep(seen.groupBy("key", "h").agg(lead, F.sum("n").alias("total")).where("total > 1").drop("total"))
    bits = bits_for(equal.count())
    some, alone = parted(rows.withColumn("h", F.xxhash64("key")), "h", equal, bits)
    # Of those that may have equals, without payloads: which are responses, and of whom the others are revisits.
    narrow = likely(seen, "h", equal, bits).join(equal.select("key", "lead"), "key", "left")
    same = F.col("id").eqNullSafe(F.col("lead.id")) & F.col("url").eqNullSafe(F.col("lead.url"))
    narrow = scratch.keep(narrow.withColumn("holds", F.col("lead").isNull() | same).withColumn("h", F.xxhash64("key", "id", "url")))
    holds = narrow.where("holds").select(F.col("key").alias("r_key"), F.col("id").alias("r_id"), F.col("url").alias("r_url"), "h")
    # Payloads are shuffled for these alone. Rows equal in page_id, url and payload are one response and revisits.
    found = likely(some.withColumn("h", F.xxhash64("key", "id", "url")), "h", holds, bits_for(holds.count())).join(holds, "h")
    found = found.where((F.col("key") == F.col("r_key")) & F.col("id").eqNullSafe(F.col("r_id")) & F.col("url").eqNullSafe(F.col("r_url")))
    found = found.groupBy(*who).agg(F.first("payload").alias("payload"))
    short = some.where(F.col("bytes") < least_bytes)
    again = narrow.withColumn("copy", F.explode(F.sequence(F.when(F.col("holds"), 1).otherwise(0), F.col("n").cast("int"))))
    again = again.where(F.col("copy") < F.col("n"))

    def uid(of: Column, url: Column, copy: Column) -> Column:
        """A record's id, from what it is alone, so that a task that runs again names it alike."""
        text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
        h = F.sha2(F.concat_ws("\n", text(of), text(url), "key", copy.cast("string")), 256)
        return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    def final(df: DataFrame, kind: str, copy: Column, payload: Column) -> DataFrame:
        lead = [F.col("lead.id").cast("string"), uid(F.col("lead.id"), F.col("lead.url"), F.lit(0))] if kind == "revisit" else [F.lit(None).cast("string")] * 2
        return df.select(
            uid(F.col("id"), F.col("url"), copy).alias("record_id"), F.col("id").cast("string").alias("page_id"), F.lit(kind).alias("kind"), "url", "sha1", "bytes",
            lead[0].alias("refers_to"), lead[1].alias("refers_id"), payload.alias("payload"),
        )

    out = final(again, "revisit", F.col("copy"), F.lit(None).cast("binary"))
    for df in (alone.where(F.col("bytes") >= least_bytes), found):
        out = out.unionByName(final(df, "response", F.lit(0), F.col("payload")))
    if least_bytes > 0:  # small payloads are never compared; equal rows among them differ by their places
        for df in (alone.where(F.col("bytes") < least_bytes), short):
            out = out.unionByName(final(df, "response", F.monotonically_increasing_id(), F.col("payload")))
    return out


def write_archives(
    scratch: Scratch, pages: DataFrame, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28, level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> tuple[str, DataFrame]:
    """Write a record for each row of ``pages`` (page_id, url, html); the folder of the bundles, and their index (INDEX).

    Of rows whose payloads (html in UTF-8) are equal and have at least ``least_bytes`` bytes, that with the smallest page_id
    (then url) is a response, the others revisit it; null page_ids come last. Rows equal in page_id, url and html are one response and
    revisits. A null html is an empty payload; a null url or page_id has no header; other columns are ignored; an empty table
    gives an empty index. Frames hold about ``frame_bytes`` before compression, or one longer record; bundles about
    ``bundle_bytes``. Bundles have names of their own, and only those of tasks that ended well are in the index, so tasks may run twice.
    """
    root = f"{scratch.root}/warc"
    schema = _arrow(scratch.spark, INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, data, held = None, bytearray(), []

        def flush() -> pa.RecordBatch:
            number, at, size = bundle.frame(bytes(data), level)
            out = _batch([x | {"bundle": bundle.name, "frame": number, "frame_at": at, "frame_size": size} for x in held], schema)
            data.clear()
            held.clear()
            return out

        for b in batches:
            for row in (x for k in range(0, b.num_rows, 64) for x in b.slice(k, 64).to_pylist()):
                one = record(row, date)
                bundle = bundle or Bundle(root)
                held.append({"record_id": row["record_id"], "page_id": row["page_id"], "kind": row["kind"], "at": len(data), "size": len(one)})
                data += one
                if len(data) >= frame_bytes:
                    yield flush()
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if held:
            yield flush()
        if bundle:
            bundle.close()

    return root, scratch.keep(records(scratch, pages, least_bytes).mapInArrow(write, INDEX))


def read_archives(root: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records (RECORD) of the bundles that an index names, read frame by frame by their seek tables.

    Payloads are checked against their digests, frames against their checksums; damage raises ValueError. Without ``payloads``
    they are checked, but not returned.
    """
    schema = _arrow(index.sparkSession, RECORD)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = _opened(f"{root}/{name}")
                with fs.open_input_file(path) as f:
                    rows = [{"bundle": name, "at": at, "packed": packed, "crc": check} for at, packed, _, check in seek_table(f)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bundle", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                fs, path = _opened(f"{root}/{x['bundle']}")
                with fs.open_input_file(path) as f:
                    data = memoryview(_frame(f, x["at"], x["packed"], x["crc"]))
                at, rows = 0, []
                while at < len(data):
                    row, at = parsed(data, at)
                    rows.append(row if payloads else row | {"payload": None})
                yield _batch(rows, schema)

    bundles = index.select("bundle").distinct()
    cores = index.sparkSession.sparkContext.defaultParallelism
    each = bundles.mapInArrow(frames, "bundle string, at long, packed long, crc long")
    return each.repartition(max(cores, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bundle", "at").mapInArrow(read, RECORD)


def fetch(root: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records (RECORD) whose record_id stands in ``wanted`` (record_id), each frame read once by a task, by its place alone.
    Ids that no bundle holds give no row; repeated ones are one."""
    schema = _arrow(index.sparkSession, RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data = None, b""
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if held != (x["bundle"], x["frame_at"]):
                    fs, path = _opened(f"{root}/{x['bundle']}")
                    with fs.open_input_file(path) as f:
                        held, data = (x["bundle"], x["frame_at"]), _frame(f, x["frame_at"], x["frame_size"])
                rows.append(parsed(memoryview(data)[x["at"] : x["at"] + x["size"]], 0)[0])
            yield _batch(rows, schema)

    some = index.join(wanted.select("record_id").distinct(), "record_id").select("bundle", "frame_at", "frame_size", "at", "size")
    return some.repartition("bundle", "frame_at").sortWithinPartitions("bundle", "frame_at", "at").mapInArrow(read, RECORD)


def op11_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to bundles, and what the bundles say of them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    back = read_archives(*write_archives(Scratch(spark), pages), payloads=False)
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")
    )


QUERIES = {"op11_seekable": op11_seekable}
ORACLES = {
    "op11_seekable": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
f as (select *, row_number() over (partition by html order by page_id nulls last) as n, first_value(page_id) over (partition by html order by page_id nulls last) as lead from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[5 * (k // 4) + 1:5 * (k // 4) + 5])::bigint >> (15 - 5 * (k % 4))) & 31) + 1]), '') as payload_digest,
  case when n = 1 then 'response' else 'revisit' end as record_type, case when n > 1 then lead end as refers_to from f"""
}
