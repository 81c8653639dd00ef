"""Any split of a text gives the result of the whole; places and cuts of texts against Python."""

import random

from pyspark.sql import functions as F

from skein.functions import offsets
from skein.streaming.chunks import Parser, parse_chunks, parse_stream

TAGS = {"cite": ("<c>", "</c>"), "plan": ("<<plan>>", "<</plan>>")}
TEXTS = ["a<c>één</c>b", "<c>", "x<c>y", "no tags < here <c", "数<<plan>><c>z</c><</plan>>据😀<c></c><c>1</c>", "", "<<c>q</c>", "<<plan>>a<</plan>", "</c><c>a<c>b</c>c</c>"]
WHOLE = [("ab", [("cite", "één")]), ("", [("cite", "")]), ("x", [("cite", "y")]), ("no tags < here <c", []), ("数据😀", [("plan", "<c>z</c>"), ("cite", ""), ("cite", "1")]), ("", []), ("<", [("cite", "q")]), ("", [("plan", "a<</plan>")]), ("</c>c</c>", [("cite", "a<c>b")])]


def joined(pieces):
    return "".join(p["visible"] for p in pieces), [(x["tag"], x["content"]) for p in pieces for x in p["extracted"]]


def test_any_split_is_the_whole():
    rng = random.Random(4)
    for text, want in zip(TEXTS, WHOLE, strict=True):
        data = text.encode()
        for _ in range(200):
            cuts = sorted(rng.choices(range(len(data) + 1), k=rng.randrange(6)))
            parser, pieces = Parser(TAGS), []
            for a, b in zip([0, *cuts], [*cuts, len(data)]):
                pieces.append(parser.push(data[a:b]))
                parser = Parser(TAGS, parser.state())
            pieces.append(parser.finish())
            assert joined(pieces) == want and not any(p["error"] for p in pieces)


def test_bad_chunks_roll_back():
    p = Parser(TAGS)
    assert p.push("é".encode()[:1])["visible"] == "" and p.push(b"x")["error"] == "invalid UTF-8 after 0 bytes"
    assert p.push("é".encode()[1:] + b"ok")["visible"] == "éok" and p.push(b"fine\xff")["error"] == "invalid UTF-8 after 4 bytes"
    assert p.push("数".encode()[:2])["error"] is None and p.finish()["error"] == "incomplete UTF-8 at the end"


def chunked(rng):
    rows = []
    for k, text in enumerate(TEXTS):
        data = text.encode()
        cuts = sorted(rng.sample(range(len(data) + 1), min(len(data), 5)))
        rows += [(k, n, data[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)]))]
    return rows


def test_chunks_of_a_table(spark):
    rows = chunked(random.Random(1))
    df = spark.createDataFrame(rows, "id long, n int, chunk binary").repartition(5)
    got = {}
    for r in parse_chunks(df, "id", "n", "chunk", TAGS).orderBy("id", "n").collect():
        got.setdefault(r.id, []).append(r.asDict(recursive=True))
    assert {k: joined(v) for k, v in got.items()} == dict(enumerate(WHOLE))
    ended = spark.createDataFrame([(1, 0, b"a<c>b"), (1, 1, None), (1, 2, b"c</c>"), (2, 0, b"\xff")], df.schema)
    out = [(r.id, r.n, r.visible, [x.content for x in r.extracted], r.error) for r in parse_chunks(ended, "id", "n", "chunk", TAGS).orderBy("id", "n").collect()]
    assert out == [(1, 0, "a", [], None), (1, 1, "", ["b"], None), (1, 2, "c</c>", [], None), (2, 0, "", [], "invalid UTF-8 after 0 bytes")]
    assert parse_chunks(df.where("false"), "id", "n", "chunk", TAGS).count() == 0


def test_chunks_of_a_stream(spark, tmp_path):
    rows = chunked(random.Random(2)) + [(k, 99, None) for k in range(len(TEXTS))]
    schema = "id long, n int, chunk binary"
    for part in range(3):
        spark.createDataFrame([r for r in rows if min(r[1] // 2, 2) == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    q = parse_stream(stream, "id", "n", "chunk", TAGS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id", "n").collect():
        got.setdefault(r.id, []).append(r.asDict(recursive=True))
    assert {k: joined(v) for k, v in got.items()} == dict(enumerate(WHOLE))


def test_match_ranges(spark):
    texts = ["The 😀the thé THE", "", None, "nothing", "😀😀Theтhe the", "İthe" * 3, "the" * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(offsets.match_ranges(F.col("t"), "The").alias("r")).collect()
    for t, r in zip(texts, got, strict=True):
        low, want, i = (t or "").replace("İ", "i").lower(), [], 0
        while (i := low.find("the", i)) >= 0:
            sizes = [(len(t[:k].encode()), len(t[:k].encode("utf-16-le")) // 2) for k in (i, i + 3)]
            want.append((i, i + 3, sizes[0][0], sizes[1][0], sizes[0][1], sizes[1][1]))
            i += 3
        assert [tuple(x) for x in r.r] == want


def shortened(t, most, tokens):
    data = t.encode()
    if len(data) <= most:
        return t
    left, head, tail = most // 2, "", len(t)
    for k in range(len(t) + 1):
        if len(t[:k].encode()) <= left:
            head = t[:k]
        if tail == len(t) and len(t[:k].encode()) >= len(data) - (most - left):
            tail = k
    end = t[max(tail, len(head)) :]
    gone = f"{-(-(len(data) - most) // 4)} tokens" if tokens else f"{len(t) - len(head) - len(end)} chars"
    return f"{head}…{gone} truncated…{end}"


def test_truncation_by_bytes_and_tokens(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aé数😀") for _ in range(rng.randrange(40))) for _ in range(150)] + ["", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 2, 7, 16, 33):
        got = df.select(offsets.truncate_bytes(F.col("t"), most), offsets.truncate_tokens(F.col("t"), most // 4), offsets.cut_bytes(F.col("t"), most)).collect()
        for t, r in zip(texts, got, strict=True):
            whole = [k for k in range(len(t) + 1) if len(t[:k].encode()) <= most]
            assert tuple(r) == (shortened(t, most, False), shortened(t, most // 4 * 4, True), len(t[: whole[-1]].encode())), (t, most)


def test_ranges_of_many_matches_take_time_by_the_text(spark):
    """A fold that copies its list at each match needs minutes for these."""
    n = 300_000
    df = spark.createDataFrame([("é𝄞EN" * n,)], "t string").select(offsets.match_ranges(F.col("t"), "en").alias("r"))
    size, last = df.select(F.size("r"), F.element_at("r", -1)).first()
    assert size == n and tuple(last) == (4 * n - 2, 4 * n, 8 * n - 2, 8 * n, 5 * n - 2, 5 * n)
