"""WARC bundles by exact round trip; periodic runs and source divergence against brute force."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skein.llm import divergence, periodic, warc
from skein.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

PAGES = [
    (5, "http://a/x y%\r\n", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, "http://b", "<p>one</p>"), (9, "http://b", "<p>one</p>"), (1, None, "only"),
    (2, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>one</p>"), (None, None, "lost"), (None, None, "lost"), (7, "http://é", "üß数" * 3000),
    (8, "http://f", "x" * 5000), (10, "http://f", "x" * 5000), (11, "http://g", "\r\n\r\nWARC/1.1\r\n\r\n"), (12, "http://h", "<p>one</p> "),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "k", 1, "b.c") for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, h int, `a.b` string").repartition(4)


def expected(rows, least):
    """(page_id, bytes, digest, kind, refers_to) of each row."""
    by = collections.defaultdict(list)
    for i, u, t in rows:
        by[(t or "").encode()].append((i is None, i or 0, u or "", i))
    out = []
    for data, who in by.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        who.sort(key=lambda x: x[:3])
        for k, (_, _, _, i) in enumerate(who):
            again = k > 0 and len(data) >= least
            out.append((i, len(data), digest, "revisit" if again else "response", who[0][3] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 11])
def test_archives_round_trip(spark, pages, least):
    s = Scratch(spark)
    root, index = warc.write_archives(s, pages, least_bytes=least, frame_bytes=200, bundle_bytes=400)
    back = warc.read_archives(root, index).collect()
    got = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.kind, None if r.refers_to is None else int(r.refers_to)) for r in back]
    assert sorted(got, key=repr) == expected(PAGES, least)
    texts = collections.Counter((i, u, (t or "").encode()) for i, u, t in PAGES)
    for r in back:
        if r.kind == "response":
            assert (None if r.page_id is None else int(r.page_id), r.url, bytes(r.payload)) in texts
    ids = [r.record_id for r in back]
    assert len(set(ids)) == len(ids) == len(PAGES)
    # Every record again, by its id and one ranged read of its frame; unknown and repeated ids change nothing.
    wanted = spark.createDataFrame([(x,) for x in [*ids[:6], ids[0], "none"]], "record_id string")
    assert sorted(map(repr, warc.fetch(root, index, wanted).collect())) == sorted(repr(r) for r in back if r.record_id in ids[:6])


def test_bundles_are_plain_zstandard(spark, pages):
    root, index = warc.write_archives(Scratch(spark), pages, frame_bytes=300)
    rows = collections.defaultdict(list)
    for r in index.collect():
        rows[r.bundle].append(r)
    for name, records in rows.items():
        fs, path = warc._opened(f"{root}/{name}")
        with fs.open_input_file(path) as f:
            data, table = f.readall(), warc.seek_table(f)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        starts = np.cumsum([0, *(size for _, _, size, _ in table)])
        assert len(whole) == starts[-1] and {r.frame for r in records} == set(range(len(table)))
        for r in records:
            assert whole[starts[r.frame] + r.at :].startswith(b"WARC/1.1\r\nWARC-Type: " + r.kind.encode())
            assert (r.frame_at, r.frame_size) == table[r.frame][:2]
    damaged = bytearray(data)
    damaged[-1] ^= 1
    with fs.open_output_stream(path, compression=None) as f:
        f.write(bytes(damaged))
    with pytest.raises(Exception, match="no seek table"):
        warc.read_archives(root, index).collect()


def test_archives_of_an_empty_table(spark, pages):
    root, index = warc.write_archives(Scratch(spark), pages.where("false"))
    assert warc.read_archives(root, index).count() == 0


def slow_runs(w, times=4, least=6):
    """All stretches that keep a period and cannot grow, by trying every period at every place."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, times * q):
                out.setdefault((i, n), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_equal_brute_force():
    rng = random.Random(3)
    texts = [[rng.randrange(k) for _ in range(rng.randrange(0, 70))] for k in (1, 2, 2, 3, 5) for _ in range(60)]
    for _ in range(150):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(4) for _ in range(rng.randrange(20))] + p * rng.randrange(3, 8) + p[: rng.randrange(len(p) + 1)] + [rng.randrange(4) for _ in range(rng.randrange(20))]
        texts.append(text)
        texts.append(text * rng.randrange(1, 6))
    for t in texts:
        assert periodic.runs(np.array(t, np.int64)) == slow_runs(t), t
    long = list(range(3000)) + [5, 6, 7] * 20_000 + list(range(3000)) * 5
    assert periodic.runs(np.array(long)) == [(3000, 60_000, 3), (63_000, 15_000, 3000)]
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def contract(doc_id, text):
    w = re.findall(WORD, text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, b = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % b] for i, x in enumerate(w)]
    found = slow_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    one = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *one, 1000 * one[1] // one[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_of_runs(spark, texts, tmp_path):
    rows = [(i, t) for i, t, *_ in texts]
    rows += [(1000 + k, " ".join(f"w{j % 37}" for j in range(150 + k))) for k in range(60)] + [(5, "a b a b a b a b c"), (5, "a b a b a b a b c")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periodic.op12_blocks(spark, str(tmp_path)).collect())
    assert got == sorted(contract(i, t) for i, t in rows)


def test_runs_keep_columns(spark, docs, empty):
    df = docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r")).withColumn("made", F.array(F.lit(1)))
    out = periodic.periodic_runs(df)
    assert out.columns == [*[c for c in df.columns if c != "text"], "_periodic"] and out.count() == docs.count()
    assert periodic.periodic_runs(docs.select("text")).count() == docs.count()
    assert periodic.periodic_runs(empty).count() == 0
    one = spark.createDataFrame([(None, "x " * 50 + "end")], "doc_id long, text string")
    r = periodic.periodic_runs(one).first()._periodic
    assert r.collapsed == "x end" and tuple(r.best) == (0, 50, 1) and r.n_words == 51


def slow_divergence(rows, least, top):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = [(re.findall(TERM, low(t)), lang or "", src or "") for t, lang, src in rows]
    df, n = collections.Counter(), collections.defaultdict(collections.Counter)
    for ts, lang, src in rows:
        df.update((lang, t) for t in set(ts))
        n[lang, src].update(ts)
    out = []
    for lang in {x for _, x, _ in rows}:
        kept = [t for (x, t), k in df.items() if x == lang and k >= least]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        whole = sum(groups.values(), collections.Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        p = {s: {t: share(c, t) for t in kept} for s, c in groups.items()}
        q = {t: share(whole, t) for t in kept}
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, 10**9), ("term", terms, top)):
                out += [(lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(sorted(items), 1) if k <= most]
    return sorted(out)


@pytest.mark.parametrize("width", [32, 1 << 16])
def test_divergence_equals_brute_force(spark, width):
    rng = random.Random(9)
    words = [*"abcdefgh", "Über", "数据", "naïve", "ÀB", "it's", "x-1y", "Zz"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30), weights=range(1, len(words) + 1))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "", None])) for _ in range(200)]
    rows += [(None, "en", "s9"), ("", "fr", "a"), ("12 34", "fr", "b"), (f"once{1}", "fr", "b"), *[("hot " * 50, "en", "s1")] * 60]
    rows += [(f"rare{k}", "en", "s1") for k in range(100)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n int, `a.b` string").repartition(5)
    got = divergence.divergence(Scratch(spark), df, least=10, top=4, width=width)
    assert sorted(map(tuple, got.collect())) == slow_divergence(rows, 10, 4)
    assert divergence.divergence(Scratch(spark), df.where("false"), width=width).count() == 0


def test_sketch_never_underestimates(spark):
    rows = [(f"t{k % 7} " + " ".join("x" + "y" * j for j in range(k)), "en", "s") for k in range(40)]
    df = divergence._cleaned(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))
    width = 1 << 10
    marks = divergence.possible(Scratch(spark), df, width, 5)
    count = collections.Counter(t for r in rows for t in set(divergence.terms(r[0].encode())))
    at = divergence.cells([divergence._key("en", t) for t in count], width)
    hit = ((marks[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(1)
    assert all(h for h, (t, n) in zip(hit, count.items(), strict=True) if n >= 5)
    assert sum(h for h, (t, n) in zip(hit, count.items(), strict=True) if n < 5) <= 4
