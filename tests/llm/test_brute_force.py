"""License scans and toxicity scores of the tables against plain Python that shares no code with the operators."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import phrases

from skein.llm import licenses, toxicity
from skein.llm.common import Scratch

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def scanned(text, regexes):
    """The row of one text: every rule is tried on every text, and each detection is held against every other."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = {label: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for label, p in PHRASES.items()}
    line, begins, at = " " + " ".join(ws) + " ", {}, 1
    for i, w in enumerate(ws):
        begins[at] = i
        at += len(w) + 1
    found = []
    for priority, (regex, label) in enumerate(regexes):
        for m in regex.finditer(line):
            start = begins[m.start()]
            found.append((start, start + m.group().count(" ") + 1, priority, label))

    def within(d, e):
        inside = e[0] <= d[0] and d[1] <= e[1]
        return inside and (e[:2] != d[:2] or e[2] < d[2])

    stay = {d[3] for d in found if not any(within(d, e) for e in found)}
    named = {label for label, starts in base.items() if starts}
    labels = named | stay
    score = 1.0 if named else 0.9 if labels - licenses.WEAK else 0.5 if labels else 0.0
    starts = sorted(x for v in base.values() for x in v)
    return len(ws), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(named)), ",".join(sorted(labels)), score


def test_licenses_of_the_tables_and_of_mixed_phrases(spark, sf):
    seen, regexes = set(), []
    for priority, _, regex, label in licenses.rule_rows():
        if priority not in seen:
            seen.add(priority)
            regexes.append((re.compile(f"(?<= )(?:{regex})(?= )"), label))
    rng = np.random.default_rng(21)
    known = [p for _, _, regex, _ in licenses.rule_rows() for p in phrases(regex)] + list(PHRASES.values()) * 20
    gaps = [" ", "-", ", ", "\n", " (", "_", " the ", " é ", "  ", ""]
    mixed = []
    for k in range(400):
        parts = [str(rng.choice(known)) for _ in range(int(rng.integers(1, 7)))]
        parts = [p.upper() if rng.random() < 0.2 else p.title() if rng.random() < 0.2 else p for p in parts]
        text = "".join(p + str(rng.choice(gaps)) for p in parts)
        mixed.append(text[int(rng.integers(0, 4)) :] if k % 5 == 0 else text)
    mixed += [None, "", " ", "-_-", "İ gpl 3", " ".join(mixed[:300]) * 3, mixed[0], mixed[0]]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + mixed
    clash = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, norm int, `a.b` int, label int")
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(Scratch(spark), clash).collect()}
    want = {i: scanned(t, regexes) for i, t in enumerate(texts)}
    assert not [(texts[i], got[i], w) for i, w in want.items() if got[i] != w][:3]
    assert sum(w[5] != w[4] for w in want.values()) > 200 and sum(w[1] > 1 for w in want.values()) > 10


def scored(text, value, bits, bias, width=6):
    """A text's score, one n-gram at a time."""
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    sums = []
    for word in re.split(rb"[\x20\x09-\x0D]+", raw):
        marked = b"<" + word + b">"
        each = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] if word else []
        if word:
            keys = {n: 0x9E3779B97F4A7C15 + 2 * n * 0x51ED27 for n in (3, 4, 5)}
            at = [((int.from_bytes(g, "little") + 1) * keys[len(g)] % 2**64) >> (64 - bits) for g in each]
            sums.append((sum(float(value[k]) for k in at), len(at)))
    logits = [bias] if not sums else []
    low = 0
    while low < len(sums):
        part = sums[low : low + width]
        logits.append(sum(x for x, _ in part) / max(sum(n for _, n in part), 1) + bias)
        if low + width >= len(sums):
            break
        low += width // 2
    return 1 / (1 + math.exp(-min(max(max(logits), -60), 60)))


def test_toxicity_scores_of_the_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "a"), (-5, "É ß 你好 " * 9), (-6, "x" * 20000), (-7, "one two three four five six"), (-7, "another text of the same id")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    model = toxicity.fit(spark, docs, labels)
    got = sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect())
    want = sorted((r.doc_id, scored(r.text, model.value, model.bits, model.bias)) for r in docs.collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 1e-4


def test_toxicity_fit_reads_one_text_of_an_id(spark):
    """However often a labelled id repeats, one row of it reaches the driver; others of it do not change the model."""
    words = ["calm", "river", "stone", "cloud", "green", "house"]
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(8)) + (" zugak" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    more = docs.union(docs).union(docs.where("doc_id = 0").select("doc_id", F.concat("text", F.lit(" zzz")))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k")
    one, many = toxicity.fit(spark, docs, labels), toxicity.fit(spark, more, labels)
    assert one.bias == many.bias and np.array_equal(one.value, many.value)


def test_toxicity_of_held_out_rows(spark, sf):
    """What README tells of the table sf0.01: held-out precision and recall, and that learning never reads a held-out label."""
    where = os.path.join(os.path.dirname(sf), "sf0.01")
    if not os.path.isdir(where):
        pytest.skip("no table of this size")
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r.predicted for r in toxicity.op9_subword(spark, where).where("held_out").collect()}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in out)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in out}
    hit = sum(out[i] and t for i, t in toxic.items())
    said, true = sum(out[i] for i in toxic), sum(toxic.values())
    print(f"precision {hit}/{said}, recall {hit}/{true}")
    assert hit >= 0.6 * true and hit >= 0.35 * said
    held = F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(spark, docs, labels).value, toxicity.fit(spark, docs, turned).value)
