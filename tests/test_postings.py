"""The index of stems: Porter's own examples, and searches against a scan in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from skein.operators.postings import Postings, stem
from skein.operators.ranking import STOP_WORDS, query_terms
from skein.sources.published import Store

#: Examples of the paper, word and stem in turn.
EXAMPLES = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
FIELDS, WEIGHTS = ["title", "body"], [3.0, 1.0]


def test_stems(spark):
    pairs = [*zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True), ("is", "is"), ("été", "été"), ("a4s", "a4s"), ("", ""), ("yes", "ye"), (None, None)]
    df = spark.createDataFrame(pairs, "word string, want string")
    assert df.where(~stem(F.col("word")).eqNullSafe(F.col("want"))).collect() == []


@pytest.fixture(scope="module")
def stems(spark):
    def of(words):
        words = sorted(set(words))
        df = spark.createDataFrame([(w,) for w in words], "w string")
        return {r.w: r.s for r in df.select("w", stem(F.col("w")).alias("s")).collect()}

    return of


def scan(docs, query, stems):
    """BM25F over stems, written out."""
    split = {k: [re.findall(r"[^\W_]+", (x or "").lower()) for x in d] for k, d in docs.items()}
    of = stems([w for d in split.values() for ws in d for w in ws] + query_terms(query) + ["x"])
    held = {k: [[of[w] for w in ws if w not in STOP_WORDS] for ws in d] for k, d in split.items()}
    mean = [sum(len(d[i]) for d in split.values()) / max(len(split), 1) for i in range(len(FIELDS))]
    scores = {}
    for s in {of[w] for w in query_terms(query)}:
        having = [k for k, d in held.items() if any(s in ws for ws in d)]
        idf = math.log(1 + (len(docs) - len(having) + 0.5) / (len(having) + 0.5))
        for k in having:
            tf = sum(held[k][i].count(s) * WEIGHTS[i] / (0.25 + 0.75 * (len(split[k][i]) / mean[i] if mean[i] else 1)) for i in range(len(FIELDS)))
            scores[k] = scores.get(k, 0) + idf * tf * 2.2 / (tf + 1.2)
    return sorted(((k, round(v, 6)) for k, v in scores.items()), key=lambda r: (-r[1], r[0]))


def found(index, query):
    rows = [(r.key, round(r.score, 6)) for r in index.bm25f(query, WEIGHTS, most=1000).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def test_index_follows_its_documents(spark, tmp_path, stems):
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "id string, title string, body string")
    index = Postings(Store(spark, f"file://{tmp_path}/i"), FIELDS, parts=8)
    words = ["run", "running", "runs", "happy", "happiness", "the", "formal", "formally", "été", "node7", "hopping"]
    docs = {f"d{i}": (words[i % 11], " ".join(words[(i * j) % 11] for j in range(i % 7))) for i in range(60)} | {"none": (None, None), "long": ("x", "run " * 5000)}
    queries = ["runs happiness absent the", "formal hopping été node7"]
    index.upsert(frame(docs), "id")
    assert found(index, queries[0]) == scan(docs, queries[0], stems) and found(index, "the of") == []
    change = {"d3": ("", "nothing left"), "d4": ("running", "ran"), "new": ("hops", "run"), "none": ("happy", None)}
    index.upsert(frame(change), "id")
    docs |= change
    index.remove(spark.createDataFrame([("d5",), ("unknown",), ("d4",)], "k string"), "k")
    del docs["d5"], docs["d4"]
    index.upsert(frame({"d5": ("run", "again")}), "id")
    docs["d5"] = ("run", "again")
    before = [found(index, q) for q in queries]
    assert before == [scan(docs, q, stems) for q in queries]
    index.compact()
    assert found(index, queries[0]) == before[0]
    assert index.store.read("dead").count() == 0 and len(index.store.manifest()["tables"]["postings"]["folders"]) == 1
    index.upsert(frame(change).limit(0), "id")  # an empty batch changes nothing
    assert found(index, queries[0]) == before[0]


def test_repeats_null_keys_and_what_is_read(spark, tmp_path):
    index = Postings(Store(spark, f"file://{tmp_path}/i"), FIELDS, parts=16)
    rows = [("a", "one", "x"), ("a", "two", "x"), ("a", "two", "x"), (None, "two", "x"), ("b", None, "two")]
    index.upsert(spark.createDataFrame(rows, "id string, title string, body string"), "id")
    assert {k for k, _ in found(index, "two")} == {"a", "b"} and found(index, "one") == []
    assert index.store.read("totals").first().docs == 2
    plan = index.matches("two")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_index_of_nothing(spark, tmp_path):
    index = Postings(Store(spark, f"file://{tmp_path}/i"), FIELDS, parts=4)
    index.upsert(spark.createDataFrame([], "id string, title string, body string"), "id")
    index.upsert(spark.createDataFrame([("a", "", None)], "id string, title string, body string"), "id")
    assert found(index, "anything") == []


def test_index_is_made_in_one_run(spark, tmp_path):
    """No ranges, which make all postings twice; stems by a table of words met, not by patterns for each posting."""
    from skein.operators import postings

    seen, commit = {}, Store.commit
    store = Store(spark, f"file://{tmp_path}/i")
    store.commit = lambda add=None, **k: (seen.update(add), commit(store, add=add, **k))[1]
    Postings(store, FIELDS, parts=4).upsert(spark.createDataFrame([("a", "motoring", "motors")], "id string, title string, body string"), "id")
    plan = seen["postings"]._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "ArrowEvalPython" in plan
    assert [postings.stem_word(w) for w in EXAMPLES[::2]] == EXAMPLES[1::2]
