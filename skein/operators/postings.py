"""An inverted index: postings of stems, kept up to date by batches, so that a query reads its own stems alone."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import ranking
from skein.scratch import Scratch
from skein.sources.published import Store

#: Porter's suffixes (An algorithm for suffix stripping, 1980), steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A stem with a vowel; of measure over 0, of 1, over 1; that ends consonant, vowel, consonant.
VOWEL, OVER_0, IS_1, OVER_1 = f"^(?:{_C})?[aeiouy]", f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"


def _ends(rules: dict[str, str]) -> list[tuple[str, str]]:
    """The longest suffixes first."""
    return sorted(rules.items(), key=lambda r: -len(r[0]))


_RULES = [(_ends(STEP2), OVER_0), (_ends(STEP3), OVER_0), (_ends({x: {"sion": "s", "tion": "t"}.get(x, "") for x in STEP4}), OVER_1)]


def _mended(w: str) -> str:
    """What is left of a word without -ed or -ing."""
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouhlsyz":
        return w[:-1]
    return w + "e" if re.search(SHORT, w) else w


@lru_cache(maxsize=1 << 17)
def stem_word(word: str) -> str:
    """Porter's stem of a lower-case word. Words of fewer than three letters, and with others than a to z, stay."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    w = re.sub("^y", "Y", word)  # there it is a consonant
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif re.search("[^s]s$", w):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if re.search(OVER_0, w[:-3]) else w
    elif w.endswith("ed") and re.search(VOWEL, w[:-2]):
        w = _mended(w[:-2])
    elif w.endswith("ing") and re.search(VOWEL, w[:-3]):
        w = _mended(w[:-3])
    if w.endswith("y") and re.search(VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for rules, measure in _RULES:
        for suffix, put in rules:
            if w.endswith(suffix):
                before = w[: -len(suffix)] + (put if measure == OVER_1 else "")  # the t of -tion stays and counts
                if re.search(measure, before):
                    w = before if measure == OVER_1 else before + put
                break
    if w.endswith("e") and (re.search(OVER_1, w[:-1]) or (re.search(IS_1, w[:-1]) and not re.search(SHORT, w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and re.search(OVER_1, w[:-1]):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


def stem(word: Column) -> Column:
    """``stem_word`` as a column, null: null. Each task remembers the words it has met, as most rows repeat them."""
    return _stems(word)


class Postings:
    """An index of documents in the tables of a store:

    ``postings`` (part, stem, key, batch, counts and lengths by field), in a folder for each part, a hash of the stem;
    ``known`` (key, batch, lengths), one row a document and batch;
    ``dead`` (key, batch), what later batches have replaced;
    ``totals`` (documents, lengths), what each batch adds to the corpus.

    A batch only adds rows, all of it in one version; no posting is written again before ``compact``. Every stem is kept but those of
    words that never count in a query.
    """

    def __init__(self, store: Store, fields: list[str], parts: int = 64):
        self.store, self.fields, self.parts = store, fields, parts
        self.sizes = [f"_n{i}" for i in range(len(fields))]
        self.counts = [f"_f{i}" for i in range(len(fields))]

    def _part(self, stem: Column) -> Column:
        return F.pmod(F.xxhash64(stem), F.lit(self.parts)).cast("int")

    def _alive(self, df: DataFrame) -> DataFrame:
        return df.join(self.store.read("dead"), ["key", "batch"], "left_anti")

    def upsert(self, docs: DataFrame, key: str) -> int:
        """Add documents and replace those of equal keys; the version. Null fields are empty, rows with a null key are left out, and of rows
        with one key in a batch the greatest by its fields stays. An empty batch is a version as well."""
        same = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_t{i}") for i, f in enumerate(self.fields)])
        d = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(same).alias("_d"))
        words = d.select("key", *[ranking.terms(F.col(f"_d._t{i}")).alias(f"_t{i}") for i in range(len(self.fields))])
        sizes = [F.size(f"_t{i}").cast("long").alias(n) for i, n in enumerate(self.sizes)]
        batch = F.lit(self.store.manifest()["version"] + 1).cast("long").alias("batch")
        scratch = Scratch(self.store.spark)
        known = scratch.keep(words.select("key", batch, *sizes))
        of_field = lambda i: F.transform(f"_t{i}", lambda w: F.struct(w.alias("word"), F.lit(i).alias("field")))
        each = F.flatten(F.array(*map(of_field, range(len(self.fields)))))
        found = words.select("key", *sizes, F.explode(each).alias("_e")).where(~F.col("_e.word").isin(ranking.STOP_WORDS))
        # Counts by word first: few words are left to stem, and both steps stay within the documents' own partitions.
        sums = [F.count(F.when(F.col("_e.field") == i, 1)).alias(c) for i, c in enumerate(self.counts)]
        by_word = found.groupBy("key", *self.sizes, F.col("_e.word").alias("word")).agg(*sums)
        by_stem = by_word.groupBy("key", *self.sizes, stem(F.col("word")).alias("stem")).agg(*[F.sum(c).alias(c) for c in self.counts])
        # Few files a part; a part too large for a task, as with a stem that half of the documents hold, is split among several. Ranges would
        # make all of it twice, as they are drawn from a first run.
        post = by_stem.select(self._part(F.col("stem")).alias("part"), "stem", "key", batch, *self.counts, *self.sizes)
        post = post.hint("rebalance", "part").sortWithinPartitions("part", "stem", "key")
        change = known.agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in self.sizes])
        add = {"postings": post, "known": known, "totals": change}
        if self.store.manifest()["version"] == 0:
            add["dead"] = known.select("key", "batch").limit(0)
        else:
            old = self._alive(self.store.read("known")).join(known.select("key"), "key", "left_semi")
            add |= self._less(old)
            add["totals"] = change.unionByName(add["totals"])
        version = self.store.commit(add=add, partition={"postings": ["part"]})
        scratch.clear()
        return version

    def remove(self, keys: DataFrame, key: str) -> int:
        """Forget documents; keys that the index does not have are passed over. The version."""
        old = self._alive(self.store.read("known")).join(keys.select(F.col(key).alias("key")), "key", "left_semi")
        return self.store.commit(add=self._less(old))

    def _less(self, old: DataFrame) -> dict[str, DataFrame]:
        totals = old.agg((-F.count("*")).alias("docs"), *[(-F.coalesce(F.sum(n), F.lit(0))).alias(n) for n in self.sizes])
        return {"dead": old.select("key", "batch"), "totals": totals}

    def compact(self) -> int:
        """Write the index anew without what is dead; queries then read one folder a part."""
        post = self._alive(self.store.read("postings")).hint("rebalance", "part").sortWithinPartitions("part", "stem", "key")
        totals = self.store.read("totals").agg(*[F.sum(n).alias(n) for n in ("docs", *self.sizes)])
        known = self._alive(self.store.read("known"))
        return self.store.commit(replace={"postings": post, "known": known, "totals": totals, "dead": self.store.read("dead").limit(0)}, partition={"postings": ["part"]})

    def matches(self, query: str) -> DataFrame:
        """The living postings of a query's stems: (stem, key, counts, lengths). Only the folders of their parts are read."""
        spark = self.store.spark
        words = spark.createDataFrame([(w,) for w in ranking.query_terms(query)], "word string")
        rows = words.select(stem(F.col("word")).alias("stem")).select("stem", self._part(F.col("stem")).alias("part")).distinct().collect()  # the query's own
        found = self.store.read("postings").where(F.col("part").isin([r.part for r in rows]) & F.col("stem").isin([r.stem for r in rows]))
        return self._alive(found).select("stem", "key", *self.counts, *self.sizes)

    def bm25f(self, query: str, weights: list[float], k1: float = 1.2, b: float = 0.75, most: int = ranking.MOST_RESULTS) -> DataFrame:
        """The best ``most`` documents (key, score) by BM25F over stems, ties by key; no rows for a query without words that count."""
        found = self.matches(query)
        df = found.groupBy("stem").agg(F.count("*").alias("_df"))  # a row a stem of the query
        totals = self.store.read("totals").agg(*[F.sum(n).alias(f"_s{n}") for n in ("docs", *self.sizes)])
        d = found.join(F.broadcast(df), "stem").join(F.broadcast(totals))
        share = [F.coalesce(F.col(n) * F.col("_sdocs") / F.nullif(F.col(f"_s{n}"), F.lit(0)), F.lit(1.0)) for n in self.sizes]
        tf = reduce(lambda x, y: x + y, [F.col(c) * w / (F.lit(1 - b) + s * b) for c, w, s in zip(self.counts, weights, share, strict=True)])
        idf = F.log(1 + (F.col("_sdocs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        d = d.withColumn("_tf", tf).groupBy("key").agg(F.round(F.sum(idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1)), 9).alias("score"))
        return d.orderBy(F.desc("score"), "key").limit(most)
