"""Queries of text ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as fn
from skein.operators import postings
from skein.operators import ranking as op
from skein.operators import search
from skein.plans.registry import Tables, query
from skein.scratch import Scratch
from skein.sources.published import Store

_TERMS = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_T = {k: _TERMS.format(c=k) for k in ("source", "lang", "text")}


_BM25F = f"""with d as (select doc_id, source, {_T["source"]} as a, {_T["lang"]} as b, {_T["text"]} as c from documents), n as (select count(*) as n, avg(len(a)) as la, avg(len(b)) as lb, avg(len(c)) as lc from d),
q as (select unnest(['src7', 'thin', 'with', 'tion', 'hand'])  as term), q2 as (select term from q where term <> 'with'),
f as (select d.doc_id, d.source, q2.term, len(list_filter(a, lambda x: x = q2.term)) as fa, len(list_filter(b, lambda x: x = q2.term)) as fb, len(list_filter(c, lambda x: x = q2.term)) as fc,
len(a) as na, len(b) as nb, len(c) as nc from d, q2), df as (select term, count(*) as df from f where fa + fb + fc > 0 group by 1),
w as (select f.doc_id, f.source, f.term, 8 * fa / (0.25 + 0.75 * na / la) + 4 * fb / (0.25 + 0.75 * nb / lb) + fc / (0.25 + 0.75 * nc / lc) as w, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from f join df using (term), n)
select doc_id, round(sum(idf * w * 2.2 / (w + 1.2)), 6) as score from w where w > 0 group by doc_id, source order by round(sum(idf * w * 2.2 / (w + 1.2)), 9) desc, source, doc_id limit 50"""


def _ranked(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("source").alias("name"), F.col("lang").alias("short"), F.col("text").alias("body"))
    out = op.bm25f(d, "doc_id", "name", ["name", "short", "body"], "src7 thin with tion hand", most=None, most_terms=None)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25F)
def bm25f(t: Tables) -> DataFrame:
    """Over all documents of all languages and their whole texts; the operator's caps of documents and terms are off."""
    return _ranked(t)


@query(_BM25F)
def bm25f_whole(t: Tables) -> DataFrame:
    """As bm25f, under the name it had when that query still kept caps."""
    return _ranked(t)


_NAME = _TERMS.format(c="p_name")


@query(
    f"""with d as (select p_partkey, p_name, {_NAME} as a from part), n as (select count(*) as n, avg(len(a)) as la from d), q as (select unnest(['blue', 'metal', 'bolt']) as term),
f as (select p_partkey, p_name, term, len(list_filter(a, lambda x: x = term)) as f, len(a) as na from d, q), df as (select term, count(*) as df from f where f > 0 group by 1),
w as (select f.*, f / (0.25 + 0.75 * na / la) as w, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from f join df using (term), n)
select p_partkey, round(sum(idf * w * 2.2 / (w + 1.2)), 6) as score from w where w > 0 group by p_partkey, p_name order by sum(idf * w * 2.2 / (w + 1.2)) desc, p_name, p_partkey limit 50"""
)
def bm25_single(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", F.col("p_name").alias("name"))
    return op.bm25f(d, "p_partkey", "name", ["name"], "blue metal bolt", weights=[1.0], most=None, most_terms=None).select("p_partkey", F.round("score", 6).alias("score"))


@query(
    f"""with q as (select distinct substr(w, i, n) as g from (select unnest(['blue', 'economy', 'widget']) as w), range(2, 6) a(n), range(1, 8) b(i) where i + n - 1 <= length(w)),
t as (select p_partkey, p_name, 8 as weight, 1 as field, unnest({_NAME}) as w from part union all select p_partkey, p_name, 4, 2, unnest({_TERMS.format(c="p_brand")}) from part
union all select p_partkey, p_name, 1, 3, unnest({_TERMS.format(c="p_type")}) from part),
h as (select distinct p_partkey, p_name, field, weight, g from t, q where contains(w, g)), s as (select p_partkey, p_name, g, sum(weight) as w from h group by 1, 2, 3),
df as (select g, count(*) as df from s group by 1), n as (select count(*) as n from part),
r as (select p_partkey, p_name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w) as score, count(*) as k from s join df using (g), n group by 1, 2)
select p_partkey, round(score, 6) as score from r where k >= 3 order by round(r.score, 9) desc, p_name, p_partkey limit 50"""
)
def char_ngram(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("short"), F.col("p_type").alias("body"))
    return op.char_ngrams(d, "p_partkey", "name", ["name", "short", "body"], "blue economy widget", most=None).select("p_partkey", F.round("score", 6).alias("score"))


def _lexical(terms: list[str], phrase: str) -> str:
    """SQL of the best 50 parts (p_partkey, p_name, score) for some terms and the whole query."""
    near = lambda c, w: f"len(list_filter({c}, lambda x: length(x) >= 4 and {len(w)} >= 4 and (starts_with(x, '{w}') or starts_with('{w}', x)))) > 0"
    each = [
        f"(case when array_to_string(a, ' ') = '{w}' then 128 when list_contains(a, '{w}') then 64 when {near('a', w)} then 24 else 0 end + case when list_contains(b, '{w}') then 16 when {near('b', w)} then 6 else 0 end"
        f" + case when list_contains(c, '{w}') then 4 when {near('c', w)} then 1 else 0 end)" for w in terms
    ]
    found = " + ".join(f"({x} > 0)::int" for x in each)
    whole = f"case when contains(' {phrase} ', ' ' || array_to_string(a, ' ') || ' ') then 256 else 0 end"
    return f"""(select * from (select p_partkey, p_name, ({whole} + {" + ".join(each)} + ({found}) * ({found}))::int as score from
(select p_partkey, p_name, {_NAME} as a, {_TERMS.format(c="p_brand")} as b, {_TERMS.format(c="p_type")} as c from part)) where score > 0 order by score desc, p_name, p_partkey limit 50)"""


@query(f"select p_partkey, score from {_lexical(['small', 'gear', 'brand', 'economy'], 'small gear brand 4 economy')}")
def weighted_lexical(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("short"), F.col("p_type").alias("body"))
    return op.weighted_lexical(d, "p_partkey", "name", "short", "body", "small gear brand 4 economy", most=None).select("p_partkey", "score")


_VIEWS = [
    (["small", "gear", "brand", "economy", "red", "bolt"], "small gear brand 4 economy and red bolt"), (["small", "gear"], "small gear"),
    (["brand", "economy"], "brand 4 economy"), (["red", "bolt"], "red bolt"),
]
_RANKED = " union all ".join(f"select p_partkey, row_number() over (order by score desc, p_name, p_partkey) as rank, {i} as view from {_lexical(*v)}" for i, v in enumerate(_VIEWS))


@query(
    f"""select p_partkey, min(rank)::int as best_rank, (min(rank) filter (where view = 0))::int as full_rank, count(*) as views, min(view)::int as first_view from ({_RANKED}) group by 1
order by best_rank, full_rank nulls last, views desc, first_view, p_partkey limit 50"""
)
def rank_fusion(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("short"), F.col("p_type").alias("body"))
    return op.rank_fusion(d, "p_partkey", "name", "short", "body", "small gear; brand 4 economy and red bolt", most=None)


@query("""with p as (select p_partkey, p_name, lower(p_name) as n from part), a as (select *, instr(n, 'r') as i1 from p), b as (select *, i1 + instr(substr(n, i1 + 1), 'd') as i2 from a where i1 > 0),
c as (select *, i2 + instr(substr(n, i2 + 1), 'g') as i3 from b where i2 > i1)
select p_partkey, (greatest(i3 - i1 + 1 - 3, 0) - case when i1 = 1 then 100 else 0 end)::int as score from c where i3 > i2 order by score, p_partkey limit 50""")
def fuzzy(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", fn.fuzzy(F.col("p_name"), "rdg").alias("m")).where("m is not null and m.score is not null")
    return d.select("p_partkey", "m.score").orderBy("score", "p_partkey").limit(50)


def _narrowed(step: int, needle: str) -> str:
    """SQL of the best 50 parts that hold the letters of a needle in order."""
    at = [f"instr(n, '{needle[0]}')"]
    for c in needle[1:]:
        at.append(f"nullif(instr(substr(n, i{len(at)} + 1), '{c}'), 0) + i{len(at)}")
    found = "(select p_partkey, p_name, lower(p_name) as n from part)"
    for k, x in enumerate(at, 1):
        found = f"(select *, {x} as i{k} from {found} where {f'i{k - 1} > 0' if k > 1 else 'true'})"
    n = len(needle)
    score = f"(greatest(i{n} - i1 + 1 - {n}, 0) - case when i1 = 1 then 100 else 0 end)::int"
    return f"(select {step} as step, p_partkey, {score} as score from {found} where i{n} > 0 order by score, p_name, p_partkey limit 50)"


#: A query as it is typed, cleared and typed anew.
_EDITS = ["r", "rD", "rdg", "", "RE", "rel"]


@query(" union all ".join(_narrowed(i, e.lower()) for i, e in enumerate(_EDITS) if e))
def fuzzy_session(t: Tables) -> DataFrame:
    session = search.FuzzySession(t.part, "p_partkey", "p_name")
    found = [session.update(e).select(F.lit(i).alias("step"), "p_partkey", "score") for i, e in enumerate(_EDITS)]
    return reduce(DataFrame.unionByName, found)


@query("""with i as (select 0 as kind, p_name as name, p_brand as term from part union all select 1, n_name, 'country' from nation),
s as (select *, lower(name) as a, lower(term) as b from i), p as (select *, instr(a, 'n') as a1, instr(b, 'n') as b1 from s),
q as (select *, a1 + instr(substr(a, a1 + 1), 't') as a2, b1 + instr(substr(b, b1 + 1), 't') as b2 from p),
r as (select kind, name, case when a1 > 0 and a2 > a1 then greatest(a2 - a1 - 1, 0) - case when a1 = 1 then 100 else 0 end end as x, case when b1 > 0 and b2 > b1 then greatest(b2 - b1 - 1, 0) - case when b1 = 1 then 100 else 0 end end as y from q)
select kind, name, min(x) is not null as named, coalesce(min(x), min(y))::int as score from r group by 1, 2 having coalesce(min(x), min(y)) is not null""")
def mixed_rank(t: Tables) -> DataFrame:
    parts = t.part.select(F.lit(0).alias("kind"), F.col("p_name").alias("name"), F.array("p_brand").alias("terms"))
    nations = t.nation.select(F.lit(1).alias("kind"), F.col("n_name").alias("name"), F.array(F.lit("country")).alias("terms"))
    return op.mixed_rank(parts.unionByName(nations), "nt")


def _porter(table: str) -> str:
    """SQL that adds Porter's stem ``w`` to a table of words (word), a step a table."""
    cut = lambda n: f"left(w, greatest(length(w) - {n}, 0))"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"

    def swap(rules: dict[str, str], measure: str, keep: dict[str, int]) -> str:
        each = sorted(rules.items(), key=lambda r: -len(r[0]))
        one = lambda x, n: f"when suffix(w, '{x}') then case when {has(cut(n), measure)} then {cut(n)} || '{rules[x]}' else w end"
        return f"case {' '.join(one(x, len(x) - keep.get(x, 0)) for x, _ in each)} else w end"

    p = postings
    doubled = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx")
    steps = [
        f"case when {has('w', '(ss|i)es$')} then {cut(2)} when {has('w', '[^s]s$')} then {cut(1)} else w end",
        f"case when suffix(w, 'eed') then case when {has(cut(3), p.OVER_0)} then {cut(1)} else w end when suffix(w, 'ed') and {has(cut(2), p.VOWEL)} then {cut(2)} || '#' "
        f"when suffix(w, 'ing') and {has(cut(3), p.VOWEL)} then {cut(3)} || '#' else w end",
        f"case when not suffix(w, '#') then w when {has('w', '(at|bl|iz)#$')} then replace(w, '#', 'e') when {has('w', f'({doubled})#$')} then {cut(2)} when {has(cut(1), p.SHORT)} then replace(w, '#', 'e') else {cut(1)} end",
        f"case when suffix(w, 'y') and {has(cut(1), p.VOWEL)} then {cut(1)} || 'i' else w end",
        swap(p.STEP2, p.OVER_0, {}), swap(p.STEP3, p.OVER_0, {}), swap(dict.fromkeys(p.STEP4, ""), p.OVER_1, {"sion": 1, "tion": 1}),
        f"case when suffix(w, 'e') and ({has(cut(1), p.OVER_1)} or ({has(cut(1), p.IS_1)} and not {has(cut(1), p.SHORT)})) then {cut(1)} else w end",
        f"case when suffix(w, 'll') and {has(cut(1), p.OVER_1)} then {cut(1)} else w end",
    ]
    out = f"select word, regexp_replace(word, '^y', 'Y') as w from {table} where regexp_full_match(word, '[a-z]{{3,}}')"
    for step in steps:
        out = f"select word, {step} as w from ({out})"
    return f"select word, lower(w) as w from ({out}) union all select word, word from {table} where not regexp_full_match(word, '[a-z]{{3,}}')"


_SEARCH = "licensed things of thee hands for src7 redistributions"


@query(
    f"""with d as (select doc_id, {_T["source"]} as a, {_T["lang"]} as b, {_T["text"]} as c from documents), n as (select count(*) as n, avg(len(a)) as la, avg(len(b)) as lb, avg(len(c)) as lc from d),
t as (select doc_id, 0 as f, unnest(a) as word from d union all select doc_id, 1, unnest(b) from d union all select doc_id, 2, unnest(c) from d),
g as (select doc_id, f, word, count(*) as k from t where word not in ({", ".join(f"'{w}'" for w in op.STOP_WORDS)}) group by 1, 2, 3), v as materialized (select distinct word from g), s as materialized ({_porter("v")}),
q0 as (select unnest({op.query_terms(_SEARCH)}) as word), q as (select distinct w from ({_porter("q0")})),
m as (select doc_id, w, sum(k) filter (where f = 0) as fa, sum(k) filter (where f = 1) as fb, sum(k) filter (where f = 2) as fc from g join s using (word) join q using (w) group by 1, 2), df as (select w, count(*) as df from m group by 1),
r as (select doc_id, 8 * coalesce(fa, 0) / (0.25 + 0.75 * len(a) / la) + 4 * coalesce(fb, 0) / (0.25 + 0.75 * len(b) / lb) + coalesce(fc, 0) / (0.25 + 0.75 * len(c) / lc) as tf, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf
from m join df using (w) join d using (doc_id), n)
select doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2)), 6) as score from r group by 1 order by round(sum(idf * tf * 2.2 / (tf + 1.2)), 9) desc, doc_id limit 50"""
)
def bm25_postings(t: Tables) -> DataFrame:
    """Documents found by stems in an index: first by their source and language alone, then each replaced by the whole document."""
    index = postings.Postings(Store(t.spark, f"{Scratch(t.spark).root}/index"), ["source", "lang", "text"])
    index.upsert(t.documents.withColumn("text", F.lit(None).cast("string")), "doc_id")
    index.upsert(t.documents, "doc_id")
    return index.bm25f(_SEARCH, [8.0, 4.0, 1.0]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
