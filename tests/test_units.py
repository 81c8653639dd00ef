"""Small cases of operators that no table query covers."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.functions import text as fn
from skein.operators import aggregates, dml, filters, graph, joins, ordered, paging, ranking, reducers, search
from skein.plans import registry
from skein.sources import files


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_monotonic_times(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([10, 10, 10, 50])], "k int, i int, b int")
    assert [r.a for r in ordered.monotonic(df, ["k"], ["i"], F.col("b"), "a").orderBy("i").collect()] == [10, 11, 12, 50]


def test_rollback_takes_turns_away(spark):
    log = [(1, i, k, n) for i, (k, n) in enumerate([("u", 0), ("a", 0), ("u", 0), ("a", 0), ("back", 1), ("u", 0), ("back", 5), ("u", 0)])]
    df = spark.createDataFrame(log, "c int, i int, k string, n int")
    left = ordered.rolled_back(df, "c", "i", F.col("k") == "u", F.when(F.col("k") == "back", F.col("n")))
    assert sorted(r.i for r in left.collect()) == [7]


def test_paging_there_and_back(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "n int")
    seen, token = [], None
    while True:
        got, token, _ = paging.page(df, "t", [("n", True)], 3, token)
        seen += [r.n for r in got]
        if token is None:
            break
    assert seen == list(range(7))
    with pytest.raises(ValueError):
        paging.page(df, "other", [("n", True)], 3, paging.cursor("t", [("n", True)], {"n": 1}, False))


def test_newest_batch_keeps_one_oversized_row(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "x" * 100)], "k int, p int, t string")
    assert [r.p for r in paging.batch_newest(df, ["k"], "p", F.octet_length("t"), 128, 10).collect()] == [1]


def test_retain_tail_only_over_the_cap(spark):
    df = spark.createDataFrame([(1, i, "x" * 10) for i in range(10)] + [(2, i, "x" * 10) for i in range(3)], "k int, p int, t string")
    kept = dml.retain_tail(df, ["k"], "p", F.octet_length("t"), 50)
    assert sorted((r.k, r.p) for r in kept.collect()) == [(1, 6), (1, 7), (1, 8), (1, 9), (2, 0), (2, 1), (2, 2)]


def test_retention_at_the_cutoff(spark):
    at = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", at), ("b", at + dt.timedelta(seconds=1)), ("c", None)], "n string, t timestamp")
    assert sorted(r.n for r in dml.retain_since(df, F.col("t"), "2024-01-02 00:00:00").collect()) == ["b", "c"]


def test_upsert_and_conditional_changes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, s int, v string")
    new = spark.createDataFrame([("a", 3, "z"), ("c", 4, "w")], "k string, s int, v string")
    assert sorted(rows(dml.upsert(old, new, ["k"], "s").select("k", "v"))) == [("a", "z"), ("b", "y"), ("c", "w")]
    log = spark.createDataFrame([("j", 1, "run"), ("j", 2, "done"), ("j", 3, "late")], "k string, s int, e string")
    ok = dml.accept_until(log, ["k"], "s", F.col("e") == "done", "ok").orderBy("s")
    assert [r.ok for r in ok.collect()] == [True, True, False]


def test_histogram_bounds_are_upper_inclusive(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 5.0, 5.1, 120000.0, 120001.0)], "v double")
    got = [r.b for r in df.select(aggregates.bucket(F.col("v"), aggregates.MS_BOUNDS).alias("b")).collect()]
    assert got == [0, 1, 2, 33, 34]


def test_whole_sums(spark):
    df = spark.createDataFrame([(x,) for x in (2.5, -1.0, float("nan"), float("inf"))], "v double")
    assert [r.w for r in df.select(aggregates.whole(F.col("v")).alias("w")).collect()] == [3, 0, 0, 0]


def test_optional_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert df.where(filters.optional(k=None)).count() == 2
    assert df.where(filters.optional(k=[])).count() == 0
    assert df.where(filters.optional(k=["a"], n=1)).count() == 1


def test_epoch_arguments(spark):
    df = spark.createDataFrame([("1700000000",), ("2023-11-14T22:13:20Z",), ("soon",)], "x string")
    assert [r.e for r in df.select(filters.epoch(F.col("x")).alias("e")).collect()] == [1700000000, 1700000000, None]


def fuzzy_by_hand(hay, needle):
    """Places and score by a loop over lower-cased characters that know where they come from."""
    if hay is None:
        return None
    low = [(c, i) for i, x in enumerate(hay) for c in x.lower()]
    want = [c for x in needle for c in x.lower()]
    here, at = [], -1
    for c in want:
        at = next((k for k in range(at + 1, len(low)) if low[k][0] == c), None)
        if at is None:
            return None
        here.append(at)
    if not here:
        return [], 2**31 - 1
    places = [low[k][1] for k in here]
    start = [i for _, i in low].index(places[0])
    return sorted(set(places)), max(here[-1] - start + 1 - len(want), 0) - (100 if start == 0 else 0)


@pytest.mark.parametrize("needle", ["hl", "is", "strasse", "", "aBa", "Σσ", "i\u0307s", "\u0307", "😀a"])
def test_fuzzy(spark, needle):
    rng = random.Random(5)
    hays = [None, "", "hello", "İstanbul", "xİİs", "straße", "ΟΔΟΣ σ", "a😀😀a", "i\u0307s", "h" * 5000 + "l"]
    hays += ["".join(rng.choice("aAbBhlİsΣσ😀i\u0307") for _ in range(rng.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(hays)), "id int, t string").select("id", fn.fuzzy(F.col("t"), needle).alias("m")).collect()
    assert {r.id: r.m and (r.m.places, r.m.score) for r in rows} == {i: fuzzy_by_hand(h, needle) for i, h in enumerate(hays)}


def test_fuzzy_session_narrows(spark):
    paths = ["alpha.txt", "ALPHA/beta.txt", "abc", "abcde", "abexy", "zzz.txt", "sub/abce", None, "", "abc"]
    names = spark.createDataFrame(list(enumerate(paths)), "id int, path string")
    session = search.FuzzySession(names, "id", "path")

    def want(query):
        got = [(m[1], p, i) for i, p in enumerate(paths) if (m := fuzzy_by_hand(p, query))]
        return [(i, p, s) for s, p, i in sorted(got)]

    tables = []
    for query in ["a", "AB", "abe", "abc", "", "alp", "alpha", "alpha"]:
        out = session.update(query)
        tables.append(out)
        assert [tuple(r)[:3] for r in out.collect()] == (want(query) if query else [])
    assert [q for q, _ in session.found] == ["", "alp", "alpha"]
    assert session.found[-1][1].count() == 2  # later queries read no more than these
    assert tables[0].count() == len(want("a"))  # results outlive later queries
    session.close()
    with pytest.raises(ValueError, match="closed"):
        session.update("a")


def test_addresses(spark):
    cases = {"%IX1.2": "DI", "%QW5": "AO", "I0.0": "DI", "PIW256": "AI", "DB1.DBX0.0": "DB", "M100": "Memory", "X1F": "DI", "D100": "Data Register", "??": "Unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.t for r in df.select("a", fn.classify_address(F.col("a"))["io_type"].alias("t")).collect()}
    assert got == cases


def test_redaction(spark):
    df = spark.createDataFrame([('api_key = "abcdefgh123" Bearer abcdefghijklmnopqrst sk-' + "a" * 24,)], "t string")
    out = df.select(fn.redact(F.col("t")).alias("t")).first().t
    assert out == 'api_key = "[REDACTED_SECRET]" Bearer [REDACTED_SECRET] [REDACTED_SECRET]'


def test_templates_and_ids(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "x")], "n int, b string")
    ids = [r.i for r in search.unique_ids(df, "b", "n", "i").orderBy("n").collect()]
    assert ids == ["x", "x-2", "x-2-2", "x-3"]
    many = [("x", "x"), ("x", "x-2"), ("x-5", "x-5"), ("y", "y"), ("x", "x-3"), ("y", "y-2"), ("x-5", "x-5-2"), ("x", "x-4"), ("x", "x-6"), ("y-2", "y-2-2"), ("z", "z"), ("z", "z-2")]
    df2 = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(many)], "n int, b string")
    assert [r.i for r in search.unique_ids(df2, "b", "n", "i").orderBy("n").collect()] == [i for _, i in many]
    assert df.select(fn.render("{b}{{{n}}}", b="b", n="n").alias("t")).first().t == "x{1}"


def test_csv_jobs(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿id,name\n1,a\n,\n2,b\n", encoding="utf-8")
    assert rows(files.read_csv_job(spark, str(p)).orderBy("row_index")) == [(0, "1", "a"), (1, "2", "b")]
    p = tmp_path / "b.csv"
    p.write_text("id,name\n1,a,b\n")
    with pytest.raises(ValueError, match="row 2"):
        files.read_csv_job(spark, str(p))
    p = tmp_path / "c.csv"
    p.write_text("id,id\n1,a\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_csv_job(spark, str(p))


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(rows(files.read_jsonl(spark, str(p), "a int"))) == [(1,), (2,)]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(p), "a int", strict=True).collect()


def test_session_files(spark, tmp_path):
    for d in ("sessions/2024", "archived_sessions"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "x.jsonl").write_text("{}")
    assert sorted(r.archived for r in files.session_files(spark, str(tmp_path)).collect()) == [False, True]


def test_graph_status_on_every_edge(spark):
    e = spark.createDataFrame([(1, 2, "open"), (2, 3, "closed"), (3, 4, "open"), (1, 5, "open")], "parent int, child int, status string")
    assert rows(graph.descendants(spark, e, 1, "open")) == [(2, 1), (5, 1)]
    assert rows(graph.descendants(spark, e, 1)) == [(2, 1), (5, 1), (3, 2), (4, 3)]


def test_simple_paths_through_a_cycle(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "caller string, callee string")
    assert sorted(tuple(r.path) for r in graph.root_paths(spark, c).collect()) == [("a", "b"), ("a", "b", "c")]


def test_range_join_finds_each_pair_once(spark):
    p = spark.createDataFrame([("k", x) for x in range(0, 300, 7)], "k string, x int")
    s = spark.createDataFrame([("k", 5, 150), ("k", 100, 120)], "k string, lo int, hi int")
    got = rows(joins.range_join(p, s, "k", "x", "lo", "hi", 16).select("x", "lo"))
    want = [(x, lo) for x in range(0, 300, 7) for lo, hi in ((5, 150), (100, 120)) if lo <= x <= hi]
    assert sorted(got) == sorted(want)


def test_merge_of_summaries(spark):
    df = spark.createDataFrame([("k", 1, 2, 5), ("k", 2, 3, 0)], "k string, s int, n int, g int")
    assert rows(aggregates.merge_summaries(df, ["k"], "s", ["n"], ["g"])) == [("k", 5, 5)]


def test_spans_out_of_order(spark):
    s = spark.createDataFrame([("t", 1, 5), ("t", 2, 9)], "turn string, id int, started int")
    e = spark.createDataFrame([("t", 1, 7)], "turn string, id int, ended int")
    end = spark.createDataFrame([("t", 20)], "turn string, turn_end int")
    got = sorted((r.id, r.ended, r.state) for r in reducers.pair_spans(s, e, ["turn", "id"], end).collect())
    assert got == [(1, 7, "closed"), (2, 20, "with_turn")]


def test_line_windows(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "x", "a b", "x"], 1)], "d int, l int, t string")
    got = sorted((r.start, r.stop) for r in ordered.windows_with_all(lines, ["d"], ["a", "b"], "l", "t", 2).collect())
    assert got == [(1, 2), (4, 4)]


def test_query_views_and_terms():
    assert ranking.query_terms("How do I use the Big-Tool tool?") == ["big", "tool"]
    assert ranking.query_views("sort rows and join tables. Then stop")[:3] == ["sort rows and join tables. Then stop", "sort rows", "join tables"]


def test_snapshot_reuses_each_item_once(spark):
    old = spark.createDataFrame([Row(k=1, s=1, c="a"), Row(k=1, s=2, c="a")])
    new = spark.createDataFrame([Row(k=1, s=10, c="a"), Row(k=1, s=11, c="a"), Row(k=1, s=12, c="a")])
    assert sorted((r.s, r.old_seq) for r in reducers.snapshot_match(old, new, "k", "s", "c").collect() if r.old_seq) == [(10, 1), (11, 2)]


def test_rankings_read_whole_tables(spark, tmp_path):
    """The best rows have keys after the first 1,000; in one text the words stand after 4,096 characters and 256 terms."""
    from skein.plans import registry

    best = 1500
    parts = [(i, "blue metal bolt small gear red" if i == best else f"plain{i} thing", "Brand#4", "ECONOMY widget") for i in range(1, 1601)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    texts = [(i, "filler " * 700 + "thin tion hand" if i == best else "other words", "de", "src1") for i in range(1, 1601)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("bm25_single", "char_ngram", "weighted_lexical", "rank_fusion", "bm25f_whole"):
        assert registry.QUERIES[name](spark, str(tmp_path)).first()[0] == best, name


def test_tables_with_and_without_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("编号,名称\n1,电机\n".encode("gb18030"))
    (tmp_path / "b.csv").write_text("\ufeff编号,名称\n1,电机\n", encoding="utf-8")
    for name in ("a.csv", "b.csv"):
        df = files.read_table(spark, str(tmp_path / name))
        assert df.columns == ["编号", "名称"] and rows(df) == [("1", "电机")]
    files.write_table(spark.createDataFrame([(1, "ü,x")], "a int, b string").coalesce(1), str(tmp_path / "out"))
    out = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert out == "\ufeffa,b\n1,\"ü,x\"\n".encode()


def test_file_stems(spark):
    def plain(id):
        if len(id) == 36:
            seed = int(id[-8:], 16)
        else:
            seed = 0
            for b in id.encode():
                seed = (seed * 31 + b) % 2**32
        out = ""
        for _ in range(4):
            out, seed = fn.BASE62[seed % 62] + out, seed // 62
        return out

    ids = ["0190b0f1-0000-7000-8000-00000123abcd", "thread ü", "ffffffff-ffff-4fff-8fff-ffffffffffff", ""]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("t", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = [r.s for r in df.select(fn.file_stem(F.col("id"), F.col("t"), F.lit("Ab c-Ü.")).alias("s")).collect()]
    assert got == [f"2024-01-02T03-04-05-{plain(i)}-ab_c" for i in ids]
    assert df.select(fn.file_stem(F.col("id"), F.col("t"), F.lit(None).cast("string"))).first()[0] == f"2024-01-02T03-04-05-{plain(ids[0])}"


def test_names_and_types_of_tags(spark):
    stems = {"A_IO_2": "A", "7x": "P_7x", "": "PROJECT", "图": "PROJECT", "Press--2": "Press", "line_plcs": "line_plcs", "x" * 50: "x" * 40}
    df = spark.createDataFrame([(k,) for k in stems], "s string")
    assert [r[0] for r in df.select(fn.project_name(F.col("s"))).collect()] == list(stems.values())
    cases = [("DI", "i0.1", "Bool"), ("AI", "%ID4", "DInt"), ("AI", "PIW2", "Int"), ("Memory", "mw3", "Word"), ("DB", "DB1.DBD2", "DWord"), ("Data Register", "D1", ""), (None, "q1.2", "Bool")]
    df = spark.createDataFrame(cases, "k string, a string, t string")
    assert [r[0] for r in df.select(fn.tag_type(F.col("k"), F.col("a"))).collect()] == [c[2] for c in cases]


def test_normalized_search_and_context(spark):
    df = spark.createDataFrame([("a", "one\nFoo-Bar baz\nthree\nfour"), ("b", "foo\nbar")], "k string, t string")
    assert rows(search.line_search(df, ["k"], "t", ["foobar"], True, normalized=True).select("k", "line")) == [("a", 2)]
    assert rows(search.line_search(df, ["k"], "t", ["foo"], True, case_sensitive=True).select("k", "line")) == [("b", 1)]
    assert rows(search.with_context(df, ["k"], "t", "FOO", 1).orderBy("k")) == [("a", 2, 1, "one\nFoo-Bar baz\nthree"), ("b", 1, 1, "foo\nbar")]
    with pytest.raises(ValueError):
        search.line_search(df, ["k"], "t", ["--"], True, normalized=True)


def test_rollback_by_windows_equals_a_stack(spark):
    import random

    rng = random.Random(3)
    log = [(k, i, rng.choice("tttxmM")) for k in range(30) for i in range(rng.randint(1, 25))]
    want = []
    for k in range(30):
        kept, starts = [], []
        for _, i, kind in [r for r in log if r[0] == k]:
            n = {"m": 1, "M": 3}.get(kind, 0)
            if n:
                kept = kept[: starts[-n] if n <= len(starts) else (starts[0] if starts else len(kept))]
                starts = starts[: max(0, len(starts) - n)]
                continue
            if kind == "t":
                starts.append(len(kept))
            kept.append((k, i, kind))
        want += kept
    df = spark.createDataFrame(log, "c int, i int, k string")
    back = F.when(F.col("k") == "m", 1).when(F.col("k") == "M", 3)
    assert rows(ordered.rolled_back(df, "c", "i", F.col("k") == "t", back).orderBy("c", "i")) == want


def test_places_after_letters_that_grow(spark):
    df = spark.createDataFrame([("İİ ab AB abab",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(fn.occurrences(F.col("t"), "aB")).collect()] == [[3, 6, 9, 11], None, []]


def test_deep_and_shared_descendants(spark):
    e = spark.createDataFrame([(i, i + 1, "open") for i in range(130)] + [(0, 50, "open"), (60, 3, "open"), (9, 0, "open")], "parent long, child long, status string")
    got = {r.child: r.depth for r in graph.descendants(spark, e, 0).collect()}
    want = {i: i if i < 50 else i - 49 for i in range(1, 131)}
    want |= {i: min(want[i], want[60] + 1 + i - 3) for i in range(3, 50)}
    assert got == want


def test_summed_halves_do_not_hang_on_the_order_of_rows(spark):
    points = [(1, 0.7), (1, 0.1), (1, 0.7), (2, 0.1), (2, 0.7), (2, 0.7), (3, float("nan")), (3, 1.0), (4, 1e300), (4, -1e300), (4, 2.0), (5, None)]
    df = spark.createDataFrame([(k, "m", v) for k, v in points], "k int, name string, v double")
    got = aggregates.summary(df, ["k"], "name", "v", {"ms": ("m", "sum"), "n": ("m", "count")})
    assert sorted(rows(got)) == [(1, 2, 3), (2, 2, 3), (3, 0, 2), (4, 2, 3), (5, 0, 1)]


def test_snippet_collapses_a_text_once(spark):
    df = spark.createDataFrame([("a \n\tbig   Thing\tmore", 1), ("none", 2), (None, 3), ("big\nthing", 4)], "t string, i int")
    out = df.select("i", fn.snippet(F.col("t"), "Big Thing").alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    assert [r.s for r in out.orderBy("i").collect()] == ["a big Thing more", None, None, "big thing"]


def test_grams_are_weighed_where_a_row_stands(spark):
    df = spark.createDataFrame([(1, "blue x", "b", "blues"), (2, "lue", None, "b lue"), (3, "b l u e", "", "")], "k int, name string, b string, c string")
    out = ranking.char_ngrams(df, "k", "name", ["name", "b", "c"], "blue", most=None)
    assert [r.k for r in out.collect()] == [1, 2]
    capped = ranking.char_ngrams(df, "k", "name", ["name", "b", "c"], "blue", most=10)
    assert rows(capped) == rows(out)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [k" not in plan and plan.count("regexp_replace") <= 12


def test_short_rows_are_dealt_out_before_markdown(spark, sf):
    from skein.plans import registry

    assert "REPARTITION_BY_NUM" in registry.QUERIES["markdown_nested"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    registry.QUERIES["markdown_text"](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_sums_in_the_order_of_points_round_as_doubles_do(spark):
    # 0.6 + 0.7 + 0.2 is 1.4999999999999998 in doubles, 0.2 + 0.7 + 0.6 is 1.5.
    points = [(1, 3, 0.2), (1, 1, 0.6), (1, 2, 0.7), (2, 2, 0.7), (2, 3, 0.6), (2, 1, 0.2), (3, 1, None), (4, 1, 2.0), (4, 2, 1e300), (4, 3, -1e300)]
    df = spark.createDataFrame([(k, at, "m", v) for k, at, v in points], "k int, at int, name string, v double").repartition(3)
    got = aggregates.summary(df, ["k"], "name", "v", {"ms": ("m", "sum"), "n": ("m", "count"), "no": ("x", "sum")}, order=["at"])
    assert sorted(rows(got)) == [(1, 1, 3, 0), (2, 2, 3, 0), (3, 0, 1, 0), (4, 0, 3, 0)]


def test_runtime_summary_rounds_as_its_sql(spark, tmp_path):
    points = [0.6, 0.7, 0.2, 0.2, 0.7, 0.6, 2.3, 4.1, 1.1]
    events = [(i, i // 3, ("click", "view")[i // 3 % 2], v) for i, v in enumerate(points)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = rows(registry.QUERIES["runtime_summary"](spark, str(tmp_path)).select("user_id", "tool_ms", "api_ms"))
    table = duckdb.connect()
    table.execute("create table events (event_id bigint, user_id bigint, event_type varchar, value double)")
    table.executemany("insert into events values (?, ?, ?, ?)", events)
    want = table.sql(f"select user_id, tool_ms, api_ms from ({registry.ORACLES['runtime_summary']})").fetchall()
    assert sorted(got) == sorted(want) and (0, 1, 0) in want
