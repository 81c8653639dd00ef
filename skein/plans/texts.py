"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import offsets
from skein.functions import text as fn
from skein.functions.markdown import markdown
from skein.operators import search
from skein.plans.registry import Tables, query
from skein.session import small_batches
from skein.streaming.chunks import parse_chunks

_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("select doc_id, {flat} as flat from documents", flat=_FLAT)
def normalize_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.collapse(F.col("text")).alias("flat"))


@query("""select doc_id, case when pos - 48 > 1 then '... ' else '' end || substr(flat, greatest(pos - 48, 1), pos + 5 + 96 - greatest(pos - 48, 1)) ||
case when pos + 101 <= length(flat) then ' ...' else '' end as snippet from (select doc_id, flat, instr(lower(flat), 'thing') as pos from
(select doc_id, {flat} as flat from documents)) where pos > 0""", flat=_FLAT)
def snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.snippet(F.col("text"), "Thing").alias("snippet")).where("snippet is not null")


@query("""with p as (select doc_id, string_split(lower(text), 'thing') as ps from documents)
select doc_id, i - 1 as idx, list_sum(list_transform(ps[1:i], lambda x: length(x))) + 5 * (i - 1) as at from
(select doc_id, ps, unnest(range(1, len(ps))) as i from p)""")
def occurrences(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.posexplode(fn.occurrences(F.col("text"), "thing")).alias("idx", "at"))
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("at").cast("long").alias("at"))


@query("""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9]{20,}', '[REDACTED_SECRET]', 'g'),
'\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED_SECRET]', 'g'), '(?i)\\bBearer\\s+[A-Za-z0-9._\\-]{16,}\\b', 'Bearer [REDACTED_SECRET]', 'g'),
'(?i)\\b(api[_-]?key|token|secret|password)\\b(\\s*[:=]\\s*)(["'']?)[^\\s"'']{8,}', '\\1\\2\\3[REDACTED_SECRET]', 'g') as text from documents""")
def redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.redact(F.col("text")).alias("text"))


@query("""select doc_id, line, sha1('file-line-v1' || chr(0) || 'repo' || chr(0) || x) as print from (select doc_id, i - 1 as line, trim(regexp_replace(ls[i], '\\s+', ' ', 'g')) as x
from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))
where strlen(x) > 3 and regexp_matches(x, '[\\p{L}\\p{N}_]')""")
def fingerprint(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    d = d.select("doc_id", F.col("line").cast("long").alias("line"), fn.effective_line(F.col("x")).alias("x")).where("x is not null")
    return d.select("doc_id", "line", fn.fingerprint("repo", F.col("x")).alias("print"))


@query("""select doc_id, case when length(text) <= 400 then text else substr(text, 1, 200) || '…' || (length(text) - 400) || ' chars truncated…' || right(text, 200) end as text from documents""")
def truncate_mid(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.truncate_middle(F.col("text"), 400).alias("text"))


@query("select doc_id, (strlen(text) + 3) // 4 as tokens from documents")
def approx_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.approx_tokens(F.col("text")).alias("tokens"))


@query("""select conv_id, turn, case when before >= 300 then 'omitted' when before + tok > 300 then 'cut' else 'whole' end as fate, case when before >= 300 then 0 when before + tok > 300 then 300 - before else tok end as tokens
from (select *, coalesce(sum(tok) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as before from (select *, (strlen(text) + 3) // 4 as tok from conversations))""")
def budget_items(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("tok", fn.approx_tokens(F.col("text")))
    return search.within_budget(c, ["conv_id"], ["turn"], "tok", 300).select("conv_id", "turn", "fate", "tokens")


@query("select c_custkey, 'Check {' || c_name || '} in ' || c_mktsegment || ' {other}' as prompt from customer")
def template_render(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.render("Check {{{name}}} in {seg} {other}", name="c_name", seg="c_mktsegment").alias("prompt"))


@query("select c_custkey, c_mktsegment || case when n = 1 then '' else '-' || n end as item_id from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as n from customer)")
def dedupe_ids(t: Tables) -> DataFrame:
    return search.unique_ids(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", "item_id").select("c_custkey", "item_id")


@query("select o_orderkey, epoch(o_orderdate)::bigint * 1000 as ms from orders")
def epoch_norm(t: Tables) -> DataFrame:
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    mixed = F.when(F.col("o_orderkey") % 2 == 0, s).otherwise(s * 1000)
    return t.orders.where("o_orderdate > timestamp_ntz'1990-01-01 00:00:00'").select("o_orderkey", fn.epoch_millis(F.when(s * 1000 < 1577836800000, s).otherwise(mixed)).alias("ms"))


@query("select event_id, strlen(event_type) + coalesce(strlen(case when user_id % 3 = 0 then null else props end), 0) + 16 as bytes from events")
def estimated_bytes(t: Tables) -> DataFrame:
    p = F.when(F.col("user_id") % 3 != 0, F.col("props"))
    return t.events.select("event_id", (F.octet_length("event_type") + F.coalesce(F.octet_length(p), F.lit(0)) + 16).cast("long").alias("bytes"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then 'Beckhoff/CODESYS' when p_partkey % 4 = 3 then 'Mitsubishi' else 'Siemens' end as vendor,
case p_partkey % 4 when 0 then 'DI' when 1 then 'AI' when 2 then 'DB' else 'DO' end as io_type from part""")
def classify_cascade(t: Tables) -> DataFrame:
    a = F.expr("case p_partkey % 4 when 0 then concat('%ix', p_size, '.1') when 1 then concat('IW ', p_size) when 2 then concat('DB', p_size, '.DBX0.1') else concat('Y', p_size) end")
    return t.part.select("p_partkey", fn.classify_address(a).alias("c")).select("p_partkey", "c.vendor", "c.io_type")


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part")
def slugify(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.slug(F.col("p_name")).alias("slug"))


@query("""select event_id, case event_type when 'error' then 'FAULT' end as category, case event_type when 'error' then 'red' end as severity from events""")
def keyword_category(t: Tables) -> DataFrame:
    return t.events.select("event_id", fn.category(F.col("event_type")).alias("c")).select("event_id", "c.category", "c.severity")


@query("""select c_custkey, array_to_string(list_filter([case when not regexp_matches(n, '^[A-Za-z][A-Za-z0-9_]*$') then 'format' end, case when regexp_matches(n, '^_|_$|__') then 'underscores' end,
case when regexp_matches(lower(n), '^(tag|var|variable|temp|tmp|data|value|test|newtag|newvariable|unnamed|signal|flag)[0-9]*$') then 'generic' end, case when length(n) < 2 then 'short' end], lambda x: x is not null), ',') as issues
from (select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then 'tmp' || c_custkey when 2 then '_x_' else 'A' end as n from customer)""")
def quality_rules(t: Tables) -> DataFrame:
    n = F.expr("case c_custkey % 4 when 0 then c_name when 1 then concat('tmp', c_custkey) when 2 then '_x_' else 'A' end")
    return t.customer.select("c_custkey", F.array_join(fn.naming_issues(n), ",").alias("issues"))


@query("""select doc_id, case when a and o then 'mixed' when a then 'ascii_latin' when o then 'other' else 'none' end as script from
(select doc_id, regexp_matches(text, '[A-Za-z]') as a, regexp_matches(regexp_replace(text, '[A-Za-z]+', '', 'g'), '\\p{L}') as o from documents)""")
def script_tag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.script_tag(F.col("text")).alias("script"))


@query("""select l_orderkey, l_linenumber, fresh as non_cached, fresh + q as blended, case when p > 12000 then round(100.0 * (100000 - 12000 - least(greatest(p - 12000, 0), 88000)) / 88000) else 100 end::bigint as percent_left
from (select *, greatest(round(l_extendedprice)::bigint - greatest(round(l_quantity)::bigint * 100, 0), 0) as fresh, greatest(round(l_quantity)::bigint, 0) as q, round(l_extendedprice)::bigint as p from lineitem)""")
def usage_derive(t: Tables) -> DataFrame:
    total, q = F.round("l_extendedprice").cast("long"), F.round("l_quantity").cast("long")
    d = t.lineitem.select("l_orderkey", "l_linenumber", fn.usage(total, q * 100, q).alias("u"), fn.percent_left(total, 100000).alias("percent_left"))
    return d.select("l_orderkey", "l_linenumber", "u.non_cached", "u.blended", "percent_left")


@query("""select doc_id, case when strlen(text) > 300 then strlen(text) - 300 else 0 end as omitted, md5(case when strlen(text) > 300 then encode(text)[1:150] else encode(text) end) as head, md5(case when strlen(text) > 300 then encode(text)[-150:] end) as tail
from documents""")
def head_tail(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", fn.head_tail(F.col("text"), 300).alias("h"))
    return d.select("doc_id", "h.omitted", F.md5("h.head").alias("head"), F.md5("h.tail").alias("tail"))


@query("select doc_id, sha256(text) as digest, case when doc_id % 3 = 0 then 'mismatch' when doc_id % 7 = 0 then 'unlisted' else 'ok' end as verdict from documents")
def manifest_verify(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    m = d.where("doc_id % 7 <> 0 or doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("digest")).alias("listed"))
    return search.verify_manifest(d, m, "doc_id").select("doc_id", "digest", "verdict")


@query("select page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: trim(x)), '|') as parts from pages")
def extract_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(fn.citations(F.col("html"), "p"), "|").alias("parts"))


@query()
def markdown_text(t: Tables) -> DataFrame:
    small_batches(t.spark)
    return t.documents.select("doc_id", markdown(F.col("text")).alias("plain"))


@query("""select p_partkey, trim(regexp_replace(p_name || ' ' || p_brand || ' ' || p_type || ' *' || p_brand || '* ' || p_name || ' ' || p_type || ' **x**', '\\s+', ' ', 'g')) as plain from part""")
def markdown_nested(t: Tables) -> DataFrame:
    """Names and types of parts in a heading, nested emphasis, code and a link within a quoted list, and fenced code."""
    form = "# *%1$s* #\n\n> - **%2$s _%3$s_** `*%2$s*`\n>   [**%1$s**](http://x/y \"t\")\n\n```sql\n%3$s **x**\n```\n"
    # Short rows: a file of millions is one task's, so they are dealt out.
    parts = t.part.repartition(t.spark.sparkContext.defaultParallelism * 2, "p_partkey")
    return parts.select("p_partkey", markdown(F.format_string(form, "p_name", "p_brand", "p_type")).alias("plain"))


@query("""select doc_id, len(regexp_extract_all(text, '(?i)\\bthe\\b')) as n_the, len(regexp_extract_all(text, '[.!?]')) as n_stops from documents""")
def pattern_counts(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select("doc_id", n(r"(?i)\bthe\b").alias("n_the"), n("[.!?]").alias("n_stops"))


@query("""with l as (select doc_id, i as line, lower(ls[i]) as x from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))
select doc_id, line from l where contains(x, 'edstha') or contains(x, 'reenon')""")
def line_search_any(t: Tables) -> DataFrame:
    return search.line_search(t.documents, ["doc_id"], "text", ["edstha", "reenon"], every=False).select("doc_id", "line")


@query("""with l as (select doc_id, i as line, lower(ls[i]) as x from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))
select doc_id, line from l where contains(x, 'the') and contains(x, 'tion')""")
def line_search_all(t: Tables) -> DataFrame:
    return search.line_search(t.documents, ["doc_id"], "text", ["the", "tion"], every=True).select("doc_id", "line")


@query("""with c as (select * from conversations where role = 'user' or (conv_id, turn) in (select (conv_id, max(turn)) from conversations where role = 'assistant' group by conv_id)),
p as (select conv_id, turn, string_split(lower(text), 'the') as ps from c)
select conv_id, turn, i - 1 as idx, list_sum(list_transform(ps[1:i], lambda x: length(x)))::bigint + 3 * (i - 1) as at from (select *, unnest(range(1, len(ps))) as i from p) order by conv_id, turn, idx limit 101""")
def thread_occurrences(t: Tables) -> DataFrame:
    return search.thread_occurrences(t.conversations, "the", 100)


@query("""select doc_id, snippet from (select doc_id, n_chars, case when pos - 48 > 1 then '... ' else '' end || substr(flat, greatest(pos - 48, 1), pos + 5 + 96 - greatest(pos - 48, 1)) ||
case when pos + 101 <= length(flat) then ' ...' else '' end as snippet from (select doc_id, n_chars, flat, instr(lower(flat), 'thing') as pos from
(select doc_id, n_chars, {flat} as flat from documents)) where pos > 0) where n_chars < 900 or (n_chars = 900 and doc_id < 0) order by n_chars desc, doc_id desc limit 21""", flat=_FLAT)
def search_threads(t: Tables) -> DataFrame:
    return search.search_threads(t.documents, "thing", (900, 0), 20).select("doc_id", "snippet")


_LINES = "(select doc_id, i as line, ls[i] as x from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))"


@query("select doc_id, line from {l} where contains(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g'), 'thedst')", l=_LINES)
def line_search_normalized(t: Tables) -> DataFrame:
    return search.line_search(t.documents, ["doc_id"], "text", ["The, D-st"], every=True, normalized=True).select("doc_id", "line")


@query("""select doc_id, i as line, greatest(i - 2, 1) as first, array_to_string(ls[greatest(i - 2, 1):i + 2], chr(10)) as content from
(select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)) where contains(lower(ls[i]), 'edstha')""")
def context_lines(t: Tables) -> DataFrame:
    return search.with_context(t.documents, ["doc_id"], "text", "edstha", 2)


@query("""with s as (select c_custkey, c_mktsegment, '00000000-0000-4000-8000-' || lpad(c_custkey::varchar, 12, '0') as u, ('0x' || right(lpad(c_custkey::varchar, 12, '0'), 8))::bigint as h, lower(c_mktsegment) as m from customer),
d as (select '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' as z)
select c_custkey, '2024-05-06T07-08-09-' || z[h // 238328 % 62 + 1] || z[h // 3844 % 62 + 1] || z[h // 62 % 62 + 1] || z[h % 62 + 1] || '-' || regexp_replace(m, '[^a-z0-9]', '_', 'g') as stem from s, d""")
def file_stems(t: Tables) -> DataFrame:
    id = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    at = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    return t.customer.select("c_custkey", fn.file_stem(id, at, F.col("c_mktsegment")).alias("stem"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'Line7_Press' when 1 then 'P_12_A' when 2 then 'PROJECT' else 'Brand_' || regexp_extract(p_brand, '[0-9]+') end || '_' || case p_partkey % 3 when 0 then 'I' || p_size || '_1' when 1 then 'QW' || p_size else 'DB' || p_size || '_DBD4' end as name,
'%' || case p_partkey % 3 when 0 then 'I' || p_size || '.1' when 1 then 'QW' || p_size else 'DB' || p_size || '.DBD4' end as address, case p_partkey % 3 when 0 then 'Bool' when 1 then 'Int' else 'DWord' end as type from part""")
def tag_inference(t: Tables) -> DataFrame:
    stem = F.expr("case p_partkey % 4 when 0 then 'Line7-Press_PLC_v2' when 1 then '12-A 图纸' when 2 then '##' else concat('Brand-', regexp_extract(p_brand, '[0-9]+', 0), '_io') end")
    address = F.expr("case p_partkey % 3 when 0 then concat('i ', p_size, '.1') when 1 then concat('QW', p_size) else concat('db', p_size, '.dbd4') end")
    kind = F.expr("case p_partkey % 3 when 0 then 'DI' when 1 then 'AO' else 'DB' end")
    logical = fn.logical_address(address)
    return t.part.select("p_partkey", fn.tag_name(fn.project_name(stem), logical).alias("name"), logical.alias("address"), fn.tag_type(kind, address).alias("type"))


@query("""select c_custkey, array_to_string(list_filter(['c' || (c_custkey % 5), 'c' || (c_custkey % 7)], lambda x: x in ('c1', 'c2', 'c3')), ',') as ids from customer where c_custkey % 5 <> c_custkey % 7
union all select c_custkey, case when c_custkey % 5 in (1, 2, 3) then 'c' || (c_custkey % 5) else '' end from customer where c_custkey % 5 = c_custkey % 7""")
def eligible_ids(t: Tables) -> DataFrame:
    listed = t.customer.select("c_custkey", F.array(F.concat(F.lit("c"), F.col("c_custkey") % 5), F.concat(F.lit("c"), F.col("c_custkey") % 7)).alias("ids"))
    some = t.spark.createDataFrame([("c1",), ("c2",), ("c3",)], "ids string")
    return search.eligible_ids(listed, ["c_custkey"], "ids", some).select("c_custkey", F.array_join("ids", ",").alias("ids"))


@query(r"""with h as (select doc_id, text, hex(encode(text)) as x, strlen(text) as n from documents),
c as (select *, list_filter(range(250, 246, -1), lambda c: substr(x, 2 * c + 1, 2) not between '80' and 'BF')[1] as a,
  list_filter(range(n - 251, n - 247), lambda c: substr(x, 2 * c + 1, 2) not between '80' and 'BF')[1] as b from h),
p as (select *, decode(unhex(substr(x, 1, 2 * a))) as head, decode(unhex(substr(x, 2 * b + 1))) as tail from c where n > 501)
select doc_id, text from h where n <= 501
union all select doc_id, head || '…' || (length(text) - length(head) - length(tail)) || ' chars truncated…' || tail from p""")
def truncate_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", offsets.truncate_bytes(F.col("text"), 501).alias("text"))


@query(r"""with h as (select doc_id, text, hex(encode(text)) as x, strlen(text) as n from documents),
c as (select *, list_filter(range(402, 398, -1), lambda c: substr(x, 2 * c + 1, 2) not between '80' and 'BF')[1] as a,
  list_filter(range(n - 402, n - 398), lambda c: substr(x, 2 * c + 1, 2) not between '80' and 'BF')[1] as b from h)
select doc_id, case when n <= 804 then text else decode(unhex(substr(x, 1, 2 * a))) || '…' || (n - 804 + 3) // 4 || ' tokens truncated…' || decode(unhex(substr(x, 2 * b + 1))) end as text from c""")
def truncate_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", offsets.truncate_tokens(F.col("text"), 201).alias("text"))


@query(r"""with p as (select doc_id, text, string_split(lower(text), 'en') as ps from documents),
m as (select doc_id, text, i - 1 as idx, list_sum(list_transform(ps[1:i], lambda x: length(x)))::bigint + 2 * (i - 1) as pos from (select *, unnest(range(1, len(ps))) as i from p)),
u as (select doc_id, idx, pos, substr(text, 1, pos) as a, substr(text, 1, pos + 2) as b from m)
select doc_id, idx, pos as start_char, pos + 2 as end_char, strlen(a) as start_byte, strlen(b) as end_byte, length(a) + len(regexp_extract_all(a, '[\x{10000}-\x{10FFFF}]')) as start_utf16,
length(b) + len(regexp_extract_all(b, '[\x{10000}-\x{10FFFF}]')) as end_utf16 from u""")
def occurrence_ranges(t: Tables) -> DataFrame:
    """Places of a literal in all documents, of all languages."""
    d = t.documents.select("doc_id", F.posexplode(offsets.match_ranges(F.col("text"), "en")).alias("idx", "r"))
    names = {"start": "start_char", "end": "end_char"} | {k: k for k in ("start_byte", "end_byte", "start_utf16", "end_utf16")}
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), *[F.col("r")[k].cast("long").alias(v) for k, v in names.items()])


@query(r"""select page_id, md5(regexp_replace(html, '(?s)<p>(.*?)(</p>|\z)', '', 'g')) as shown, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)(?:</p>|\z)', 1), '|') as parts from pages""")
def chunked_tags(t: Tables) -> DataFrame:
    """Pages as chunks of bytes, parsed chunk by chunk: what is shown, and what the hidden tags hold."""
    raw = F.encode("html", "UTF-8")
    starts = F.sequence(F.lit(0), F.greatest((F.octet_length("html") - 1) / 701, F.lit(0)).cast("int"))
    chunks = t.pages.select("page_id", F.posexplode(F.transform(starts, lambda i: F.substr(raw, i * 701 + 1, F.lit(701)))).alias("n", "chunk"))
    out = parse_chunks(chunks, "page_id", "n", "chunk", {"p": ("<p>", "</p>")})
    rows = F.array_sort(F.collect_list(F.struct("n", "visible", "extracted")))  # chunks of one page
    page = out.groupBy("page_id").agg(rows.alias("r"))
    held = F.flatten(F.transform("r", lambda x: F.transform(x["extracted"], lambda y: y["content"])))
    return page.select("page_id", F.md5(F.array_join(F.transform("r", lambda x: x["visible"]), "")).alias("shown"), F.array_join(held, "|").alias("parts"))
