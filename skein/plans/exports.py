"""Queries over XML exports, made of the orders and their items: an order is a document, an item an object in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.registry import Tables, query
from skein.sources import xml

_LIMITS = xml.Limits(nodes=30, depth=6, attributes=3, attribute_chars=40, text_chars=60, names=("Document", "Engineering", "AttributeList", "Name", "Number", "ProgrammingLanguage", *xml.OBJECTS))
_TAGS = list(xml.OBJECTS)


def _exports(t: Tables) -> DataFrame:
    """Documents (o_orderkey, o_custkey, file, xml). An order's status and priority decide what is wrong with it, if anything is."""
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("l_linenumber") - 1) % 6 + 1)
    name = F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit("B"), "l_partkey"))
    parts = ["<", tag, ' ID="', "l_linenumber", '"><AttributeList><Name>', name, "</Name><Number>", "l_linenumber", "</Number><ProgrammingLanguage>", "l_linestatus", "</ProgrammingLanguage></AttributeList></", tag, ">\n"]
    item = F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("l_line") else x for x in parts])
    items = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("x")))).alias("i"))
    p = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    extra = (
        F.when(F.col("o_orderstatus") == "P", "<Other/>").when(p == "1", "<Number><Number><Number><Number><Number><Number/></Number></Number></Number></Number></Number>")
        .when(p == "2", "<Name>open").when(p == "3", '<Name a="1" b=\'2\' c="3>" d="4"/>').when(p == "4", F.concat(F.lit('<!-- <a> --><Name a="'), F.repeat(F.lit("x"), F.lit(41)), F.lit('"/>'))).otherwise("<![CDATA[ <no & tag> ]]>")
    )
    version = F.concat(F.lit("1"), F.month("o_orderdate") % 4 + 6)
    head = F.concat(F.when(F.day("o_orderdate") == 1, "<!DOCTYPE x>").otherwise("<?xml version='1.0'?>"), F.lit('<Document><Engineering version="V'), version, F.lit('"/>'))
    # Orders of even days have nothing wrong with them.
    body = F.when(F.day("o_orderdate") % 2 == 0, "").otherwise(extra)
    d = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select("o_orderkey", "o_custkey", F.concat(F.lit("e"), "o_orderkey", F.lit(".xml")).alias("file"), F.concat(head, F.array_join(F.col("i.x"), ""), body, F.lit("</Document>")).alias("xml"))


_RULES = """with n as (select l_orderkey, count(*) as n from lineitem group by 1), o as (select o_orderkey, o_orderdate, o_orderstatus, left(o_orderpriority, 1) as p, n, day(o_orderdate) % 2 = 1 as odd from orders join n on o_orderkey = l_orderkey),
c as (select *, 2 + 5 * n + case when not odd then 0 when o_orderstatus = 'P' then 1 when p = '1' then 6 when p in ('2', '3', '4') then 1 else 0 end as k,
case when odd and o_orderstatus <> 'P' and p = '1' then 7 else 4 end as d from o),
r as (select *, case when day(o_orderdate) = 1 then 'declaration' when k > 30 then 'nodes' when d > 6 then 'depth' when not odd then null when o_orderstatus = 'P' then 'name'
when p = '2' then 'malformed' when p = '3' then 'attributes' when p = '4' then 'attribute_length' end as rejected from c)"""


@query(f"{_RULES} select o_orderkey, rejected, case when day(o_orderdate) > 1 then k end::int as nodes, case when day(o_orderdate) > 1 then d end::int as max_depth from r")
def xml_checked(t: Tables) -> DataFrame:
    return xml.checked(_exports(t), "xml", _LIMITS).select("o_orderkey", "rejected", "nodes", "max_depth")


@query(f"""{_RULES}, i as (select l.*, row_number() over (partition by l_orderkey order by (l_linenumber - 1) % 6, l_linenumber, case when l_linenumber = 3 then '' else 'B' || l_partkey || '<' end, l_linestatus) as place from lineitem l)
select o_orderkey, ['FUNCTION_BLOCK', 'FUNCTION', 'ORGANIZATION_BLOCK', 'DATA_BLOCK', 'TYPE', 'TYPE'][(l_linenumber - 1) % 6 + 1] as kind, case when l_linenumber = 3 then 'unnamed_' || place else 'B' || l_partkey end as name,
l_linenumber::varchar as number, l_linestatus as language from r join i on l_orderkey = o_orderkey where rejected is null""")
def xml_objects(t: Tables) -> DataFrame:
    fine = xml.checked(_exports(t), "xml", _LIMITS).where("rejected is null")
    return xml.objects(fine, ["o_orderkey"], "xml")


@query("""with m as (select o_custkey, 'V1' || (month(o_orderdate) % 4 + 6) as v, count(*) * 10 as s from orders where o_orderkey in (select l_orderkey from lineitem) group by 1, 2),
r as (select *, row_number() over (partition by o_custkey order by s desc, v desc) as r, coalesce(lead(s) over (partition by o_custkey order by s desc, v desc), 0) as following from m)
select o_custkey, v as version, case when s >= 5 and s >= following + 2 then 'high' when s >= 3 and s > following then 'medium' else 'low' end as confidence from r where r = 1""")
def xml_versions(t: Tables) -> DataFrame:
    """The version for each customer's documents; each mention of one scores as an exact field, a schema and a text."""
    return xml.tool_versions(_exports(t), "o_custkey", "file", "xml")
