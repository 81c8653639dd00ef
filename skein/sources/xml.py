"""XML exports of engineering tools: records checked against limits before they are parsed, objects, versions of the tool."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that are objects and what they are.
OBJECTS = {
    "SW.Blocks.FB": "FUNCTION_BLOCK", "SW.Blocks.FC": "FUNCTION", "SW.Blocks.OB": "ORGANIZATION_BLOCK", "SW.Blocks.DB": "DATA_BLOCK",
    "SW.Types.PlcStruct": "TYPE", "SW.Types.PlcEnum": "TYPE",
}
#: The versions known, and what scores a mention of one beyond the score of where it stands.
VERSION = "(1[6-9]|2[0-1])"
EXACT = [
    rf"""(?i)(?:PortalVersion|EngineeringVersion|TIA(?:Portal)?Version|Version)\s*[=:>"' ]+V?{VERSION}\b""",
    rf"""(?i)<Attribute[^>]+Name=["'](?:PortalVersion|EngineeringVersion|TIA(?:Portal)?Version)["'][^>]*>\s*V?{VERSION}\b""",
]
SCHEMA = rf"""(?i)(?:schema|namespace|xmlns|version)[^\r\n]{{0,120}}?(?:V|/){VERSION}(?:\b|/)"""
GENERAL = rf"(?i)\b(?:TIA\s*Portal\s*)?V{VERSION}\b"

#: Comments, CDATA, instructions, declarations and tags (a quoted value may hold a greater-than sign), and the text between them.
TOKEN = r"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>|[^<]+"""
ATTRIBUTE = r"""[^\s=<>/"']+\s*=\s*("[^"]*+"|'[^']*+')"""


@dataclass(frozen=True)
class Limits:
    """What a record may hold; ``names``: the local names of elements that it may hold, all if None. Lengths are those of the
    text as written, entities not resolved."""

    bytes: int = 500 * 1024 * 1024
    nodes: int = 2_000_000
    depth: int = 128
    attributes: int = 128
    text_chars: int = 50_000_000
    attribute_chars: int = 1_000_000
    names: tuple[str, ...] | None = None


def _once(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def checked(records: DataFrame, xml: str, limits: Limits = Limits()) -> DataFrame:
    """Adds ``nodes`` and ``max_depth`` of a record's elements, and ``rejected``: the first that holds of empty, size, declaration (a DTD
    or entities), nodes, depth, attributes, attribute_length, text_length, name, malformed; else null.

    One pass over the tags in each row; a record over the size, or with declarations, is not looked into (nulls), and only what passes all limits is
    parsed by Spark. Null is empty. All of it is one expression made by a generator, below which no filter on its results is pushed.
    """
    size, x = F.octet_length(xml), F.col(xml)
    outer = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > limits.bytes, "size").when(F.rlike(x, F.lit("(?i)<!(?:doctype|entity)")), "declaration")
    begins = lambda t: F.startswith(t, F.lit("<")) & ~F.substr(t, F.lit(2), F.lit(1)).isin("/", "!", "?")
    step = lambda t: F.when(begins(t), 1).when(F.startswith(t, F.lit("</")), -1).otherwise(0)

    def nest(s: Column, t: Column) -> Column:
        return _once(s["now"] + step(t), lambda now: F.struct(
            (now - F.when(F.endswith(t, F.lit("/>")) & begins(t), 1).otherwise(0)).alias("now"), F.greatest(s["most"], now).alias("most"),
        ))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    values = lambda t: F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1))
    named = lambda t: F.contains(t, F.lit("="))  # noqa: E731  others have no attributes

    def judged(r: Column) -> Column:
        inner = (
            F.when(r["nodes"] > limits.nodes, "nodes").when(r["max_depth"] > limits.depth, "depth")
            .when(F.exists(r["starts"], lambda t: named(t) & (F.size(values(t)) > limits.attributes)), "attributes")
            .when(F.exists(r["starts"], lambda t: named(t) & (F.length(t) > limits.attribute_chars) & F.exists(values(t), lambda v: F.length(v) - 2 > limits.attribute_chars)), "attribute_length")
            .when(F.exists(r["tokens"], lambda t: ~F.startswith(t, F.lit("<")) & (F.length(t) > limits.text_chars)), "text_length")
        )
        if limits.names is not None:
            names = "|".join(re.escape(n) for n in limits.names if ":" not in n) or "(?!)"
            inner = inner.when(F.exists(r["starts"], lambda t: ~F.rlike(t, F.lit(rf"^<(?:[^\s/>]*:)?(?:{names})(?=[\s/>])"))), "name")
        parsed = F.from_xml(x, F.lit("_bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        malformed = F.when((r["nodes"] == 0) | parsed["_bad"].isNotNull(), "malformed")
        return F.struct(r["nodes"].alias("nodes"), r["max_depth"].alias("max_depth"), F.coalesce(inner, malformed).alias("rejected"))

    def counted(tokens: Column) -> Column:
        return _once(F.filter(tokens, begins), lambda starts: _once(F.struct(
            tokens.alias("tokens"), starts.alias("starts"), F.size(starts).alias("nodes"), F.aggregate(tokens, zero, nest)["most"].alias("max_depth"),
        ), judged))

    unread = lambda o: F.struct(F.lit(None).cast("int").alias("nodes"), F.lit(None).cast("int").alias("max_depth"), o.alias("rejected"))
    read = _once(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), counted)
    return records.select("*", F.inline(F.array(_once(outer, lambda o: F.when(o.isNotNull(), unread(o)).otherwise(read)))))


def objects(records: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """The objects of records that ``checked`` let pass: keys, kind, name, number and language. Objects stand right below the root; one
    without a name is unnamed_1 by its place among the record's objects, which are ordered by kind as ``OBJECTS`` and then as they stand."""
    one = "array<struct<AttributeList: struct<Name: string, Number: string, ProgrammingLanguage: string>>>"
    ddl = ", ".join(f"`{tag}` {one}" for tag in OBJECTS)
    d = records.select(*keys, F.from_xml(F.col(xml), F.lit(ddl)).alias("_x"))
    of_kind = lambda tag: F.transform(F.coalesce(F.col(f"_x.`{tag}`"), F.array().cast(one)), lambda o: F.struct(F.lit(OBJECTS[tag]).alias("kind"), o["AttributeList"].alias("a")))
    d = d.select(*keys, F.posexplode(F.concat(*map(of_kind, OBJECTS))).alias("_p", "_o"))
    text = lambda f: F.nullif(F.trim(F.col(f"_o.a.{f}")), F.lit(""))
    name = F.coalesce(text("Name"), F.concat(F.lit("unnamed_"), F.col("_p") + 1))
    return d.select(*keys, "_o.kind", name.alias("name"), text("Number").alias("number"), text("ProgrammingLanguage").alias("language"))


def tool_versions(files: DataFrame, project: str, name: str, text: str) -> DataFrame:
    """The version of the tool that wrote each project's files, by what names and texts (their first 500,000 characters) mention: version and
    confidence (high, medium, low; unknown: no mention, null version). Scores are summed by version before anything is shuffled."""
    mentions = []
    for column, base in ((F.col(name), 1), (F.substr(F.col(text), F.lit(1), F.lit(500_000)), 2)):
        for patterns, more in ((EXACT, 3), ([SCHEMA], 1), ([GENERAL], 0)):
            for p in patterns:
                found = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(p), F.lit(1))
                mentions.append(F.transform(found, lambda v: F.struct(v.alias("v"), F.lit(base + more).alias("s"))))  # noqa: B023
    d = files.select(project, F.explode_outer(F.concat(*mentions)).alias("_m")).groupBy(project, F.col("_m.v").alias("v")).agg(F.sum("_m.s").alias("s"))
    w = Window.partitionBy(project).orderBy(F.desc_nulls_last("s"), F.desc("v"))  # seven rows a project at most
    d = d.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("s").over(w), F.lit(0))).where("_r = 1")
    sure = F.when(F.col("v").isNull(), "unknown").when((F.col("s") >= 5) & (F.col("s") >= F.col("_next") + 2), "high").when((F.col("s") >= 3) & (F.col("s") > F.col("_next")), "medium")
    return d.select(project, F.concat(F.lit("V"), "v").alias("version"), sure.otherwise("low").alias("confidence"))
