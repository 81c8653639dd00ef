"""Limits of XML records one by one, objects and versions by hand."""

from skein.sources.xml import Limits, checked, objects, tool_versions

RECORDS = {
    "fine": ("<?xml version='1.0'?><a x='>'>t<!-- <b><b> --><c/><![CDATA[ <d> ]]></a>", None, 2, 2),
    "null": (None, "empty", None, None),
    "empty": ("", "empty", None, None),
    "size": ("<a>" + "é" * 600 + "</a>", "size", None, None),
    "dtd": ("<!doctype a><a/>", "declaration", None, None),
    "entity": ("<a><!ENTITY x 'y'></a>", "declaration", None, None),
    "nodes": ("<a>" + "<b/>" * 10 + "</a>", "nodes", 11, 2),
    "edge": ("<a>" + "<b/>" * 9 + "</a>", None, 10, 2),
    "depth": ("<a><a><a><b/></a></a></a>", "depth", 4, 4),
    "attributes": ("<a p='1' q='2' r='3'/>", "attributes", 1, 1),
    "attribute_length": ("<a p='12345678901'/>", "attribute_length", 1, 1),
    "text_length": ("<a>" + "t" * 21 + "</a>", "text_length", 1, 1),
    "name": ("<a><e/></a>", "name", 2, 2),
    "prefixed": ("<n:a xmlns:n='u'><n:b/></n:a>", None, 2, 2),
    "open": ("<a><b></a>", "malformed", 2, 2),
    "text": ("no tags", "malformed", 0, 0),
}


def test_limits(spark):
    limits = Limits(bytes=1000, nodes=10, depth=3, attributes=2, attribute_chars=10, text_chars=20, names=("a", "b", "c"))
    df = spark.createDataFrame([(k, v[0]) for k, v in RECORDS.items()], "k string, x string")
    got = {r.k: (r.rejected, r.nodes, r.max_depth) for r in checked(df, "x", limits).collect()}
    assert got == {k: v[1:] for k, v in RECORDS.items()}
    assert checked(df.limit(0), "x").collect() == []
    long = spark.createDataFrame([("<a>" + "<b>text</b>" * 30_000 + "</a>",)], "x string")
    assert checked(long, "x").first().nodes == 30_001


def test_objects(spark):
    x = """<Document><SW.Blocks.FC ID="1"><AttributeList><Name> Mix </Name><Number>7</Number><ProgrammingLanguage>SCL</ProgrammingLanguage></AttributeList></SW.Blocks.FC>
<SW.Types.PlcStruct/><SW.Blocks.FB><AttributeList><Name></Name></AttributeList></SW.Blocks.FB><Other><Name>x</Name></Other></Document>"""
    got = objects(spark.createDataFrame([(1, x), (2, "<Document/>"), (3, None)], "k int, x string"), ["k"], "x").collect()
    assert sorted(map(tuple, got)) == sorted([(1, "FUNCTION", "Mix", "7", "SCL"), (1, "FUNCTION_BLOCK", "unnamed_1", None, None), (1, "TYPE", "unnamed_3", None, None)])


def test_versions(spark):
    rows = [
        ("exact", "a.xml", '<Attribute Name="PortalVersion">V18</Attribute>'), ("text", "a.xml", "made with TIA Portal V17"), ("name", "plc_v16 V16.xml", None),
        ("none", "a.xml", "V15 and V22"), ("two", "a.xml", "V17"), ("two", "b.xml", "V19"), ("both", "V20.xml", "V20"), ("null", None, None),
    ]
    got = {r.p: (r.version, r.confidence) for r in tool_versions(spark.createDataFrame(rows, "p string, f string, x string"), "p", "f", "x").collect()}
    assert got == {
        "exact": ("V18", "high"), "text": ("V17", "low"), "name": ("V16", "low"), "none": (None, "unknown"), "two": ("V19", "low"), "both": ("V20", "medium"),
        "null": (None, "unknown"),
    }


def test_filters_stay_above_what_is_checked(spark):
    """Else a filter on what was found runs the check once more for each mention."""
    df = spark.createDataFrame([("<a><ns:b x='1'/></a>",), ("<a><c/></a>",)], "x string")
    out = checked(df, "x", Limits(names=("a", "b"))).where("rejected is null")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(x") == 1
    assert [r.x for r in out.collect()] == ["<a><ns:b x='1'/></a>"]
