"""What is read of Markdown, by hand: emphasis, code, links, blocks."""

import pytest

from skein.functions.markdown import markdown, read_markdown

CASES = [
    ("", ""), ("plain  text\nmore", "plain text more"), ("*a **b** c*", "a b c"), ("***a** b*", "a b"), ("**a*", "*a"), ("a * b * c", "a * b * c"),
    ("snake_case_name and _it_", "snake_case_name and it"), ("foo*bar*baz", "foobarbaz"), ("*foo**bar**baz*", "foobarbaz"), ("*foo**bar*", "foo**bar"), ("**foo*bar**", "foo*bar"),
    ("*(**foo**)*", "(foo)"), ("__init__ x", "init x"), ("a ~~b~~", "a ~~b~~"), (r"\*a\* \_b", "*a* _b"), ("`a *b*` *c*", "a *b* c"), ("`` a`b ``", "a`b"), ("`open *a*", "`open a"), ("*a `*` b*", "a * b"),
    ("[a *b*](http://x \"t\") c", "a b c"), ("![alt](x.png)", "alt"), ("[![i](a)](b) c", "i c"), ("[a](b", "[a](b"), ("[a][r] [r] [q]\n\n[r]: http://x 't'", "a r [q]"), ("*[a*](b)", "*a*"), ("[a [b](c)](d)", "[a b](d)"),
    ("<b>x</b> &amp; &lt; <http://e.org/a> 1 < 2", "<b>x</b> & < http://e.org/a 1 < 2"), ("# T #\ntext\n## U", "T text U"), ("#no", "#no"), ("Title\n=====\nx\n---\ny", "Title x y"), ("a\n\n***\n\nb", "a b"),
    ("```py\n*x* = `1`\n```\nafter *y*", "*x* = `1` after y"), ("~~~\nopen ```\n*z*", "open ``` *z*"), ("a\n\n    code *x*\n\ntext *y*", "a code *x* text y"), ("<!-- *a* --> *b* <!-- *c*", "<!-- *a* --> *b* <!-- *c*"), ("x <!-- *a* --> *b* <!-- *c*", "x <!-- *a* --> b <!-- c"), ("# a #b ##", "a #b"), ("text\n    *lazy*", "text lazy"), ("- a\n- *b*\n  - c\n\n1. d\n2) e", "a b c d e"), ("> q *r*\n> s\nlazy\n\n> > t", "q r s lazy t"),
    ("- ```\n  *x*\n  ```\n- y", "*x* y"), ("<div>\n*raw*\n\n*not*", "<div> *raw* not"), ("in 2024\n7. is no item", "in 2024 7. is no item"), ("a\\\nb", "a b"), ("*a\nb*", "a b"), ("日本*語*です **。x**", "日本語です 。x"), ("日本**。x**", "日本**。x**"), ("[" * 20 + "a" + "]" * 20, "[" * 20 + "a" + "]" * 20), ("-", ""), ("a | b\n--|--\n*c* | d", "a | b --|-- c | d"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert read_markdown(text) == want


def test_column_and_long_texts(spark):
    long = "*a **b" * 5000 + " [" * 5000 + "`" * 5001 + " <!--" * 20_000 + " #" * 10_000 + " *c*" * 20_000
    df = spark.createDataFrame([("*x*",), (None,), (long,)], "t string")
    got = [r[0] for r in df.select(markdown(df.t)).collect()]
    assert got[:2] == ["x", None] and got[2].endswith(" c" * 100)
