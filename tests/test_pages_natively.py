"""Entities and nested elements without Python: against hand-written expectations and a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import html
from waymark.operators import elements

CASES = [
    ("it&#39;s", "it's"), ("&#x41;&#X42;&#67;", "ABC"), ("&#128512;&#x1F600;", "😀😀"), ("&#0065;&#x00000041;", "AA"), ("&#xD800;&#55296;&#1114112;&#x110000;x", "x"), ("&#99999999999999999999;y&#xffffffffffffffffff;", "y"),
    ("&#38;lt;", "<"), ("&#x26;#65;", "A"), ("&amp;#65;", "&#65;"), ("&amp;lt;", "&lt;"), ("&AMP;&Nbsp;&bogus;", "& &bogus;"), ("&#;&#x;&#a;&", "&#;&#x;&#a;&"), ("&#65 &#66;", "&#65 B"), ("caf&#233;\n&#x2019;", "café\n’"), ("", ""), (None, None), ("&#10;|", "\n|"),
]


def test_entities(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string").select("i", html.decoded(F.col("raw")).alias("v")).collect()
    assert [r.v for r in sorted(rows)] == [want for _, want in CASES]


def test_extraction_paths_decode_numbers(spark):
    page = '<h1 class="t">O&#39;Brien&#x27;s</h1><p>it&#39;s <b>&#x41;</b></p><p>&#32;</p><a href="/a?x=1&#38;y=2">x</a>'
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(html.heading(F.col("h"), "t").alias("a"), html.paragraphs(F.col("h")).alias("b"), html.hrefs(F.col("h")).alias("c"), html.stripped(F.col("h")).alias("d")).first()
    assert r.a == "O'Brien's" and r.b == ["it's A"] and r.c == ["/a?x=1&y=2"] and r.d == "O'Brien's it's A x"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "h string").select(html.stripped(F.col("h")), html.decoded(F.col("h")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


def plain(page, tag, marker=""):
    found = [m.start() for m in re.finditer(rf"<{tag}\b[^>]*{marker}[^>]*>", page or "", re.I)]
    return [(n + 1, at, html.balanced(page, at, tag)) for n, at in enumerate(found)]


@pytest.mark.parametrize("page", ["<div>a<div>b</div>c</div>d", "<div>never <div>closed</div>", "</div></div><div x>y</div>z", "<DIV>a</Div ><divider></divider><div/>", "none", "", None, "<div class='a'><div class='m'>1</div></div><div class='m'>2"])
def test_nested_elements(spark, page):
    df = spark.createDataFrame([(1, page, "x")], "id long, html string, pos string")
    for marker in ("", "class='m'"):
        got = sorted((r.n, r.start, r.element) for r in elements.balanced(df, "div", marker).collect())
        assert got == plain(page, "div", marker)


def test_random_nesting(spark):
    rng = random.Random(2)
    bits = ["<li>", "<LI class=\"m\">", "</li>", "</li >", "<link>", "text", "<b>", "\n", "é"]
    pages = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    got = sorted((r.id, r.n, r.start, r.element) for r in elements.balanced(spark.createDataFrame(pages, "id long, html string"), "li").collect())
    assert got == sorted((i, *e) for i, page in pages for e in plain(page, "li"))
