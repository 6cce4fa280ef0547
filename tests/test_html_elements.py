"""Nested elements, rendered text, character references, unquoted attributes."""

import time

import pytest
from pyspark.sql import functions as F

from shelfsense.functions.html import attribute, decode_entities, elements, first_inner, inner_text, intervals, opener, rendered_text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("plain", "plain"), ("&#8217;&rsquo;&#x2019;", "’’’"), ("caf&eacute; &reg;", "café ®"), ("&amp;lt; &amp;amp;", "&lt; &amp;"),
        ("&#128690;&#x1F6B2;", "🚲🚲"), ("&#146;&#128;", "’€"), ("&#0;&#xD800;&#x110000;", "���"),
        ("&bogus; & &; &#; AT&T", "&bogus; & &; &#; AT&T"), ("&#65;&#233;", "Aé"), ("a&nbsp;b", "a\xa0b"), ("&apos;&quot;", "'\""),
    ],
)
def test_references(spark, text, want):
    assert one(spark, decode_entities(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div>$5</div><div>Save 5% ($1)</div><p>Ends <b>soon</b></p>", "$5\nSave 5% ($1)\nEnds soon"),
        ("a<br>b<BR/>c", "a\nb\nc"), ("<ul><li>x</li> <li>y</li></ul>", "x\ny"), ("<div><div><div>deep</div></div></div>tail", "deep\ntail"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\nc"), ("no <i>breaks</i> here", "no breaks here"),
        ("kept\nline", "kept\nline"), ("<p> &lt;br&gt; </p>", "<br>"), ("<picture>x</picture>", "x"), ("", ""),
    ],
)
def test_rendered(spark, html, want):
    assert one(spark, rendered_text(F.col("h")), h=html) == want


def test_content_has_no_breaks_of_its_own(spark):
    assert one(spark, inner_text(F.col("h")), h="<div>a</div><div>b &eacute;</div>") == "ab é"


@pytest.mark.parametrize(
    ("tag", "want"),
    [
        ("<a href=/x>", "/x"), ("<a class=b href='/x y'>", "/x y"), ('<a title="href=/no" href="/x">', "/x"), ("<a HREF=1 href=2>", "2"),
        ("<a data-href=/no>", None), ('<a href = "/x">', "/x"), ('<a href="a&amp;b">', "a&b"), ("<a href=''>", ""),
    ],
)
def test_attributes(spark, tag, want):
    assert one(spark, attribute(F.col("t"), "href"), t=tag) == want


@pytest.mark.parametrize(
    ("html", "selector", "want"),
    [
        ("<p class=price>1</p>", ".price", "<p class=price>"), ('<p title="class=price"></p>', ".price", ""),
        ("<p class=x><i id=abc data-k=vv>", "[data-k*='v']", "<i id=abc data-k=vv>"), ("<p class='a price b'>", ".price", "<p class='a price b'>"),
        ("<p class=prices>", ".price", ""), ("<section id=bv-review-1>", "section[id^='bv-review-']", "<section id=bv-review-1>"),
    ],
)
def test_unquoted_selectors(spark, html, selector, want):
    assert one(spark, opener(F.col("h"), selector), h=html) == want


def test_nested_elements_end_where_they_should(spark):
    html = "<div class='c'>1<div class='c'>2</div><div>x</div>3</div><div class='c'>4</div>"
    want = ["1<div class='c'>2</div><div>x</div>3", "2", "4"]
    assert one(spark, elements(F.col("h"), ".c"), h=html) == want
    outer = one(spark, elements(F.col("h"), ".c", outer=True), h=html)
    assert outer[1:] == ["<div class='c'>2</div>", "<div class='c'>4</div>"] and outer[0].startswith("<div class='c'>1")
    open_end = "<div class='c'>a<div class='c'>b<span>c"
    assert one(spark, elements(F.col("h"), ".c"), h=open_end) == ["a<div class='c'>b<span>c", "b<span>c"]
    assert one(spark, elements(F.col("h"), "article"), h="<article>a<article>b</article>c</article>") == ["a<article>b</article>c", "b"]
    tag = F.lit("<div class='p'>")
    assert one(spark, first_inner(F.col("h"), tag), h="<div class='p'><div>1</div><div>2</div></div><div>3</div>") == "<div>1</div><div>2</div>"
    assert one(spark, first_inner(F.col("h"), tag), h="<DIV></DIV><div class='p'>1</DIV >2</div>") == "1"


def test_intervals_balance_any_tags(spark):
    tags = ["<ul>", "<li>", "<li>", "</ul>", "<br>", "</p>", "<p>"]
    found = spark.createDataFrame([(tags,)], "t array<string>").select(intervals(F.col("t")).alias("x")).first()["x"]
    assert [tuple(s) for s in found] == [(0, 3), (1, 3), (2, 3), (4, 4), (6, 7)]


def test_many_nested_matches(spark):
    """Twice as many elements inside each other take about twice as long, not four times."""
    def page(n):
        return "".join(f"<div class='product-card'><h3>{i}</h3>" for i in range(n)) + "</div>" * n

    def seconds(n):
        df = spark.createDataFrame([(page(n),)] * 4, "h string").select(F.size(elements(F.col("h"), ".product-card")).alias("n"))
        assert df.first()["n"] == n
        begin = time.perf_counter()
        assert [r["n"] for r in df.collect()] == [n] * 4
        return time.perf_counter() - begin

    seconds(100)
    small, large = seconds(1000), seconds(2000)
    assert large < 4 * small + 2 and large < 30


def test_elements_and_texts_are_computed_once(spark):
    """Inside lambdas nothing is shared, so what is used twice must be bound."""
    from shelfsense.functions.html import needed_words

    df = spark.createDataFrame([("<b>x</b> &amp; <p>y",)], "h string")
    for text in (inner_text, rendered_text, decode_entities):
        plan = df.select(text(F.upper("h")))._jdf.queryExecution().analyzed().toString()
        assert plan.count("upper(") - plan.count("AS upper(") <= 2, text  # once, and once in the column's name
    assert "data-testid" in needed_words("[data-testid*='product']")


def test_leaves_and_strays_leave_the_stack_as_it_was(spark):
    html = "<div class='c'><i></i><br></br></p><b>1<u></u><div class='c'></div></div><div class='c'>2"
    assert one(spark, elements(F.col("h"), ".c"), h=html) == ["<i></i><br></br></p><b>1<u></u><div class='c'></div>", "", "2"]
