import pytest

from tabsight.llm.html_text import extract_pages, html_text

CASES = {
    "implied paragraph ends": ("<p>One<p>Two <b>bold  word</b>", "One\n\nTwo bold word"),
    "divs on lines of their own": ("<div>a</div><div>b</div>c", "a\nb\nc"),
    "white space between inline tags": ("<i>a</i> <b> b </b>c<span>d</span>", "a b cd"),
    "break": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "lists": ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z", "- a\n- b\n  3. x\n  4. y\n- c\n\nz"),
    "aligned cells": ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Kiwi fruit<td>12</table>", "Name        Qty\nApple       3\nKiwi fruit  12"),
    "cell over two columns": ("<table><tr><td colspan=2>wide title<tr><td>ab<td>c</table>", "wide title\nab  c"),
    "cells without a row": ("<table><td>1<td>2</table>", "1  2"),
    "lines in a cell": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "table in a table": ("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>", "x  y  z"),
    "hidden": ("a<div hidden>b</div><p style='DISPLAY : none'>c</p><span style='visibility:hidden'>d<b style='visibility:visible'>e</b></span>", "ae"),
    "head, script, style": ("<title>t</title><script>if (a<b) '</p>'</script><style>p{}</style>x<noscript>n</noscript><template>m</template>", "x"),
    "implied end of the head": ("<head><meta charset=x><title>t</title>seen", "seen"),
    "entities": ("&lt;b&gt; &amp; &eacute;&nbsp;&#8364; &unknown;", "<b> & é € &unknown;"),
    "text that is no tag": ("1 < 2 <3 and a<", "1 < 2 <3 and a<"),
    "comments": ("a<!-- <p>x</p> -->b<!-->c-->d<!doctype html>e", "abde"),
    "unclosed comment": ("a<!-- b", "a"),
    "unclosed script": ("a<script>b<p>c", "a"),
    "preformatted": ("<pre>\n  a\n   b</pre>c", "  a\n   b\n\nc"),
    "quoted >": ("<a title='x > y' href=\"z>\">link</a>", "link"),
    "details": ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    "stray end tags": ("a</div></p></b>b</table>", "a\n\nb"),
    "definition list": ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    "end tag beyond a block": ("<b>x<div>y</b>z</div>w", "x\nyz\nw"),
    "bad numbers": ("<ol start=x><li>a</ol><table><tr><td colspan=no>b</table>", "1. a\n\nb"),
    "text straight in a table": ("<table>a<tr><td>b</table>", "a\n\nb"),
    "upper case": ("<P>A<UL><LI>b</UL>", "A\n\n- b"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_rendering(name):
    html, text = CASES[name]
    assert html_text(html) == text


def test_deep_and_long_pages():
    assert html_text("<div>" * 30000 + "deep").strip() == "deep"
    assert html_text("<ul><li>" * 300 + "x").endswith("- x")
    assert html_text("<p>word" * 20000).count("word") == 20000


def test_all_given_pages_keep_their_paragraphs(spark):
    import re
    from html import unescape
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract_pages(pages).collect():
        flat = " ".join(r.text.split())
        for p in re.findall(r"<p>([^<]*)</p>", r.html.split("</head>")[1]):
            assert " ".join(unescape(p).split()) in flat
        assert "track(" not in flat and "<" not in flat.replace("< ", "")


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "<p>a", "x"), (3, "<p>a", "x"), (3, "<p>a", "x")], "page_id long, html string, tag string")
    rows = extract_pages(df).collect()
    assert [r.text for r in rows] == ["", "", "a", "a", "a"]
    assert extract_pages(df.limit(0)).collect() == []


def test_deep_and_unmatched_tags_take_linear_time():
    import time
    from tabsight.llm.html_text import parse
    for page in ("<div>" * 100_000 + "x", "<div>" * 50_000 + "</b>" * 50_000, "<div><li>" * 40_000 + "</p>" * 40_000, "<b>" * 60_000 + "<p>" * 60_000):
        t = time.process_time()
        parse(page)
        assert time.process_time() - t < 20
