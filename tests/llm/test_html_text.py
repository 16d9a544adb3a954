"""HTML rendering: visible words against the standard library's parser, layout, repairs, defined cases."""

import re
from html.parser import HTMLParser

import pytest

from roadtrace.llm import html_text, queries
from roadtrace.llm.html_text import render

PAGES = "page_id long, url string, html string"


class Visible(HTMLParser):
    """Text outside head, title, script and style, with a space at every block's tag."""

    INLINE = {"a", "b", "i", "span", "em", "strong"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("title", "script", "style")
        if tag not in self.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("title", "script", "style")
        if tag not in self.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_query_holds_every_visible_word(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op5_html_text"](spark, sf).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        parser = Visible()
        parser.feed(page)
        parser.close()
        text = re.sub(r"(?m)^( *)- ", r"\1", got[i].text)
        assert re.split(r"[ \t\n\f\r]+", text.strip()) == re.split(r"[ \t\n\f\r]+", "".join(parser.out).strip())
        assert got[i].n_chars == len(got[i].text)


@pytest.mark.parametrize("page, want", [
    ("<h1>T</h1>x<p>a<p>b<br>c</p>d", "T\n\nx\n\na\n\nb\nc\n\nd"),
    ("<ul><li>one<li>two <b>b</b><ol start=3><li>x<li>y</ol><li>z</ul>", "- one\n- two b\n  3. x\n  4. y\n- z"),
    ("<table><tr><th>Name<th>N<tr><td>abc<td>1<br>22<tr><td colspan=2>w<tr><td rowspan=2>r<td>q<tr><td>é</table>",
     "Name  N\nabc   1\n      22\nw\nr     q\n      é"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
    ("<table>foster<td>a</table>", "foster\n\na"),
    ("a<pre>\n  x\n\n    y</pre>b", "a\n\n  x\n\n    y\n\nb"),
    ("<div>a<div>b</div></div>c &amp; d&nbsp;e &lt;p&gt;", "a\nb\nc & d e <p>"),
    ("<p style='display: none'>n<p hidden>n<p>y<details><summary>s</summary>n</details><dialog>n</dialog>", "y\n\ns"),
    ("<p style='visibility:hidden'>n<span style='visibility:visible'>y</span>", "y"),
    ("<head><title>n</title><p>shown", "shown"),
    ("<script>var a='</p><p>n'</script>y<style>n</style><!-- n -->z<noscript>n</noscript>", "yz"),
    ("x <!-- never closed <p>n", "x"), ("a < b <3 </ c <x", "a < b <3"), ("x<a href=\"unclosed>y</a>z", "xyz"),
    ("<dl><dt>T<dd>D<dt>U</dl>", "T\n  D\nU"), ("</p>a</br>b</div>", "a\nb"), ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<textarea><b>raw</b></textarea><input type=hidden value=n>", "<b>raw</b>"), ("", ""), (None, ""), ("   \n", ""),
])
def test_layout(page, want):
    assert render(page) == want


@pytest.mark.parametrize("style, shown", [
    ("backface-visibility:hidden", True), ("-webkit-backface-visibility: hidden; color: red", True),
    ("content-visibility:auto", True), ("content-visibility:hidden-x;--visibility:hidden", True),
    ("visibility:inherit", True), ("visibility: unset", True), ("visibility:initial", True), ("VISIBILITY : Visible", True),
    ("visibility:hidden;visibility:visible", True), ("visibility:visible;visibility:hidden", False),
    ("visibility:hidden;visibility:nonsense", False), ("visibility:collapse", False), ("color:red; Visibility : HIDDEN ;", False),
    ("visibility:hidden!important;visibility:visible", False), ("visibility:visible ! important;visibility:hidden", True),
    ("/* visibility:hidden; */color:red", True), ("background:url(a;visibility:hidden;b)", True),
    ("content:'; visibility:hidden'", True), ("visibility:hidden;backface-visibility:visible", False),
])
def test_visibility_of_styles(style, shown):
    assert render(f'<p style="{style}">text</p>') == ("text" if shown else "")


@pytest.mark.parametrize("style, shown", [
    ("display:none", False), ("--x-display:none", True), ("/* display:none */color:red", True), ("content:'display:none'", True),
    ("display:none;display:block", True), ("display:block;display:none", False), ("display:none;display:nonsense", False),
    ("display:none!important;display:block", False), ("DISPLAY : None ;", False), ("display:inline flex", True),
    ("display:none block", True), ("display:none;display:", False), ("display:none;display:var(--d)", True),
    ("background:url(a;display:none;b)", True), ("display:inherit", True), ("display: /* x */ none", False),
])
def test_display_of_styles(style, shown):
    assert render(f'<p style="{style}">text</p>') == ("text" if shown else "")
    assert render(f'<svg><text display="none" style="{style}">text</text></svg>') == (
        "text" if shown and html_text._displayed(style) else "")


def test_wide_tables_are_not_blown_up():
    for n in (20, 200, 2000):
        page = "<table><tr><td>" + "wide " * 4 * n + "<td>x" + "<tr><td>a<td>b" * n + "</table>"
        got = render(page)
        assert len(got) < 10 * len(page) and got.split() == ["wide"] * 4 * n + ["x"] + ["a", "b"] * n
    assert render("<table><tr><td>" + "w" * 9000 + "<td>p<br>q<tr><td>a<td>b" + "<tr><td>c<td>d" * 40 + "</table>").split("\n")[:4] == [
        "w" * 9000, "p", "q", "a  b"]


def test_a_row_looks_the_same_in_tables_of_any_length():
    wide, tall = "w" * 150, "<tr><td>r<td>s<br>t"
    for n in (1, 3, 400):
        got = render(f"<table><tr><td>{wide}<td>x{tall * n}</table>").split("\n")
        assert got == [wide + "  x"] + ["r" + " " * 151 + "s", " " * 152 + "t"] * n
        # a cell of running text is in no column, whatever stands below it
        got = render(f"<table><tr><td>{wide * 3}<td>x<tr><td>ab<td>c{tall * n}</table>").split("\n")
        assert got == [wide * 3 + "  x", "ab  c"] + ["r   s", "    t"] * n
    # rows that only reach far to the right don't multiply the page
    page = "<table><tr>" + "<td rowspan=900>" + "<td rowspan=900>".join(["word"] * 900) + "<tr><td>a" * 800 + "</table>"
    assert len(render(page)) < 10 * len(page) and render(page).split() == ["word"] * 900 + ["a"] * 800


def test_a_long_line_takes_time_in_proportion():
    import time
    begun = time.perf_counter()
    assert len(render("<b>word</b> " * 400_000).split()) == 400_000
    assert time.perf_counter() - begun < 20


@pytest.mark.parametrize("value, want", [("inherit", ""), ("unset", ""), ("revert", ""), ("visible", "y"), ("initial", "y"), ("hidden", "")])
def test_visibility_inside_hidden_elements(value, want):
    assert render(f"<div style='visibility:hidden'>n<p style='visibility:{value}'>y</p>n</div>") == want


@pytest.mark.parametrize("page, want", [
    ("<p>a <svg viewBox='0 0 9 9'><title>n</title><desc>n</desc><metadata>n</metadata><defs><text>n</text></defs>n"
     "<g><rect width='5'/><text x=1>Jan</text><text x=2>Feb <tspan>2024</tspan></text></g></svg> b", "a\nJan\nFeb 2024\nb"),
    ("<svg><defs/><path d='M0'><text>A &amp; B<tspan x=0 dy=1em>C</tspan></text></svg>", "A & B\nC"),
    ("a<svg><style>n</style><script/><path/></svg>b", "ab"), ("<svg><title/><text>y</text></svg>", "y"),
    ("<svg><text visibility=hidden>n<tspan visibility=visible>y</tspan></text><text display='none'>n</text></svg>", "y"),
    ("<p>a<svg><g><foreignObject><div>h<p>i</div></foreignObject><text>t</text><style>n</style></g></svg>b", "a\nh\n\ni\n\nt\nb"),
    ("<svg><text><![CDATA[1 > 0]]></text><style><![CDATA[a>b{}]]></style></svg>", "1 > 0"),
    ("<svg><path><p>shown", "shown"), ("<svg/>x<svg><a href=u/><text>l</text></a></svg>", "x\nl"),
    ("<text>plain</text>", "plain"),
])
def test_text_of_inline_svg(page, want):
    assert render(page) == want


def test_deep_and_long_pages_lose_nothing():
    assert render("<div>" * 50_000 + "deep" + "</div>" * 50_000 + "after").split() == ["deep", "after"]
    assert render("<ul><li>x" * 3000).count("x") == 3000
    assert render("<b>" * 3000 + "<p>y" * 3000).count("y") == 3000
    assert len(render("<p>word " * 200_000).split()) == 200_000


def test_deep_svg_loses_no_label():
    page = "<svg>" + "<g>" * 3000 + "<text>l</text>" * 3 + "</g>" * 3000 + "<text>m</text></svg>after"
    assert render(page).split() == ["l", "l", "l", "m", "after"]


def test_defined_cases(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "u", "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS row")
    got = sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "a"), (None, ""), (2, "")], key=repr)
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []
