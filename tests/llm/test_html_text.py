import time
from html.parser import HTMLParser

from lumenfield.llm.html_text import INVISIBLE, VOID, extract_text, render
from lumenfield.llm.queries import op10_html


def test_layout():
    assert render("<p>a<p>b  c<div>d</div>e<br>f") == "a\n\nb c\n\nd\ne\nf"
    assert render("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x") == "- a\n- b\n  - c\n- d\n\nx"
    assert render("<ol start=9><li>a<li>b</ol>") == "9. a\n10. b"
    assert render("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>after") == "Name       N\nlong name  1\n\nafter"
    assert render("<table><td colspan=2>ab cd<tr><td>x<td>y</table>") == "ab cd\nx  y"
    assert render("<pre>a\n  b</pre>c") == "a\n  b\n\nc"
    assert render("<h1>T</h1><b>x</b> <i>y</i>z &amp; &lt;p&gt;") == "T\n\nx yz & <p>"
    assert render("<dl><dt>t<dd>d<dt>u</dl>") == "t\n  d\nu"


def test_visibility():
    page = "<html><head><title>no</title><style>p{}</style></head><body>yes<script>if (a</p>b) no</script><p hidden>no<div style='color:red; display : none'>no<p>no</div><template>no</template><!-- no <p> --><noscript>no</noscript> end<input type=hidden value=no>"
    assert render(page).split() == ["yes", "end"]
    assert render("<p style='visibility:hidden'>no</p>a<p style='display:none'>no<p>b") == "a\n\nb"


def test_pages_without_end_of_head():
    for page, words in (
        ("<html><head><title>t</title><body><p>one two", "one two"),
        ("<head><meta charset=utf-8><link rel=x><style>p{}</style><script>no</script><noscript><p>no</noscript><p>one<p>two", "one two"),
        ("<!DOCTYPE html><html><head><title>t</title>\n one <b>two</b></html>", "one two"),
        ("<head><base href=x><template><p>no</template>\n<table><tr><td>one<td>two</table>", "one two"),
        ("<html><head><html><head><title>t</title><h1>one</h1></head>two", "one two"),
        ("<head><title>t</title></head><body>one <head><title>no</title>two", "one two"),
    ):
        assert render(page).split() == words.split(), page


def test_drawings_and_formulas_show_their_text():
    for page, words in (
        ("a<svg viewBox='0 0 1 1'><title>no</title><desc>no</desc><path d='M0'/><text x=1>one</text><text>two</text></svg>b", "a one two b"),
        ("<p><math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> end", "x=2 end"),
        ("<svg><title/><defs/><g display='none'><text>no</text></g><g id=a/><text><![CDATA[one]]></text></g></svg>two", "one two"),
        ("<svg><foreignObject><div>one</div></foreignObject><style>no</style><script/></svg>two", "one two"),
        ("<svg><defs><linearGradient><p>one</p>two", "one two"),
        ("<defs>one</defs> <symbol>two</symbol>", "one two"),
    ):
        assert render(page).split() == words.split(), page
    began = time.time()
    assert render("<svg>" + "<g>" * 100000 + "<text>x" * 3).split() == ["x"] * 3 and time.time() - began < 5


def test_broken_pages():
    assert render(None) == "" and render("") == "" and render("<") == "<" and render("a < b <3 <") == "a < b <3 <"
    assert render("</p></div>x</table>") == "x"
    assert render("<a href='x>y") == "y"
    assert render("<td>x</td>") == "x"
    assert render("<script>never closed") == ""
    assert render("<table><tr><td>a<table><tr><td>b</table>c</table>d") == "a\n\nb\n\nc\n\nd"
    for deep in ("<div>" * 50000 + "x", "<b>" * 50000 + "<p>x" * 3, "<ul><li>" * 2000 + "x", "<table><tr><td>" * 500 + "x", '<a "' * 30000, '<a "' * 30000 + ">", "<p>x" * 50000, "<td>" * 20000, "&" * 100000):
        began = time.time()
        render(deep)
        assert time.time() - began < 5


class Words(HTMLParser):
    """An independent list of the visible words of a page whose invisible elements are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in INVISIBLE and tag not in VOID

    def handle_endtag(self, tag):
        self.depth -= tag in INVISIBLE and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.words.append(data)


def test_query_keeps_all_visible_letters(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op10_html(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        w = Words()
        w.feed(pages[r.page_id])
        letters = "".join("".join(w.words).split())
        got = "".join(r.text.split())
        markers = "-" * pages[r.page_id].count("<li>")  # all lists of these pages have bullets
        assert sorted(letters + markers) == sorted(got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a")], "page_id long, html string").selectExpr("*", "7 as text")
    assert sorted((r.page_id, r.text) for r in extract_text(df).collect()) == [(1, ""), (2, ""), (3, "a"), (3, "a")]
    assert extract_text(df.limit(0)).count() == 0


def test_cells_over_several_rows_and_columns():
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A  B\n   C"
    assert render("<table><tr><td>a<td rowspan=3>long<td>c<tr><td>d<td>e<tr><td colspan=1>f<td>g<tr><td>h<td>i<td>j</table>") == "a  long  c\nd        e\nf        g\nh  i     j"
    assert render("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>") == "x  1\n   2\n   3"
    assert render("<table><tr><td colspan=2 rowspan=2>ab<td>1<tr><td>2<tr><td>p<td>q<td>3</table>") == "ab    1\n      2\np  q  3"
    wide = "<table><tr>" + "<td colspan=1000>x" * 3000 + "<tr>" + "<td rowspan=9 colspan=900>y" * 3000 + "</table>"
    assert len(render(wide)) < 20 * 6000 and render(wide).count("x") == render(wide).count("y") == 3000
