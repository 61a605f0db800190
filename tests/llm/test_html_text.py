from __future__ import annotations

import duckdb
import pytest

from ledgerline.llm import html_text
from ledgerline.llm.html_text import extract, main_text, spans
from ledgerline.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = "A long sentence of an article that goes on for quite some time, as sentences in articles do. " * 3
LONG = LONG.strip()


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    twin = con.sql(f"SELECT page_id, url, text, n_chars FROM ({ORACLE_SQL['op12_html_text']})").fetchall()
    got = [tuple(r) for r in QUERIES["op12_html_text"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(twin) and all(r[3] > 0 for r in got)


def test_given_pages_without_marks(spark):
    """The same articles are found by text alone."""
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        bare = page.html
        for tag in ("article", "nav", "footer"):
            bare = bare.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        bare = bare.split("<footer>")[0]
        if len(main_text(page.html)) > 1000:
            assert main_text(page.html) in main_text(bare)


def test_surge_and_dive():
    assert spans([5, 0, 0, 0, 90, 3, 0, 40, 60, 0, 0, 0, 4], 86) == [(4, 8)]
    assert spans([0, 0, 200, 0, 0, 0, 0, 100], 86) == [(2, 2), (7, 7)]
    assert spans([], 1) == [] and spans([0, 0], 1) == [] and spans([1], 1) == [(0, 0)]


def test_marked_pages_go_through_surge_and_dive(monkeypatch):
    """The surge adapts on a marked page as on others; what it leaves of the article is put back."""
    far = "<div>Far.</div>" * 6
    page = f"<article><h1>T</h1><p>{LONG}</p>{far}<p>{LONG}</p>{far}</article><p>{LONG}</p>"
    surges, found = [], []

    def noted(weights, surge):
        surges.append(surge)
        return spans(weights, surge)

    def kept(lines, given=html_text.distributed):
        found.append([lines[i].text for i in given(lines)])
        return given(lines)

    monkeypatch.setattr(html_text, "spans", noted)
    monkeypatch.setattr(html_text, "distributed", kept)
    fars = ["Far."] * 6
    assert main_text(page) == "\n".join(["T", LONG, *fars, LONG, *fars])
    assert set(surges) == {html_text.SURGE}
    assert found == [["T", LONG, LONG]]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<nav><a href=/>Home</a></nav>", ""),
        ("<p>Short.</p>", "Short."),
        ("<article><h1>T</h1><p>a  b\n c<br>d&nbsp;&amp;amp; &#65;&eacute;</article>", "T\na b c d &amp; Aé"),
        ("<article>a < b && c<p>x</p>y<!-- <p>no</p> -->z</article>", "a < b && c\nx\nyz"),
        ("<article><p>cut <a href='x", "cut"), ("<article><p>cut</p><!-- open", "cut"),
        ("<article><p>x<script>var t='</p>';</script>y<style>p{}</style></article>", "xy"),
        ("<article><p title='a > b'>x</p></article>", "x"),
        ("<ARTICLE><P>x</P></ARTICLE>", "x"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\nc"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul></article>", "a\nb\nc"),
        ("<form><article><p>x</p></article><input></form>", "x"),
        ("<nav><a>m</a><article><p>x</p></article>", "x"),
        ("<article><p>x</p><article class='comment'><p>c</p></article></article>", "x"),
        ("<article><p>x</p></article></article></div></p><p>y", "x"),
        ("<article>x</article><article class=related>y</article><article>z</article>", "x\nz"),
        ("<article><p hidden>h</p><p style='display: none'>n</p><p>x</p></article>", "x"),
        ("<main><h1>T</h1><p>x</p><aside>s</aside></main><p>out</p>", "T\nx"),
        ("<div class='ads'><article><p>x</p></article></div>", "x"),
        ("<div class='has-sidebar'><div class='post-content'><p>x</p></div></div><div>y</div>", "x"),
    ],
)
def test_pages(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize("unwanted", [
    "<div class='sidebar'>{}</div>", "<aside>{}</aside>", "<section id=comments><p>{}</p></section>",
    "<div class='cookie-notice'><p>{}</p></div>", "<form><label>{}</label></form>",
    "<div role=banner>{}</div>", "<div id='adSlot1'>{}</div>", "<footer><p>{}</p></footer>",
    "<header><p>{}</p></header>", "<div class='main-menu'>{}</div>", "<noscript>{}</noscript>",
    "<template><p>{}</p></template>", "<ul><li><a href=x>{}</a></li></ul>", "<dialog>{}</dialog>",
])
def test_unwanted_parts_of_pages_without_an_article(unwanted):
    other = unwanted.format("Other words, just as long as the sentences of the article itself, that must go.")
    page = f"<body>{other}<h2>Title</h2><p>{LONG}</p>{other}<p>Short.</p><p>{LONG}</p>{other}</body>"
    assert main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_menu_of_plain_words_goes():
    menu = "".join(f"<div>{word}</div>" for word in ("Home", "Products", "About", "Contact", "Login"))
    page = f"{menu}<p>{LONG}</p><p>Yes.</p><p>{LONG}</p>{menu}"
    assert main_text(page) == f"{LONG}\nYes.\n{LONG}"


def test_tables_with_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "t", 3), (1, "u", "<p>x", "t", 3), (None, None, "", None, None)]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(1, "u", "", 0), (1, "u", "x", 1), (None, None, "", 0)]
    assert extract(spark.createDataFrame([], schema)).collect() == []


def test_long_and_broken_pages_take_linear_time():
    import time

    start = time.perf_counter()
    assert len(main_text(f"<article>{'<p>word word</p>' * 100_000}")) == 999_999
    assert main_text("<div>" * 50_000 + "x" + "</b>" * 50_000) == "x"
    assert main_text("<p><b>" * 50_000 + "x").endswith("x")
    assert main_text("<a href=\"" * 20_000) == ""
    assert main_text("<article>" + "<" * 100_000).startswith("<<")
    assert time.perf_counter() - start < 60
