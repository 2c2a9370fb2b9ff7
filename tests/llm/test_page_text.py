"""The main text of pages on planted layouts, broken markup and every edge of a table."""

import time

import pytest

from multifactor.llm import pagetext
from multifactor.llm.pagetext import main_text

PROSE = "The council met on Monday, as it does every month, and after two hours of talk, agreed to mend the bridge, the road and the old mill."
ARTICLE = f"<h1>A bridge</h1><p>{PROSE}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul><p>{PROSE}</p>"
TEXT = f"A bridge\n{PROSE}\nShort.\nOne\nTwo\n{PROSE}"
AROUND = [
    "<nav><ul><li><a href='/'>Home, start, begin</a></li></ul></nav>",
    f"<header><h2>The Daily</h2><p>{PROSE}</p></header>",
    f"<aside><p>{PROSE}</p></aside>",
    f"<footer><p>{PROSE}</p></footer>",
    f"<div class='cookie-notice'><p>{PROSE}</p></div>",
    f"<div id='sidebar'><p>{PROSE}</p></div>",
    f"<section class='comments'><article class='comment'><p>{PROSE}</p></article></section>",
    f"<div class=ad>{PROSE}</div>",
    f"<form action='/x'><p>{PROSE}</p><input><select><option>{PROSE}</select></form>",
    f"<script>var p = '<p>{PROSE}</p>';</script><style>p {{ margin: 0 }}</style><!-- <p>{PROSE}</p> -->",
    f"<div role='navigation'><p>{PROSE}</p></div><div hidden><p>{PROSE}</p></div><p style='display: none'>{PROSE}</p>",
]


@pytest.mark.parametrize("container", ["<article>{}</article>", "<div class='content has-sidebar'>{}</div>", "<div>{}</div>", "<main><div id=postBody>{}</div></main>", "<form><article>{}</article></form>"])
@pytest.mark.parametrize("around", [*AROUND, "".join(AROUND)])
def test_only_the_article_is_kept(container, around):
    body = container.format(ARTICLE)
    for page in (around + body, body + around, f"<!DOCTYPE html><html><head><title>{PROSE}</title></head><body>{around}<div>{body}</div>{around}"):
        assert main_text(page) == TEXT
    if container.startswith("<article"):  # inside it too
        assert main_text(container.format(ARTICLE.replace("<ul>", around.replace("<header>", "<footer>").replace("</header>", "</footer>") + "<ul>"))) == TEXT


def test_short_articles_win_over_long_surroundings():
    assert main_text(f"<div class=x><p>{PROSE}</p></div><article><p>Be.</p></article>") == "Be."


def test_siblings_that_continue_the_best_container_are_kept():
    first, second = (f"<div class='part'>{f'<p>{PROSE}</p>' * n}</div>" for n in (4, 2))
    page = f"<body><h2>Head</h2>{first}<p>{PROSE}</p>{second}<div><p>Tiny</p></div><div><p><a href='x'>{PROSE}</a></p></div></body>"
    assert main_text(page) == "\n".join(["Head", *[PROSE] * 7])


def test_white_space_references_and_unclosed_tags():
    page = "<article><p> a&amp;b&lt;\n\tc&#233;&nbsp;d &amp &notanentity; <b>x</b>y<br>z<p><b>two<i>half<p>three<li>four<td>five</article>"
    assert main_text(page) == "a&b< cé d & ¬anentity; xy z\ntwohalf\nthree\nfour\nfive"
    assert main_text("<article><p>a < b and c<d e='>'>f</p></article") == "a < b and cf"
    assert main_text("<article><p title=it's>a</p><p class=\"x>b</p>") == "a\nb"
    assert main_text("<p>cut <a href='") == "cut" and main_text("<p>cut<!-- x") == "cut" and main_text("<p>cut<script>x") == "cut"


@pytest.mark.parametrize("html", [None, "", " \n", "<nav>menu</nav>", "<div class='ad'>buy</div>", "<p></p>", "<!---->", "<a href=x>links only</a>", "</p></div>", "<"])
def test_pages_without_article_are_empty(html):
    assert main_text(html) in ("", "<") and (html == "<" or main_text(html) == "")


@pytest.mark.parametrize("unit", ["<a ", "<!--", "<div>", "<p>x", "</div>", "<script>", '<a href="x>', "<div><li>", "&", "<", "<dt><div>", "= ", "<td>x", "<p class='"])
def test_long_broken_pages_take_linear_time(unit):
    begun = time.perf_counter()
    main_text(unit * 40_000)
    assert time.perf_counter() - begun < 5


def test_table_edges(spark):
    schema = "page_id long, html string, text string, n_chars string, `a.b` string"
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, None, "t", "n", "x"), (2, "", "t", "n", "x"), (3, f"<article>{ARTICLE}</article>", None, "n", "x"), (3, f"<article>{ARTICLE}</article>", None, "n", "x"), (None, long, "t", "n", "x")]
    found = pagetext.extracted(spark.createDataFrame(rows, schema).repartition(2))
    assert found.columns == ["page_id", "html", "text_", "n_chars_", "a.b", "text", "n_chars"]
    got = sorted([(r.page_id or 0, r.text_, r.text, r.n_chars) for r in found.collect()], key=str)
    whole = "\n".join([PROSE] * 20_000)
    assert got == sorted([(1, "t", "", 0), (2, "t", "", 0), (3, None, TEXT, len(TEXT)), (3, None, TEXT, len(TEXT)), (0, "t", whole, len(whole))], key=str)
    assert pagetext.extracted(spark.createDataFrame([], schema)).count() == 0
