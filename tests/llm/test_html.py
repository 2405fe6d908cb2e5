"""Main text of pages: structure, density rules, inheritance, odd markup."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest

from tapeloom.llm import html_text, queries
from tapeloom.llm.html_text import BAD, GOOD, OPEN

STORY = "The story of the house is that it was on the hill and that the people of the town were not in it for a long time, "
LONG = STORY + "but which of them it was is not known to us as of this day, and the rest is as it was by then."
NOISE = "Xq zzvrk plomt graddle frint vosk, brundle quaft mipple dren struxy flonk verdle pim tracks only numbers here."


def text(source: str) -> str:
    blocks = html_text._Page(source).blocks
    if not blocks:
        return ""
    kept = html_text.main_blocks(np.zeros(len(blocks), int), blocks)
    return "\n".join(b[0] for b, k in zip(blocks, kept, strict=True) if k)


def test_articles_of_a_table_equal_a_plain_cut(spark):
    got = queries.op13_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(got) == len(pages) and {r.page_id for r in got} == set(pages)
    for row in got:
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(p for p in parts if p)
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


@pytest.mark.parametrize("outside", [
    "<nav><a href=x>Home</a> and more</nav>", "<header><h1>Site</h1></header>", "<footer>All of the rights</footer>", f"<aside>{LONG}</aside>",
    f'<div class="box adslot"><p>{LONG}</p></div>', f'<section class="site-notification"><p>{LONG}</p></section>', f'<ul class="commentlist"><li>{LONG}</ul>',
    f"<form><p>{LONG}</p></form>", f'<div class="cookie-notice"><p>{LONG}</p></div>', f"<div id='comments'><h2>Comments</h2><p>{LONG}</p></div>",
    f'<article class="comment"><p>{LONG}</p></article>', f'<div class="ad">{LONG}</div>', f'<div role="complementary">{LONG}</div>',
    f"<script>var t = '</p>{LONG}';</script>", "<style>p { margin: 0 }</style>", f"<!-- {LONG} -->", f"<div hidden>{LONG}</div>",
    f'<div style="display: none">{LONG}</div>', "<textarea>Your name</textarea>", "<select><option>One</option></select>", "<title>Site</title>",
])
def test_markup_that_names_itself_is_left_out(outside):
    want = f"Title\n{LONG}\nShort end."
    assert text(f"<body>{outside}<article><h1>Title</h1><p>{LONG}</p><p>Short end.</p></article>{outside}</body>") == want
    assert text(f"<body>{outside}<div><h1>Title</h1><p>{LONG}</p><p>Short end.</p></div>{outside}</body>") == want
    if "header" not in outside:
        assert text(f"<body><article><h1>Title</h1><p>{LONG}</p>{outside}<p>Short end.</p></article></body>") == want


def test_short_and_noisy_paragraphs_of_an_article_stay():
    assert text(f"<nav>x</nav><article><h1>One</h1><p>Two.</p><p>{NOISE}</p></article><footer>y</footer>") == f"One\nTwo.\n{NOISE}"
    assert text("<nav>x</nav><article><p>Only this.</p></article>") == "Only this."
    assert text(f"<main><p>{LONG}</p></main><div><p>{LONG}</p></div>") == LONG


def test_blocks_without_an_article_go_by_density_and_neighbours():
    page = f"""<div><a href=x>Home</a> | <a href=y>About us</a></div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>
        <div><p>{NOISE}</p><p>Buy now.</p></div>"""
    assert text(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_inheritance():
    label = np.array([BAD, OPEN, OPEN, GOOD, OPEN, BAD, OPEN, OPEN])
    group = np.array([0, 0, 0, 0, 0, 0, 1, 0])
    heading = np.zeros(8, bool)
    assert html_text.inherit(label, heading, group).tolist() == [BAD, BAD, GOOD, GOOD, GOOD, BAD, OPEN, BAD]
    heading[4] = True  # at equal distances a heading follows what comes after it
    assert html_text.inherit(label, heading, group)[4] == BAD
    assert html_text.inherit(label[:0], heading[:0], group[:0]).tolist() == []


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("<", "<"), ("<p", ""), ("</p></p>", ""), ("plain", "plain"), ("a < b &amp; c&#33; &nbsp; d", "a < b & c! d"),
    ("<p>a<br>b<p>c<br/><br>d", "a b\nc\nd"), ("<p><b>a<p>b</b> c</p>d", "a\nb c\nd"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ('<p title="x > y">a</p>', "a"), ('<p title="x>a</p><p>b', "a\nb"),
    ("<p>a\x00b　 c\t\nd</p>", "a\x00b c d"), ("<script>a", ""), ("<P CLASS=AD>a</P><P>b</P>", "b"), ("<!-- a", ""), ("e<i>f</i>g", "efg"),
    ("<p>a <span hidden>b</span><button>c</button>d</p>", "a d"),
])
def test_odd_markup(source, want):
    assert text(source) == want


def test_odd_rows(spark):
    long = f"<article>{f'<p>{LONG}</p>' * 20_000}</article>"
    deep = "<div>" * 20_000 + "deep" + "</span>" * 20_000
    rows = [(1, None, None), (2, "u", ""), (None, "n", "<p>a"), (3, "r", "<p>a"), (3, "r", "<p>a"), (4, "l", long), (5, "d", deep)]
    pages = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "page_id bigint, url string, html string, text string, n_chars int, block int")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=repr)
    whole = "\n".join([LONG] * 20_000)
    want = [(1, None, "", 0), (2, "u", "", 0), (None, "n", "a", 1), (3, "r", "a", 1), (3, "r", "a", 1), (4, "l", whole, len(whole)), (5, "d", "deep", 4)]
    assert got == sorted(want, key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0
