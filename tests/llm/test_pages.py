"""Main text of pages: planted boilerplate of many kinds, malformed markup, odd rows."""

import time

import numpy as np
import pytest

from flowstream.llm.pages import main_text, page_text, smoothed

LONG = "Rain fell over the old harbour town all night and the boats stayed in, so nobody sold fish the next morning at the market by the quay."
BODY = f"<h1>Rain</h1><p>{LONG}</p><p>Short.</p><p>It <b>was</b>\n a&nbsp;grey &amp; cold day.</p><ul><li>one</li><li>two</li></ul><p>End.</p>"
WANT = f"Rain\n{LONG}\nShort.\nIt was a grey & cold day.\none\ntwo\nEnd."

BOILERPLATE = [
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us and everything else that we have to tell</a></li></ul></nav>",
    f"<header><h1>The Site</h1><p>{LONG}</p></header>",
    f"<footer>&copy; example {LONG}</footer>",
    f"<aside><h2>Latest</h2><p>{LONG}</p></aside>",
    f"<div class='cookie-notice'><p>{LONG}</p></div>",
    f"<div class=\"ad\">{LONG}</div>",
    f"<div id='topBanner'>{LONG}</div>",
    f"<div class='widget sidebar-left'><p>{LONG}</p></div>",
    f"<form action='/s'><label>{LONG}</label><input name=q><button>Go</button></form>",
    f"<script>var t = '</p>{LONG}';</script>",
    f"<style>p:after{{content:'{LONG}'}}</style>",
    f"<!-- {LONG} <p>{LONG}</p> -->",
    f"<section id='comments'><h3>2 comments</h3><article class='comment'><p>{LONG}</p></article><article class='comment'>{LONG}</article></section>",
    f"<div class='comments-area'><ol class='commentlist'><li>{LONG}</li></ol></div>",
    f"<div role='alert'>{LONG}</div>",
    f"<div hidden><p>{LONG}</p></div>",
    f"<div style='display: none'>{LONG}</div>",
    f"<noscript>{LONG}</noscript>",
    f"<template><p>{LONG}</p></template>",
]


def page(body, head="<title>Rain &amp; more</title>"):
    return f"<!DOCTYPE html><html><head><meta charset=utf-8>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("kind", ["article", "main", "div"])
@pytest.mark.parametrize("junk", BOILERPLATE, ids=lambda j: j[:24])
def test_boilerplate_goes_wherever_it_stands(kind, junk):
    inside = BODY if junk.startswith("<header") else BODY.replace("<p>Short.", f"{junk}<p>Short.")
    for text in (page(f"{junk}<{kind}>{inside}</{kind}>{junk}"), page(f"<div class='wrap'>{junk}<{kind}>{inside}</{kind}></div>{junk}")):
        assert page_text(text) == WANT


def test_all_of_it_together():
    everything = "".join(BOILERPLATE)
    assert page_text(page(f"{everything}<article>{BODY}</article>{everything}")) == WANT
    assert page_text(page(f"{everything}<div class=content>{BODY}</div>{everything}")) == WANT


def test_article_of_one_word_beats_longer_blocks_around_it():
    assert page_text(page(f"<div>{LONG}</div><article><h1>Sthe.</h1><p>Sthe.</p></article><div>{LONG}</div>")) == "Sthe.\nSthe."


def test_malformed_markup():
    assert page_text(page(f"<article><h1>Rain</h1><p><b>Rain<br><p>{LONG}</p><p>x</article>")) == f"Rain\nRain\n{LONG}\nx"
    assert page_text(f"<nav><ul><li><a href=/>Home</a></ul></nav><article><p>{LONG}") == LONG  # cut off
    assert page_text(f"<div><nav>Menu<ul><li>Home</div><article><p>{LONG}</p></article>") == LONG  # menu ends with its parent
    assert page_text(f"<nav><a>Home</a><article><p>{LONG}</p></article>") == LONG  # menu never ends
    assert page_text(f"<article><p>{LONG}</p></div></section><p>More.</p></article><p>No.</p>") == f"{LONG}\nMore."
    assert page_text(f"<form id=all><article><p>{LONG}</p></article><p>No.</p></form>") == LONG
    assert page_text(f"<article><p>{LONG} <span class=ad>Buy <span>now</span>!</span> a &lt; b</p><![if x]><p>5 &#x3e; 4 &unknown; &copy</p></article>") == f"{LONG} a < b\n5 > 4 &unknown; ©"
    assert page_text(f"<article><p>{LONG}</p><p title=\"open>Last.</p></article>") == f"{LONG}\nLast."
    assert page_text(f"<article><p>{LONG}</p><p>7 < 8 and 9</p></article><scr") == f"{LONG}\n7 < 8 and 9"
    assert page_text(f"<article class='post has-sidebar no-comments'><p class=lead>{LONG}</p><div class='downloads'>d</div></article>") == f"{LONG}\nd"


def test_blocks_and_white_space():
    cells = "<table><tr><th>a<td> b \t<tr><td>c</table><dl><dt>k<dd>v</dl><pre>x\n\n y</pre><blockquote>q<br>r</blockquote>"
    assert page_text(f"<article><p>{LONG}</p>{cells}</article>") == f"{LONG}\na\nb\nc\nk\nv\nx y\nq r"


def test_without_markup_of_an_article_the_dense_region_wins():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(30))
    teasers = "".join(f"<div><a href=/{i}><b>Read</b> <i>this</i></a></div>" for i in range(20))
    got = page_text(page(f"<div><ul>{menu}</ul></div><div><h2>Rain</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div>{teasers}</div>"))
    assert got == f"Rain\n{LONG}\n{LONG}\nShort."


def test_teasers_in_articles_of_their_own():
    teasers = "".join(f"<article><h2><a href=/{i}><b>No</b> <i>{i}</i></a></h2></article>" for i in range(12))
    assert page_text(page(f"<main><article>{BODY}</article>{teasers}</main>")) == WANT


def test_smoothing_keeps_the_mass_inside():
    flat = smoothed(np.ones(50))
    assert abs(flat[25] - 1) < 1e-12 and flat[0] < 1
    assert smoothed(np.array([3.0])).shape == (1,)


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<", "&", "</", "<a href=\"", "<![x", "<?", "<script>", "<p a=1 ", "<!--x>", "<a b='>", "<div>", "<p><b>",
                                   "<span class=ad>", "</div>", "<table><td>", "<nav>", "<ul><li>", "text &amp; "])
def test_time_in_proportion(piece):
    def seconds(n):
        t = time.perf_counter()
        page_text(piece * n)
        return time.perf_counter() - t

    assert seconds(60_000) < 4


def test_table_of_pages(spark):
    rows = [(1, "u1", page(f"<article>{BODY}</article>"), "old", 1), (2, None, None, "old", 2), (None, "u3", "", None, 3), (4, "u4", "<nav>x</nav>", "", 4),
            (1, "u1", page(f"<article>{BODY}</article>"), "old", 1), (5, "u5", page("<article>" + f"<p>{LONG} 😀</p>" * 5000 + "</article>"), "", 5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `a.b` int")
    got = main_text(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    long = "\n".join([f"{LONG} 😀"] * 5000)
    want = [(1, "u1", WANT), (2, None, ""), (None, "u3", ""), (4, "u4", ""), (1, "u1", WANT), (5, "u5", long)]
    assert sorted(map(str, got)) == sorted(str(type(got[0])(page_id=i, url=u, text=t, n_chars=len(t))) for i, u, t in want)
    assert [tuple(r) for r in main_text(table, keep=["a.b"]).where("`a.b` = 2").collect()] == [(2, "", 0)]
    assert main_text(table.limit(0)).collect() == []
