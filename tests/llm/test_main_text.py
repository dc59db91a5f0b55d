"""Main text of pages of many shapes, and the query, against what each page was made from."""

import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from apotheca.llm import main_text, queries

FOLDER = "/root/testdata/sf0.001"
OPTIONS = main_text.Options()
P = "The quick brown fox jumps over the lazy dog and runs on."


def article(n=3):
    return "".join(f"<p>{P} {P} {i}</p>" for i in range(n))


def text(n=3):
    return "\n".join(f"{P} {P} {i}" for i in range(n))


LINKS = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(30))
SHAPES = {
    "states of a layout": (f'<html><head></head><body><div class="layout has-sidebar"><article>{article()}</article></div></body></html>', text()),
    "state of an article": (f'<article class="post comments-open">{article()}</article>', text()),
    "no body": (f"<html><head><title>x</title><p>{P}</p>{article()}", f"{P}\n{text()}"),
    "no head": (f"<title>t</title>{article()}", text()),
    "long advert": (f'<div>{article(2)}<div class="ad"><p>{"Buy it now. " * 40}</p></div><p>{P} {P} {P} {P}</p></div>', f"{text(2)}\n{P} {P} {P} {P}"),
    "short tail": (f'<article><p>{P}</p><aside>{P * 9}</aside><p>The end.</p></article>', f"{P}\nThe end."),
    "list of links": (f"<div>{article()}<ul>{LINKS}</ul><p>{P} {P} {P} {P}</p></div>", "\n".join([text(), *(f"link {i}" for i in range(30)), f"{P} {P} {P} {P}"])),
    "list of links at the end": (f"<article><p>{P}</p><ul>{LINKS}</ul></article>", P),
    "teaser as article": (f'<body><article><h2>Teaser</h2><p>{P}</p></article><div class="content">{article(9)}</div></body>', f"Teaser\n{P}\n{text(9)}"),
    "button in a line": (f"<p>One two <button>Copy</button> three four. {P}</p>", f"One two three four. {P}"),
    "formula in a line": (f"<p>One two <math><mi>x</mi></math> three four. {P}</p>", f"One two x three four. {P}"),
    "open select": (f"<div><p>{P}</p><select><option>a<p>{P}</p>{article()}", f"{P}\n{P}\n{text()}"),
    "open textarea": (f"<div><p>{P}</p><textarea><p>{P}</p>{article()}", f"{P}\n{P}\n{text()}"),
    "open script": (f"<article>{article()}<script>var x = '<p>no</p>'", text()),
    "one form": (f'<body><form id="form1"><div class="header">Site name</div><div class="main-content"><h1>Title here</h1>{article()}</div><div class="footer">imprint</div></form></body>', f"Title here\n{text()}"),
    "comments as articles": (f'<main><article><h1>T</h1>{article()}</article><section id="comments"><article class="comment"><p>{P * 9}</p></article></section></main>', f"T\n{text()}"),
    "no names": (f"<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div><h2>Head line</h2>{article()}</div><ul><li><a href=a>Imprint</a></li><li><a>About</a></li></ul>", f"Head line\n{text()}"),
    "header in an article": (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{article()}<footer>Posted by me</footer></article></body>", f"Title\n{text()}"),
    "other articles aside": (f'<div class="content"><h1>Title</h1>{article(4)}</div><aside><article class="card"><p>Related post</p></article><article class="card"><p>Another one</p></article></aside>', f"Title\n{text(4)}"),
    "roles": (f'<div role="navigation"><a>x</a></div><div role="main"><h1>T</h1>{article()}</div><div role="contentinfo">c</div>', f"T\n{text()}"),
    "names on body": (f'<body class="home page sidebar-right"><div id="wrapper" class="with-nav"><div id="content">{article()}</div><div id="sidebar"><p>{P}</p></div></div></body>', text()),
    "consent first": (f'<div id="cookieBanner"><p>{P * 3}</p></div><nav>a b c</nav><div>{article()}</div>', text()),
    "open cells": (f"<article><table><tr><td>a b</td><td>c</td></tr><tr><td>d</table><p>{P}</p></article>", f"a b\nc\nd\n{P}"),
    "open items": (f'<article><ul><li>one of the items<li class="ad">ad ad<li>two</ul>{article()}</article>', f"one of the items\ntwo\n{text()}"),
    "post of parts": (f'<div class="post"><div class="post-header"><h1>T</h1></div><div class="post-content">{article()}</div><div class="post-comments"><p>{P * 2}</p></div></div>', f"T\n{text()}"),
    "sign-up inside": (f'<article>{article(1)}<div class="newsletter-signup"><form><p>Sign up</p><input></form></div><p>{P}</p></article>', f"{text(1)}\n{P}"),
    "link around a block": (f"<article><a href=x><div>linked</a> text</div>{article()}</article>", f"linked text\n{text()}"),
    "crossed tags": (f"<b><article><p>x</b> y</p>{article()}</article>", f"x y\n{text()}"),
    "preformatted": (f"<article><pre>a  b\n c</pre>{article()}</article>", f"a b c\n{text()}"),
    "noscript": (f"<article><noscript><img src=x>no js</noscript>{article()}</article>", text()),
    "references": (f"<article><p>a&nbsp;b &amp;lt; &#x41;&eacute; c&lt;d</p>{article()}</article>", f"a b &lt; Aé c<d\n{text()}"),
}


@pytest.fixture(scope="module")
def weights(spark):
    return main_text.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(weights, shape):
    page, expected = SHAPES[shape]
    assert main_text.extract(page, weights, OPTIONS) == expected
    assert main_text.extract(page, {}, OPTIONS) == ""


def test_weights_decide(weights):
    """A page without names of margins: what links cost, as learned, is what keeps a list of them out."""
    page = f"<div><p>{P} {P}</p></div><ul>{LINKS}</ul>"
    assert main_text.extract(page, weights, OPTIONS) == f"{P} {P}"
    assert main_text.extract(page, weights | {"word link": 1.0}, OPTIONS).endswith("link 29")


def test_fit_ignores_unlabelled(spark, weights):
    """Weights come from labels: on tables without any they are the prior, and labels move them."""
    prior = main_text.fit(spark.createDataFrame([(1, f"<div>{article()}</div>")], "page_id long, html string"))
    assert prior == main_text.learned_weights({}, {}, OPTIONS) and weights["word block"] > prior["word block"] and weights["margin nav"] < 0


def test_made_pages(weights):
    """Pages put together at random, most without a mark: precision and recall of the words of the article's blocks."""
    right = returned = wanted = 0
    rng = random.Random(8)
    words = "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    margins = ["<nav><ul><li><a href=/>{}</a></li></ul></nav>", '<div class="ad">{}</div>', '<div class="site-sidebar"><p>{}</p></div>', "<aside>{}</aside>", "<form><label>{}</label><input></form>", '<section class="comments"><p>{}</p></section>', "<script>{}</script>", "<!-- {} -->", "<footer>{}</footer>", '<div id="cookie-notice">{}</div>']
    for _ in range(400):
        blocks, inner = [], []
        for _ in range(rng.randint(2, 9)):
            block = sentence(rng.randint(1, 60))
            blocks.append(block)
            tag = rng.choice(["p", "h2", "blockquote", "li", "div"])
            inner.append(f"<{tag}>{block.replace('gamma', '<b>gamma</b>').replace('é', '&eacute;')}</{tag}>")
            if rng.random() < 0.3:
                inner.append(rng.choice(margins).format(sentence(rng.randint(1, 90))))
        mark = rng.choice(["article", "main", "div role=main", "div", "section"])
        before, after = ("".join(rng.choice(margins).format(sentence(rng.randint(1, 20))) for _ in range(rng.randint(0, 3))) for _ in range(2))
        page = f"<html><head><title>x</title></head><body>{before}<{mark}>{''.join(inner)}</{mark.split()[0]}>{after}</body></html>"
        found, expected = Counter(main_text.extract(page, weights, OPTIONS).split()), Counter(" ".join(blocks).split())
        right, returned, wanted = right + (found & expected).total(), returned + found.total(), wanted + expected.total()
    assert right / returned >= 0.95 and right / wanted >= 0.95, (right / returned, right / wanted)


def test_long_odd_pages(weights):
    """Linear on whatever is left open."""
    for odd in ("<i>" * 25000 + "<div>" + "</i>" * 25000, "<textarea>" * 30000, "<b>" * 20000 + "<div>" + "<li><dd>" * 20000 + "</b>" * 20000, "<a><b>" * 30000, "<div class=ad>" * 30000, "<h1>" * 3000 + "<div class=sidebar>" * 3000, "<article>x" * 3000):
        main_text.extract(odd, weights, OPTIONS)


def test_query(spark, weights):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = queries.op10_main_text(spark, FOLDER).collect()
    assert len(rows) == len(source)
    tags = re.compile(r"<[^>]*>")
    for r in rows:
        inside = re.search("<article>(.*?)</article>", source[r.page_id].html, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(tags.sub(" ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_edges(spark, weights):
    """Nulls, empty pages, repeated rows, ids that are null, columns named like the result, and an empty table."""
    page = SHAPES["no names"][0]
    pages = spark.createDataFrame([(1, page, "t"), (1, page, "t"), (None, page, None), (2, None, "u"), (3, "", "v"), (4, "<p>" + "word " * 200000, "w")], "page_id long, html string, text string")
    found = main_text.extract_text(pages, weights, keep=["text"])
    assert found.columns == ["page_id", "text_", "text"]
    rows = sorted((str(r.page_id), str(r.text_), r.text) for r in found.collect())
    expected = SHAPES["no names"][1]
    assert rows == [("1", "t", expected), ("1", "t", expected), ("2", "u", ""), ("3", "v", ""), ("4", "w", " ".join(["word"] * 200000)), ("None", "None", expected)]
    assert main_text.extract_text(pages.limit(0), main_text.fit(pages.limit(0))).count() == 0
    assert main_text.extract_text(pages.withColumn("__html", F.lit(1)), weights, keep=["__html"]).count() == 6
