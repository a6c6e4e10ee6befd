"""Articles with lists, plain divs and containers without a telling name, and pages that are made to be slow."""

import re
import time
import zlib

import pyarrow.parquet as pq
import pytest

from atlas.llm import html


@pytest.fixture(scope="module")
def pages():
    return sorted((r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()), key=lambda p: zlib.crc32(p.encode()))


@pytest.fixture(scope="module")
def model(pages):
    return html.train(pages[:200])


def kept(model, page):
    found = html.leaves(page)
    return [x.text for x, k in zip(found, html.label(model, [html.features(found)])[0]) if k]


def inner(page):
    return re.search(r"<article>(.*?)</article>", page, re.S)[1]


CHANGES = {
    "list": lambda p, para, items: p.replace(para, f"<ul>{items}</ul>"),
    "list at the end": lambda p, para, items: p.replace("</article>", f"<ul>{items}</ul></article>"),
    "numbered": lambda p, para, items: p.replace(para, f"<ol>{items}</ol>"),
    "plain div": lambda p, para, items: p.replace(para, f"<div>{para[3:-4]}</div>"),
    "table": lambda p, para, items: p.replace(para, "<table><tr>" + items.replace("li>", "td>") + "</tr></table>"),
}


@pytest.mark.parametrize("change", CHANGES)
@pytest.mark.parametrize("container", ["article", "div", "div class='text'", "div class='td-pb-span8'", "section", "div id=x7"])
def test_articles_of_any_make(model, pages, change, container):
    right = tried = 0
    for page in pages[200:]:
        paragraphs = re.findall(r"<p>.*?</p>", inner(page), re.S)
        if len(paragraphs) < 3:
            continue
        items = "".join(f"<li>{w}</li>" for w in re.sub("<[^>]*>", " ", paragraphs[1]).split()[:5])
        made = CHANGES[change](page, paragraphs[1], items)
        want = [x.text for x in html.leaves(inner(made))]
        tried += 1
        right += kept(model, made.replace("<article>", f"<{container}>").replace("</article>", f"</{container.split()[0]}>")) == want
    assert tried > 20 and right >= 0.95 * tried


SLOW = {
    "open tags": "<a " * 350_000, "open svg": "<svg " * 200_000, "quotes": '<a "' * 250_000 + ">", "mixed quotes": "<a b\"c'" * 140_000, "declarations": "<!" * 500_000, "names": "<a" * 500_000, "raw": "<script " * 120_000, "brackets": "<" * 1_000_000,
    "ends of none": "<div>" * 100_000 + "</p>" * 100_000, "inline ends": "<u><div>" + "<i>" * 150_000 + "</u>" * 150_000, "deep": "<div>x" * 50_000, "comment": "<!-- " * 200_000, "attributes": "<p " + "class " * 160_000 + ">x",
}


@pytest.mark.parametrize("kind", SLOW)
def test_a_megabyte_is_read_in_seconds(kind):
    began = time.time()
    found = html.leaves(SLOW[kind])
    html.features(found)
    assert time.time() - began < 8 and sum(len(x.text) for x in found) <= len(SLOW[kind])
    if kind == "deep":
        assert len(found) == 50_000 and found[-1].path.depth == 50_000


def test_deep_pages_do_not_train(model, pages):
    deep = "<article>" + "<div>some words.</div>" * 3 + "<b>" * 300 + "more."
    assert html.train([deep]).p["out"].tolist() == html.Labeller(3).p["out"].tolist()
    assert all(kept(model, p) == [x.text for x in html.leaves(inner(p))] for p in pages[200:])


def test_hints():
    """Names tell; where none does, sentences that aren't mostly links."""
    named = html.leaves("<nav><a href=x>Here</a></nav><div class='post'><ul><li>a</ul><div class='share'>b</div></div>")
    assert html.hints(named).tolist() == [0, 1, 0]
    plain = html.leaves("<div><a>Home</a></div><div>Some words make a sentence.</div><div>two words</div>")
    assert html.hints(plain).tolist() == [0, 1, 0]
