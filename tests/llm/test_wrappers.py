"""The host's wrapper decides where a page's article is; names and hidden elements; long pages; file splits."""

import random
import time

import pyarrow.parquet as pq
import pytest

from photolake.llm import wrappers

STORY = "The story goes on here. " * 20
PAGE = "<html><body><article><h1>Title</h1><p>" + STORY + "</p>%s<p>The end.</p></article></body></html>"


@pytest.mark.parametrize("name", ['class="notice"', 'class="alert"', 'class="replies"', 'class="share-buttons"', 'class="related-posts"', "hidden", 'style="color:red; display: none"', 'class="' + "layout-42 " * 60 + 'comments"'])
def test_goes_from_the_article(name):
    assert "OTHER" not in wrappers.extract(PAGE % f"<div {name}>OTHER text</div>", None)


@pytest.mark.parametrize("part", ['<section id="discussion">', '<section class="social-history">', '<p class="market-share">', '<div class="overflow hidden">', '<p class="hidden-gems">', '<p title="hidden">'])
def test_stays_in_the_article(part):
    text = wrappers.extract(PAGE % f"{part}KEPT text", None)
    assert "KEPT text" in text and "The end." in text


def test_comments_longer_than_the_article():
    thread = "".join(f"<article><p>{'COMMENT words. ' * 30}</p></article>" for _ in range(5))
    text = wrappers.extract(f"<html><body><article><p>{STORY}</p></article><section class='comments'>{thread}</section></body></html>", None)
    assert text == " ".join(STORY.split())


def test_teasers_after_the_story():
    teaser = "<article><h3><a href='x'>TEASER title</a></h3><p>TEASER text</p></article>"
    text = wrappers.extract(f"<main><article><h1>Title</h1><p>{STORY}</p></article>{teaser * 3}</main>", None)
    assert text == " ".join(f"Title {STORY}".split())
    listing = wrappers.extract(f"<main>{teaser * 3}</main>", None)
    assert listing.count("TEASER title") == 3  # a page of teasers alone keeps them


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_wrapper_decides_on_given_pages(spark, sf):
    """For every page the article is found through its host's wrapper."""
    path = f"/root/testdata/{sf}/pages.parquet"
    import pickle

    rules = {r.host: wrappers.decide(pickle.loads(r.wrapper)) for r in wrappers.infer_wrappers(spark.read.parquet(path)).collect()}
    pages = pq.read_table(path).to_pylist()
    found = [wrappers.extract_by(x["html"], rules[wrappers.host_of(x["url"])]) for x in pages]
    assert len(found) == len(pages) and all(by for _, by in found) and all(text for text, _ in found)


def _site(r, n):
    """A host without main or article elements: a story, menus and boilerplate in plain divs."""
    rows = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(r.choice('alpha beta gamma delta epsilon zeta'.split()) + str(r.randrange(10**6)) for _ in range(30))}</p>" for _ in range(r.randint(2, 9)))
        rows.append((i, f"https://site{i % 2}.example/{i}", f"<html><body><div><a href='/'>Home</a></div><div><div>Legal boilerplate that every page has</div><h1>Head {i}</h1>{body}</div><div><p>Printed on paper of our own</p></div></body></html>"))
    return rows


def test_result_does_not_depend_on_file_splits(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 4)  # several levels
    rows = _site(random.Random(4), 90)
    rows += [rows[0]] * 5  # copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = None
    for n in (1, 3, 16):
        got = sorted((r.page_id, r.text) for r in wrappers.extract_pages(df.repartition(n, "html") if n > 1 else df.coalesce(1)).collect())
        assert len(got) == len(rows) and all("Home" not in t and "Legal" not in t and "Printed" not in t and f"Head {i}" in t for i, t in got)
        wanted = wanted or got
        assert got == wanted
    assert {r.host: r.wrapper for r in wrappers.infer_wrappers(df.repartition(7)).collect()} == {r.host: r.wrapper for r in wrappers.infer_wrappers(df.repartition(2)).collect()}


def test_long_pages_teach_the_wrapper():
    """Pages of many thousand items are aligned too, by anchors; groups of any length fold."""
    row = "".join(f"<td class='{k}'>{{0}}-{k}</td>" for k in "bcdefghijklm")  # a group of 38 tokens
    long = lambda tag: "<div>Template text</div><h1>" + tag + "</h1>" + "".join(f"<tr>{row.format(f'{tag}{i}')}</tr><hr/><p>{tag} {i}</p>{'<h2>x</h2>' if i % 7 == 0 else ''}" for i in range(3000))
    items = lambda page, key: wrappers.fold(wrappers._items(*wrappers.read(page), key))
    began = time.time()
    a, b = items(long("a"), 1), items(long("b"), 2)
    whole = wrappers.align(a, b)
    assert time.time() - began < 60
    known = [t for x in whole for t in x[3]]
    assert any(x[1] and len(x[0]) > 37 for x in a) and known[0] is not None and len(whole) < 20_000


def test_opcodes_of_long_streams(monkeypatch):
    monkeypatch.setattr(wrappers, "AT_ONCE", 30)
    r = random.Random(9)
    for _ in range(300):
        a = [(r.choice("abcdefgh") + str(r.randrange(6)),) for _ in range(r.randint(0, 40))]
        b = [x for x in a if r.random() > 0.2]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), ("new",))
        i = j = 0
        for kind, i1, i2, j1, j2 in wrappers._opcodes(a, b):
            assert (i1, j1) == (i, j) and (kind != "equal" or a[i1:i2] == b[j1:j2])
            i, j = i2, j2
        assert (i, j) == (len(a), len(b))
