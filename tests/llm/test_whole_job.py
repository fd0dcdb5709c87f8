"""Cases in which an operator once did less than the whole job."""

import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import components
from tests_data import prose

from tilewright.llm import html, mixing, neardup, urls


def test_neardup_pairs_in_large_regions(spark, monkeypatch):
    """Pairs just above the threshold, among many documents just below it; the names are such that all trees part them above REGION."""
    monkeypatch.setattr(neardup, "REGION", 8)
    base = prose(300, 70).split()

    def edited(words, n, name):
        words = list(words)
        for k in random.Random(name).sample(range(0, 300, 5), n):
            words[k] = f"{name}x{k}"
        return words

    rows = [(i, " ".join(edited(base, 3, f"g{i}"))) for i in range(120)]
    for i in (1779, 2301, 2453):
        one = edited(base, 3, f"a{i}")
        rows += [(1000 + i, " ".join(one)), (2000 + i, " ".join(edited(one, 4, f"b{i}")))]
    want = components(rows)
    assert all(want[2000 + i][0] == 1000 + i for i in (1779, 2301, 2453))
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.component_id, x.n_shingles) for x in got} == want


def test_neardup_keeps_one_row_of_each_group(spark):
    """Rows of one id with different texts, rows without an id, repeated rows, and rows without words."""
    a, b, near = prose(60, 80), prose(60, 81), prose(60, 80) + " tail"
    rows = [(1, a, "x"), (1, near, "x"), (1, b, "x"), (2, a, "x"), (None, near, "x"), (None, prose(60, 82), "x"), (None, prose(60, 82), "x"), (3, b, "y"), (3, b, "y"), (4, None, "x"), (4, "", "x"), (4, "", "x"), (5, prose(60, 83), "z"), (5, prose(60, 83), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k_id string")
    got = neardup.deduplicated(docs).collect()
    one = [r for r in got if r.text in (a, near)]
    assert len(one) == 1 and one[0].doc_id == 1
    assert [r.doc_id for r in got if r.text == b] == [1]
    assert sum(r.text == prose(60, 82) for r in got) == 1 == sum(r.text == prose(60, 83) for r in got)
    assert sum(not r.text for r in got) == 3 and len(got) == 7 and got[0].asDict().keys() == {"doc_id", "text", "_k_id"}
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def test_raking_on_spark_ends_by_the_same_rule(spark):
    """Correlated margins need more than a dozen rounds."""
    rows = [("a", "x", "t", 400), ("a", "y", "t", 60), ("b", "x", "t", 60), ("b", "y", "t", 400), ("b", "y", "u", 30)]
    cells = spark.createDataFrame(rows, "_m_source string, _m_lang string, _m_topic string, tokens long")
    given = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.3, "y": 0.7}}
    tokens = {r[:3]: r[3] for r in rows}
    found = [{tuple(r)[:3]: r.weight for r in mixing.cell_weights(cells, given, max_cells=n).collect()} for n in (100, 0)]
    for w in found:
        whole = sum(tokens[k] * v for k, v in w.items())
        assert abs(sum(tokens[k] * v for k, v in w.items() if k[0] == "a") / whole - 0.7) < 1e-9
    assert all(abs(found[0][k] - found[1][k]) < 1e-8 for k in tokens)


def test_raking_warns_of_targets_out_of_reach():
    with pytest.warns(RuntimeWarning, match="off their targets"):
        mixing.rake([("a", "x"), ("b", "y")], np.array([1.0, 1.0]), [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}])


def test_html_keeps_every_part_of_the_body():
    long, short = "many words of the long part " * 12, "words of the short part " * 4
    menu = "<div><a href=1>Home</a> <a href=2>News</a></div>"
    two = f"<body>{menu}<section><p>{long}</p><p>{long}</p></section><section><p>{short}</p><p>{short}</p></section></body>"
    assert html.main_text(two).endswith(" ".join([*long.split(), *long.split(), *short.split(), *short.split()]))
    quote = f"<body><div><p>{short}</p><blockquote><p>{long}</p><p>{long}</p></blockquote><p>{short}</p></div></body>"
    assert html.main_text(quote) == " ".join([*short.split(), *long.split(), *long.split(), *short.split()])
    articles = f"<article><p>{long}</p><p>{long}</p></article>" + "<p><a href=3>x</a></p>" * 12 + "<article><p>Brief.</p></article>"
    assert html.main_text(articles) == " ".join([*long.split(), *long.split(), "Brief."])


def test_html_takes_any_markup_at_a_cost_like_its_length():
    start = time.monotonic()
    cases = {
        "<![x[a]]> text": "text", "<a " * 20_000 + "end": None, "<!--" * 40_000: "", "<" * 100_000: "<" * 100_000, '<a b="' * 40_001 + ">": "", "<div>" * 20_000 + "x": "x", "<script>" * 30_000: "",
        "</" * 50_000: "", "<form><article>" * 20_000 + "x": "x", "<a b='>" * 30_000 + "x": None, "<p>a<!-->b<!-- c --> d": "ab d", "<p>1 < 2 <3": "1 < 2 <3", "<!DOCTYPE x [<!ENTITY y>]><p>z": None,
    }
    for page, want in cases.items():
        got = html.main_text(page)
        assert want is None or got == want
    assert time.monotonic() - start < 30


def test_html_ratios_choose_the_region(monkeypatch):
    """A page without any element or class that tells of content: the ratios decide, and with every line taken for content the result is another."""
    menu = "<div>" + "".join(f"<span><a href={k}>item {k}</a></span><br>" for k in range(9)) + "</div>"
    body = "<div><h2>Head</h2>" + "<p>" + "many words of the long part " * 9 + "</p><p>Brief.</p>" + "<p>" + "more words of another part " * 9 + "</p></div>"
    page = f"<body>{menu}{body}<div><small>rights</small><br><small>imprint</small></div></body>"
    want = " ".join(["Head", *("many words of the long part " * 9).split(), "Brief.", *("more words of another part " * 9).split()])
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "margins", lambda r: np.ones(len(r)))
    assert html.main_text(page) != want


def test_html_ratios_alone_find_most_of_the_given_texts(spark, sf):
    """Elements and class names that tell of content or none are taken out of the given pages."""
    found = n = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = re.sub(r"<(/?)(article|nav|footer|aside|header|form|main|section)\b", r"<\1div", re.sub(r'\sclass="[^"]*"', "", r.html))
        found += html.main_text(bare, hints=False) == html.main_text(r.html)
        n += 1
    assert found >= 0.9 * n


def test_urls_relative_targets(spark):
    rows = [
        (1, "http://a.net/d/e/1", '<link rel="canonical" href="/p">', "a.net/p"), (2, "https://a.net/d/e/2", '<link rel=canonical href="//Host.net/p2">', "host.net/p2"),
        (3, "http://a.net/d/e/3", '<meta http-equiv=refresh content="0;url=../b?x=1&amp;y=2">', "a.net/d/b?x=1&y=2"), (4, "http://a.net/d/e/4", "<link href='c.html' rel=canonical>", "a.net/d/e/c"),
        (5, "http://a.net/5?old=1", '<link rel="canonical" href="?q=1">', "a.net/5?q=1"), (6, "http://a.net", '<link rel="canonical" href="x&#47;y&#x2f;./z">', "a.net/x/y/z"),
        (7, "http://a.net/7", '<base href="/far/"><link rel="canonical" href="z">', "a.net/far/z"), (8, "http://a.net/8", '<link rel="canonical" href="mailto:x@a.net">', None),
        (9, "http://a.net/9", """<meta content="3; URL='/it&amp;amp;s'" http-equiv="refresh">""", "a.net/it&amp;s"), (10, "http://a.net/10", '<link rel="canonical" href="http://a.net/u/../v">', "a.net/v"),
        (11, "http://a.net/11", '<link rel="canonical" href="">', None), (12, "no url", '<link rel="canonical" href="/p">', None), (13, "http://a.net/13?x", '<link rel="canonical" href="../../w">', "a.net/w"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {(r.a, r.b) for r in urls.alias_edges(pages).collect()}
    plain = {r.page_id: r.p for r in pages.select("page_id", urls.plain_form(pages["url"]).alias("p")).collect()}
    assert got == {(plain[r[0]], r[3]) for r in rows if r[3]} | {(r[1], plain[r[0]]) for r in rows if plain[r[0]]}
    more = [(1, "http://c.example.org/es/1", '<link rel="canonical" href="/moved?a=1&amp;b=2">'), (2, "http://c.example.org/moved?b=2&a=1", None)]
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame(more, "page_id long, url string, html string"), {"example.org/es/": "block"}).collect()}
    assert out[1].alias == out[2].alias and out[2].verdict == "block"
