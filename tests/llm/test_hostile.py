"""Texts and pages that are made to break the operators, and pages in layouts that no list of the operators holds."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import html_extract, minhash_dedup, substring_dedup, words

SCHEMA = "doc_id long, text string"


def thue_morse(n, zero, one):
    return "".join(zero if k.bit_count() % 2 == 0 else one for k in range(n))


def test_words_that_a_polynomial_takes_for_equal(spark):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rest = " ".join(f"w{i}" for i in range(39))
    docs = spark.createDataFrame([(1, f"{a} {rest[:59]}"), (2, f"{b} {rest[:59]}"), (3, f"{rest[:59]} {a} " + rest[59:]), (4, f"{rest[:59]} {b} " + rest[59:])], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, window=35).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    short = spark.createDataFrame([(1, f"x y z {a}"), (2, f"x y z {b}"), (3, f"{a} {b}"), (4, f"{b} {a}")], SCHEMA)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(short).collect()} == {k: k for k in (1, 2, 3, 4)}


def test_word_names_tell_words_apart():
    rng = random.Random(1)
    known = {"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 140))) for _ in range(4000)} | {"a" * k for k in range(1, 200)} | {"a" + "\x00" * k for k in range(100)}
    known = sorted(known)
    key = words.Key(words.fresh_key())
    one, first = words.word_hashes(pa.array([" ".join(known)]), key)
    assert len(one) == len(known) == first[-1] and len(np.unique(one)) == len(known)
    order = rng.sample(range(len(known)), len(known))
    other, _ = words.word_hashes(pa.array(["\t" + known[k] + " \n" for k in order]), key)
    assert (other == one[order]).all()
    assert (words.word_hashes(pa.array(["aBÉ"]), key, lower=True)[0] == words.word_hashes(pa.array(["abÉ"]), key)[0]).all()


def test_rolling_names_follow_all_their_words():
    rng = np.random.default_rng(2)
    key = words.Key(5)
    for width in (1, 2, 5, 8, 9, 14, 35, 64, 65, 130):
        own = rng.integers(0, 1 << 64, 300, np.uint64)
        names = words.rolling(own, width, key)
        assert len(names) == 301 - width and len(np.unique(names)) == len(names)
        twice = words.rolling(np.concatenate([own[:width], own]), width, key)
        assert twice[0] == twice[width] == names[0]
        for k in range(width):
            other = own.copy()
            other[k] ^= np.uint64(1 << 63)
            assert words.rolling(other, width, key)[0] != names[0], (width, k)
        assert (words.rolling(own, width, key, lane=1) != names).all()


def test_repeats_with_long_runs_and_a_long_text(spark):
    rng = random.Random(3)
    passage = [f"p{rng.randrange(50)}" for _ in range(60)]
    long_text = [f"u{i}" for i in range(200_000)]
    long_text[150_000:150_060] = passage
    rows = [(1, " ".join(long_text)), (2, "z " * 5000), (3, "q " + " ".join(passage) + " q"), (4, "a b " * 1000 + "c"), (5, "z " * 20)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (200_000, 60), 2: (5000, 5000), 3: (62, 60), 4: (2001, 2000), 5: (20, 0)}


@pytest.mark.parametrize(
    ("page", "found"),
    [
        ("<p title=\"it's>hello", ["hello"]),
        ("<footer class='x>menu", ["menu"]),
        ("<p>cut <a href='", ["cut"]),
        ("a < b <p don't>x</p> 3<4 <!-- c", ["a < b", "x", "3<4"]),
        ('<a href="x>y">z</a>', ["z"]),
        ('<p class="a>one</p><p class="b">two</p>', ["one", "two"]),
        ("<p>a</i></b>c<div>d</p>e", ["ac", "d", "e"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<td>a<td>b<tr>c</table></div></div>d", ["a", "b", "c", "d"]),
        ("<p/>x<br/>y<img src=a alt='>'>z", ["x yz"]),
        ("<SCRIPT>if (a</b) '</p>'</SCRIPT >t<style>x", ["t"]),
        ("<p>&amp;&#x41;&bogus;&nbsp;é</p>", ["&A&bogus; é"]),
    ],
)
def test_broken_markup(page, found):
    assert [b[0] for b in html_extract.blocks(page)] == found


@pytest.mark.parametrize(
    "page",
    ["<a '" * 250_000, '<p a="' * 160_000, "<p a=\"x' b='>" * 90_000, "<div>" * 200_000 + "x", "<b>" * 100_000 + "<p>t</p>" * 90_000, "<b>" * 100_000 + "</i>" * 150_000]
    + ["<b><i>" * 90_000 + "</b>" * 90_000, "<script>" + "</script" * 120_000, "<" * 1_000_000, "<!--" * 250_000, "<div>t" * 160_000, "&" * 1_000_000, "<li><td>" * 120_000],
    ids=range(13),
)
def test_a_page_takes_linear_time(page):
    began = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - began < 6


def prose(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(14, 40))).capitalize() + "." for _ in range(n)]


WORDS = "the river was quiet when we left and nobody had asked about old maps which hung beside a door that led into further rooms of stone".split()
LINKS = "<a href=/a>Alpha</a> <a href=/b>Beta</a> <a href=/c>Gamma</a>"
#: Layouts labelled by hand: {} is the text's paragraphs, all else is not the article. No class or id stands in a list of the operator.
LAYOUTS = {
    "plain divs": ("<div class=k1><a href=/>Start</a> <a href=/x>Topics</a></div><div class=zzz>{p}</div><div class=k9>Copyright 2021 Example Ltd.</div>", "<p>{}</p>"),
    "hashed names": ("<div class=css-1ab><ul><li><a href=/>Uno</a><li><a href=/>Dos</a></ul></div><div class=css-7xy><div class=css-9q>{p}</div></div><div class=css-0>All rights reserved.</div>", "<p>{}</p>"),
    "tables": ("<table><tr><td class=l1>" + LINKS + "</td><td class=l2>{p}</td></tr></table><p class=l3><small>Imprint</small></p>", "<p>{}</p>"),
    "sections": ("<nav>" + LINKS + "</nav><section class=feuille>{p}</section><footer>Contact us</footer>", "<p>{}</p>"),
    "no paragraphs": ("<header><h2>Gazette</h2></header><div id=zone2>{p}</div><form><label>Mail</label><button>Send</button></form>", "<div>{}</div>"),
    "deep": ("<div class=q><div class=r><ul class=s><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul></div><div class=t><div class=u><div class=v>{p}</div></div></div></div>", "<p>{}</p>"),
    "article alone": ("<ul><li><a href=/>One</a></li></ul><article>{p}</article><aside>" + LINKS + "</aside>", "<p>{}</p>"),
    "quotes": ("<div class=aa>" + LINKS + "</div><div class=bb>{p}</div>", "<blockquote><p>{}</p></blockquote>"),
}


def test_layouts_with_names_of_no_list(spark, sf_dir):
    """Figures in the README: paragraphs kept, and other blocks that come with them."""
    net = html_extract.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rng = random.Random(6)
    kept, leaked, total, others = {}, {}, 0, 0
    for name, (page, wrap) in LAYOUTS.items():
        for _ in range(5):
            own = prose(rng, 8)
            found = html_extract.blocks("<html><body>" + page.replace("{p}", "".join(wrap.format(x) for x in own)))
            out = [b[0] for b, s in zip(found, html_extract.label(net, [found])[0], strict=True) if s > 0.5]
            kept[name] = kept.get(name, 0) + sum(x in out for x in own)
            leaked[name] = leaked.get(name, 0) + sum(x not in own for x in out)
            total, others = total + len(own), others + len(found) - len(own)
    print(kept, leaked, total, others)
    assert sum(kept.values()) >= 0.9 * total, kept
    assert sum(leaked.values()) <= 0.1 * others, leaked


def contract_pages(rng):
    """Name, page, and its article's blocks: what the contract says of adverts, links, tables, code, headings and comments."""
    own = prose(rng, 8)
    wrapped = [f"<p>{x}</p>" for x in own]
    nav, foot = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>", "<footer>&copy; 2021 Example Ltd.</footer>"
    ads = [f"<div class=ad>{x}</div>" for x in prose(rng, 2)]
    yield "adverts", nav + "<article>" + "".join(wrapped[:3]) + ads[0] + "".join(wrapped[3:]) + ads[1] + "</article>" + foot, own
    yield "linked paragraphs", nav + "<article>" + "".join(f"<p><a href=/x>{x}</a></p>" for x in own) + "</article>" + foot, own
    cells = ["12", "beta", "7", "alpha", "x 3", "2021", "gamma", "5 km"]
    rows = "".join(f"<td>{c}</td>" for c in cells[:4]) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in cells[4:])
    yield "table and code", nav + "<article>" + "".join(wrapped[:4]) + f"<table><tr>{rows}</tr></table><pre><code>for k in x: print(k)</code></pre>" + "".join(wrapped[4:]) + "</article>" + foot, [*own, *cells, "for k in x: print(k)"]
    yield "heading in a div", nav + "<div class=q7><div class=z1><h2>Overview</h2></div>" + "".join(wrapped) + "</div>" + foot, ["Overview", *own]
    said = prose(rng, 5)
    yield "comments", nav + "<article>" + "".join(wrapped) + "</article><div class=k22>" + "".join(f"<div><b>{n}</b><p>{c}</p></div>" for n, c in zip("Ann Bob Cid Dan Eve".split(), said, strict=True)) + "</div>" + foot, own
    yield "bare comments", nav + "<article>" + "".join(wrapped) + "</article><div class=k22>" + "".join(f"<p>{c}</p>" for c in said) + "</div>" + foot, own


def test_what_the_contract_says_of_adverts_links_tables_and_comments(spark):
    """On layouts where the teacher is wrong or silent; figures in the README."""
    net = html_extract.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    rng, figures = random.Random(10), {}
    for _ in range(8):
        for name, page, own in contract_pages(rng):
            found = html_extract.blocks("<html><body>" + page)
            out = [b[0] for b, s in zip(found, html_extract.label(net, [found])[0], strict=True) if s > 0.5]
            kept, total, leaked, others = figures.get(name, (0, 0, 0, 0))
            figures[name] = (kept + sum(x in out for x in own), total + len(own), leaked + sum(x not in own for x in out), others + len(found) - len(own))
    print(figures)
    for name, (kept, total, leaked, others) in figures.items():
        assert kept >= 0.95 * total and leaked <= 0.05 * others, (name, figures[name])


def test_the_sample_is_bounded(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), F.repeat(F.lit("word "), 40_000), F.lit("</article>")).alias("html"))
    seen = []
    was, html_extract.train = html_extract.train, lambda pages: seen.extend(pages)
    try:
        html_extract.fit(pages.union(pages), sample=20, longest=1000)
        html_extract.fit(pages.where("false"), sample=20)
        small = spark.createDataFrame([(99, "u", "<article>a"), (99, "u", "<article>a"), (None, "u", "<article>b"), (98, "u", None)], "page_id long, url string, html string")
        html_extract.fit(pages.union(small), sample=3, longest=1000)
    finally:
        html_extract.train = was
    assert 10 <= len(seen[:-2]) <= 23 and {len(x) for x in seen[:10]} == {1000} and {"<article>a", "<article>b"} <= set(seen)
