"""Main text of pages, license notices."""

import random
import re

import pytest

from piiscan.llm import html_extract as html
from piiscan.llm import license_scan as lic

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-banner">We use cookies to make it better for you and for all of us.</div>
<article><h1>On &lt;tags&gt; &amp; more</h1><p>The first   paragraph<br>of the text<p>It is short.
<aside>Related to the story of the year</aside><div id="comments"><p>I like it and the way that it was said by you</p></div></article>
<form><p>Sign up to the letter of the week</p></form><!-- gone --><footer>&copy; 2020 of the site</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE) == "On <tags> & more\nThe first paragraph of the text\nIt is short."


def test_two_passes_without_article():
    good = "It was the best of times and it was the worst of times, and that is how the story of the two begins. " * 3
    page = f"<div>Home | About</div><h2>A tale</h2><p>{good}</p><p>Yes.</p><p>{good}</p><div><a href=x>one</a> <a href=y>two</a></div><p>\xa9 all</p>"
    assert html.main_text(page) == "\n".join(["A tale", good.strip(), "Yes.", good.strip()])


@pytest.mark.parametrize("page", ["", "<", "<p", "plain", "<!-- open", "<script>x", "<nav>only", "</p></div>", "<a <b <c", "<p>" * 3000, "&#0;&bogus;"])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_pages_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<article><p>" + "word " * 50_000 + "</p></article>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r["page_id"], r["n_chars"]) for r in html.extract(frame).collect()}
    n = len(html.main_text(PAGE))
    assert out == {(1, n), (2, 0), (None, 0), (3, 249_999)}
    assert html.extract(frame.limit(0)).count() == 0


def brute_notices(line: str, scanner: lic.Scanner) -> set[tuple[str, int, int, int]]:
    """Notices found by bounded-error search over the whole line, without seeds."""
    places = set()
    for k, notice in enumerate(scanner.notices):
        for m in scanner.fuzzy[k].finditer(line, overlapped=True):
            places.add((k, m.start()))
    return {(scanner.notices[k].label, a, b, e) for k, a, b, e in scanner.notice_matches(line, places)}


def test_seeds_find_what_the_whole_search_finds():
    scanner, r = lic.Scanner(), random.Random(5)
    for _ in range(40):
        notice = r.choice(lic.NOTICES)
        text = list(notice.text)
        for _ in range(r.randint(0, notice.edits)):
            at = r.randrange(len(text))
            text[at] = r.choice(["", "q", text[at] + "z"])
        line = "lorem ipsum " + "".join(text) + " dolor sit amet"
        line = " ".join(line.split())
        _, places = scanner.candidates(line)
        got = {(scanner.notices[k].label, e) for k, _, _, e in scanner.notice_matches(line, places)}
        assert got == {(label, e) for label, _, _, e in brute_notices(line, scanner)}


def brute_phrases(text: str):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hits = []
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), hits


@pytest.mark.parametrize(
    "text",
    ["", "MIT License", "mit license mit license, MIT-LICENSE; summit license", "CC BY-NC 4.0 / cc  by", "é gnu GENERAL public\nlicense é", "İ mit licenseé", "apache licenses", "GNU General Public License " * 500],
)
def test_phrases(text):
    n, hits = lic.Scanner().scan(text)
    want_n, want = brute_phrases(text)
    assert n == want_n
    assert sorted((h["word"], h["label"]) for h in hits if h["method"] == "phrase") == sorted(want)
    for h in hits:
        assert 0 <= h["start"] < h["end"] <= len(text) and 0 < h["score"] <= 1


def test_typos_and_variants():
    labels = lambda t: {h["label"] for h in lic.Scanner().scan(t)[1]}
    assert labels("Licenced under tha Apache License, Version 2.0.") == {"apache", "apache-2.0"}
    assert "gpl-3.0" not in labels("GNU General Public License, version 2") and "gpl-2.0" in labels("GNU General Public License, version 2")
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-4.0"}
    assert labels("All rights reservd") == {"all-rights-reserved"}
    assert labels("the license of the house") == set()


def test_license_frame(spark, edge_docs):
    out = lic.summary(lic.scan_licenses(edge_docs)).collect()
    assert len(out) == edge_docs.count()
    for r in out:
        assert r["labels"] == "" and r["n_base"] == 0 and r["first_word"] is None and r["score"] == 0
    assert lic.summary(lic.scan_licenses(edge_docs.limit(0))).count() == 0
