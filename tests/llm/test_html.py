"""Template removal against counts made here, and the cases that the docstring defines."""

from __future__ import annotations

import random
import time
from collections import defaultdict

from lodestrata.llm import html

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def site(host: str, n: int, seed: int, own: bool) -> list[tuple]:
    """Pages without any name that tells what an element is: a frame that the host repeats, and blocks that pages have alone."""
    r = random.Random(seed)
    said = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(k))
    top, side, low = said(8), said(6), said(9)
    out = []
    for i in range(n):
        words = [said(r.randint(5, 30)) for _ in range(3)]
        frame = (f"<div><span>{top}</span></div>", f"<section><p>{side}</p><p>{side}</p></section><div>{low}</div>") if own else ("", "")
        body = "".join(f"<p>{w}</p>" for w in words)
        out.append((seed * 1000 + i, f"http://{host}/{i}", f"<html><body>{frame[0]}<div>{body}</div>{frame[1]}</body></html>", "\n\n".join(words)))
    return out


def test_only_counts_tell_the_template(spark):
    pages = site("a.example", 12, 1, True) + site("b.example", 3, 2, True) + site("c.example", 2, 3, True) + site("d.example", 9, 4, False)
    df = spark.createDataFrame([(p, u, h, "clash", 1) for p, u, h, _ in pages], SCHEMA).repartition(5)
    got = {r["page_id"]: r["__main"] for r in html.extract_main_text(df).collect()}
    for p, url, source, want in pages:
        assert (got[p] == want) == ("c.example" not in url)  # two pages do not tell a template
        assert want in got[p]
    assert any(html.extract(source) != want for _, _, source, want in pages)


def test_template_by_brute_force(spark):
    """Each page's template is what occurs on enough different pages of its host."""
    r = random.Random(9)
    blocks = [f"<div><i>block {k}</i></div>" for k in range(12)] + [f"<p>paragraph {k}</p>" for k in range(6)]
    pages = []
    for i in range(90):
        few = r.sample(blocks, r.randint(0, 5))
        inner = "".join(x for x in few[:2])
        pages.append((i, f"https://user@H{i % 4}.Example:80/{i % 7}", f"<body>{''.join(few)}<article><h1>t{i if i % 9 else 0}</h1>{inner}</article></body>"))
    pages += pages[:10]
    bodies, on = defaultdict(set), defaultdict(set)
    for _, url, source in pages:
        host = url.split("@")[1].split(":")[0].lower()
        mark, trees = html.subtrees(source)
        bodies[host].add(mark)
        for t in trees:
            on[host, t].add(mark)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((x["page_id"], x["__main"]) for x in html.extract_main_text(df).collect())
    want = []
    for p, url, source in pages:
        host = url.split("@")[1].split(":")[0].lower()
        often = lambda t: len(on[host, t]) >= (html.MIN_INNER if t & 1 else html.MIN_PAGES) and len(on[host, t]) >= html.MIN_SHARE * len(bodies[host])  # noqa: B023, E731
        want.append((p, html.extract(source, frozenset(t for t in html.subtrees(source)[1] if often(t)))))
    assert got == sorted(want)


def test_all_parts_of_an_article_stay():
    two = "<main><article><h1>One</h1><p>first part</p></article><article><p>second part</p></article><article><a href=x>See also this</a></article></main>"
    assert html.extract(two) == "One\n\nfirst part\n\nsecond part\n\nSee also this"
    assert html.extract("<article><a href=x>only a link</a></article>") == "only a link"
    assert html.extract("<main><p>a</p></main><p>b</p><main><p>c</p></main>") == "a\n\nc"
    assert html.extract("<article><p>a</p><article class=comment><p>b</p></article></article>") == "a"


def test_deep_and_long_pages_take_linear_time():
    took = []
    for n in (2000, 16_000):
        page = "<body>" + "<div>" * n + "<p>deep" + "</i>" * n + "<li>x" * n + "</div>" * n
        began = time.perf_counter()
        assert html.extract(page).startswith("deep") and html.subtrees(page)[1] is not None
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def test_html_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert html.extract_main_text(empty).count() == 0 and html.extract_main_text(empty).columns == ["page_id", "url", "text", "n_chars", "__main"]
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(1, "http://x.example", long, "t", 1)] * 3 + [(None, None, None, None, None), (2, None, "<p>&eacute;&#x41;&nbsp;b</p>", "t", 2)]
    got = sorted(((r["page_id"] or 0, r["text"], r["__main"]) for r in html.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, "t", "\n\n".join(["word"] * 30_000))] * 3 + [(0, None, ""), (2, "t", "éA b")], key=str)


def test_syndicated_story():
    """One story at three addresses, in a container or in parts, with different boxes beside it and no article element: it stays."""
    story = [f"<div>Paragraph {k} of a story that three addresses of one host share, long enough to be its running text.</div>" for k in range(6)]
    nav = "<div><a href='/'>home</a> <a href='/x'>all the other pages of this host</a></div>"
    for body in ("<div>" + "".join(story) + "</div>", "".join(story)):
        pages = [f"<html><body>{nav}<div><a href='/{k}'>related {k}</a></div>{body}<p>see {k}</p></body></html>" for k in range(3)]
        keys = [html.subtrees(x)[1] for x in pages]
        template = frozenset(set(keys[0]) & set(keys[1]) & set(keys[2]))
        for k, page in enumerate(pages):
            text = html.extract(page, template)
            assert all(f"Paragraph {i} of a story" in text for i in range(6)) and f"see {k}" in text
            assert "all the other pages" not in text


def test_all_articles_stay():
    """An article that is mostly links is one too."""
    page = "<body><article><p>The first of two articles.</p></article><article><p><a href='/'>A list of links</a> more</p></article></body>"
    assert html.extract(page) == "The first of two articles.\n\nA list of links more"
