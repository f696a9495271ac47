from __future__ import annotations

import html
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from lamina.llm import pagediff, queries


def test_pages_give_their_article(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op5_page_differencing(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def page(*lines):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_shared_lines_of_neighbours_go(spark):
    rows = [(1, "http://h/a/1", page("Menu", "first story", "Imprint")), (2, "http://h/a/2", page("Menu", "second story", "Imprint")), (3, "http://other/x", page("Menu", "third story"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pagediff.extract_pages(df).collect()} == {1: "first story", 2: "second story", 3: "Menu third story"}


def test_articles_are_guarded_and_copies_are_no_neighbours(spark):
    same = page("only", "lines")
    rows = [(1, "http://h/1", "<article><p>shared</p></article>"), (2, "http://h/2", "<article><p>shared</p><p>more</p></article>"), (3, "http://k/1", same), (4, "http://k/2", same), (4, "http://k/2", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in pagediff.extract_pages(df).collect())
    assert got == [(1, "shared"), (2, "shared more"), (3, "only lines"), (4, "only lines"), (4, "only lines")]


def brute_text(rows, near=pagediff.NEAR):
    """Texts by page, all pages in one place: plain tables for alignment."""
    read = {k: pagediff.blocks(html or "") for k, (_, _, html) in enumerate(rows)}
    of = lambda url: re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*))?([^?#]*)", url or "")
    places = {}
    for k, (_, url, _) in enumerate(rows):
        lines = tuple(t for t, _ in read[k])
        if lines and not any(g for _, g in read[k]):
            key = ((of(url)[1] or "").lower(), lines)
            places[key] = min(places.get(key, (of(url)[2], url or "")), (of(url)[2], url or ""))
    order = sorted(places, key=lambda key: (key[0], *places[key]))

    def shared(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0], {x for x in a if x in b}

    def close(a, b, near):
        return a[0] == b[0] and sum(map(len, shared(a[1], b[1])[1])) >= near * max(sum(map(len, a[1])), sum(map(len, b[1])))

    out = []
    for k, (page_id, url, _) in enumerate(rows):
        inside = [t for t, g in read[k] if g]
        lines = tuple(t for t, _ in read[k])
        key = ((of(url)[1] or "").lower(), lines)
        if inside or key not in places:
            out.append((page_id, " ".join(inside)))
            continue
        at, gone = order.index(key), set()
        for side in (-1, 1):
            k = at
            while 0 <= k + side < len(order) and close(order[k], order[k + side], near):
                k += side  # on to the end of the run
            other = order[k + side] if 0 <= k + side < len(order) else ("", ())
            if other[0] == key[0] and not close(key, other, near):
                gone |= shared(lines, other[1])[1]
        out.append((page_id, " ".join(t for t in lines if t not in gone)))
    return sorted(out, key=str)


def unwrapped(html):
    """A page without its article element, with the furniture as plain paragraphs of a template."""
    inner = re.sub(r"</?article[^>]*>", "", html or "")
    return re.sub(r"<body>", "<body><p>Home</p><p>All topics of this site</p>", re.sub(r"</body>|$", "<p>Imprint and terms</p>", inner, count=1), count=1)


def test_differencing_decides_on_pages_without_an_article(spark, sf):
    rows = [(r.page_id, r.url, unwrapped(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (3, 2000):
        got = sorted(((r.page_id, r.text) for r in pagediff.extract_pages(df, group=group).collect()), key=str)
        assert got == brute_text(rows)
    hosts = [re.match(r"[a-z]+://([^/?#]*)", r[1])[1].lower() for r in rows]
    alone = {r[0] for r, h in zip(rows, hosts, strict=True) if hosts.count(h) == 1}
    assert all(("Imprint and terms" in t) == (i in alone) for i, t in got if t)


def test_a_hot_host_is_compared_in_url_order(spark):
    rows = [(k, f"http://h/index.php?id={k:04}", page("Menu", f"section {k // 50}", f"story {k}")) for k in range(300)]
    rows += [(1000 + k, f"http://h/index.php?id={k:04}&again", page("Menu", f"section {k // 50}", f"story {k}")) for k in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (7, 64, 2000):
        got = {r.page_id: r.text for r in pagediff.extract_pages(df, group=group).collect()}
        assert got == {i: f"story {i % 1000}" for i, _, _ in rows}


def test_near_copies_keep_their_body(spark):
    body = [f"a long paragraph number {k} that is the body of both pages and no template" for k in range(6)]
    rows = [(1, "http://h/a", page("Menu", *body, "first end")), (2, "http://h/b", page("Menu", *body, "second end")), (3, "http://h/c", page("Menu", "another story that is quite different"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pagediff.extract_pages(df).collect()}
    assert got == {1: " ".join([*body, "first end"]), 2: " ".join([*body, "second end"]), 3: "another story that is quite different"}


def test_runs_of_near_copies_of_any_length(spark):
    body = [f"a long paragraph number {k} that is the body of many pages and no template" for k in range(6)]
    rows = [(k, f"http://h/{k:03}", page("Site name", *body, f"end {k}")) for k in range(40)]
    rows += [(100, "http://h/100", page("Site name", "another story that is quite different")), (101, "http://g/1", page("Site name", "alone"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = {k: " ".join([*body, f"end {k}"]) for k in range(40)} | {100: "another story that is quite different", 101: "Site name alone"}
    for group in (1, 3, 11, 2000):  # runs over many tasks, over few, within one
        assert {r.page_id: r.text for r in pagediff.extract_pages(df, group=group).collect()} == wanted
    assert dict(brute_text(rows)) == wanted


def test_names_in_an_article():
    kept = [f'<p class="{c}">x</p>' for c in ("side", "banner", "menu", "ad-hoc")] + [f'<div class="{c}">x</div>' for c in ("header", "comment", "footer", "side", "market-share", "adverse")]
    gone = [f'<div class="{c}">x</div>' for c in ("ad-slot", "advert-box", "sponsored-content", "share-buttons", "social-links", "related-posts", "newsletter-signup", "cookie-banner", "comments-section", "ad", "share", "user-comments", "site-footer")]
    gone += ["<svg><title>x</title></svg>", "<label>x</label>", '<ul class="related-links"><li>x</li></ul>', "<fieldset><p>x</p></fieldset>"]
    for html in kept:
        assert pagediff.blocks(f"<article>{html}</article>") == [("x", True)], html
    for html in gone:
        assert pagediff.blocks(f"<article><p>a</p>{html}<p>b</p></article>") == [("a", True), ("b", True)], html


def test_names_count_whole_in_an_article():
    inside = '<article><p class="side-effects">one</p><div class="market-share">two</div><div class="share">x</div><div hidden>three</div><p style="display:none" class="y">four</p><math><mi>a</mi><mo>+</mo><mi>b</mi></math></article>'
    assert [t for t, _ in pagediff.blocks(inside)] == ["one", "two", "three", "four", "a+b"]
    outside = '<div id="main-menu-recipes"><p>one</p></div><div class="cookie-notice">x</div><div class="site-footer">y</div><div class="x" hidden>two</div><p hidden>three</p>'
    assert [t for t, _ in pagediff.blocks(outside)] == ["one", "two", "three"]


def test_long_and_deep_pages_take_linear_time():
    import time

    def seconds(text):
        began = time.process_time()
        pagediff.blocks(text)
        return time.process_time() - began

    made = [lambda n: '<a "' * n, lambda n: '<a "' * n + ">", lambda n: "<a '\">" * n + "'", lambda n: "<div>" * n + "</p>" * n, lambda n: "<" * n, lambda n: "<script>" * n, lambda n: "<!-- " * n, lambda n: "<p>x</p>" * n, lambda n: "</script " * n]
    for make in made:
        assert seconds(make(100_000)) < 4.0


def test_nulls_empty_table_and_clashes(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, None), (2, "no url", ""), (None, "http://h/", "<p>x &amp; &#233;&nbsp;y</p>"), (4, "http://h/", "<" * 50 + "a" * 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("row", "host", "path", "text", "lines", "gone")})
    got = {r.page_id: r.text for r in pagediff.extract_pages(df).collect()}
    assert got[1] == "" and got[2] == "" and got[None] == "x & é y"
    assert pagediff.extract_pages(df.limit(0)).collect() == []


def test_furniture():
    text = """<!DOCTYPE html><title>t</title><header><h1>Site</h1></header><nav>a</nav><div class="cookie-notice">c</div><!-- <p>x</p> -->
    <main><header><h1>Head</h1></header><p>one<br>two <b>bo</b>ld</p><form>f</form><aside>s</aside><script>if (a < b) "</p>"</script><p>three</main>
    <section id="comments"><article class="comment">hi</article></section><footer>f</footer>"""
    assert [t for t, inside in pagediff.blocks(text) if inside] == ["Head", "one", "two bold", "three"]


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    mask = pagediff.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
    kept, rest = [x for x, k in zip(a, mask, strict=True) if k], iter(b)
    assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def article(before, after, *lines):
    body = "".join(f"<p>{x}</p>" for x in lines)
    return f"<html><body>{before}<article>{body}</article>{after}</body></html>"


def test_pages_with_an_article_are_compared_too(spark):
    share, own = '<a href="/f">Share</a> | <a href="/m">Mail</a>', lambda k: f'<a href="/{k}">source {k}</a>'
    rows = [(k, f"http://h/{k}", article("<p>Menu</p>", "<p>Imprint</p>", f"story {k} " * 9, "a sentence of all articles", share, own(k), 'with a <a href="/x">link</a>')) for k in range(5)]
    # its neighbours are pages with an article
    rows.append((9, "http://h/2x", page("Menu", "a page without an article but with a text of its own", "Imprint")))
    rows.append((10, "http://alone/", article("", "", "story", share)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = {k: f"story {k} " * 9 + f"a sentence of all articles source {k} with a link" for k in range(5)} | {9: "a page without an article but with a text of its own", 10: "story Share | Mail"}
    for group in (1, 3, 2000):
        assert {r.page_id: r.text for r in pagediff.extract_pages(df, group=group).collect()} == wanted


def test_blocks_of_links_alone():
    inside = '<article><p><a>one</a> &middot; <a>two</a></p><p>see <a>three</a></p><p><a>four</a> too</p><p>&mdash;</p><p><a><b>five</b></a></p><p>six</p></article>'
    assert [(t, k) for t, _, k in pagediff.linked_blocks(inside)] == [("one · two", True), ("see three", False), ("four too", False), ("—", False), ("five", True), ("six", False)]
