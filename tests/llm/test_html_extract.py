"""HTML extraction: markup rules, differencing against brute force, edge cases."""

import random

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import html_extract as H


def kept(html):
    return "\n".join(t for t, s in H.read_page(html) if s == H.KEEP)


def test_markup_rules():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
            "<header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class='ad'>Buy</div>"
            "<article><header><h1>Title &amp;amp; more</h1><p>by line</p></header><p><b>One\n two<br>three<p>Four &lt;b&gt;"
            "<div class='post-comments'><article class='comment'><p>Nice!</p></article></div>"
            "<form><p>Mail</p></form><ul><li>a <i>b</i></li><li>c</li></ul><table><tr><td>x<td>y</tr></table></article>"
            "<aside>More</aside><footer>&copy; me")
    assert kept(page) == "Title &amp; more\nOne two three\nFour <b>\na b\nc\nx y"


def test_wrappers_of_an_article_drop_nothing():
    """A compound class name, or a form, around an article says nothing about it."""
    article = "<article><h1>T</h1><p>One</p><p>Two</p></article>"
    for wrap in ("<form id=aspnetForm>{}</form>", "<div class='layout with-sidebar'>{}</div>", "<div class='content no-comments'>{}</div>",
                 "<div id='nav-and-main'>{}</div>", "<main class='with-sidebar'>{}</main>",
                 "<main><div class='has-sidebar'>{}</div></main>"):
        assert kept("<body>" + wrap.format(article) + "<div class='side'>S</div>") == "T\nOne\nTwo", wrap
    assert kept("<article class='post has-comments'><p>One</p></article>") == "One"
    for comments in ("<div class='comments'><article><p>No</p></article></div>", "<article class='comment'><p>No</p></article>"):
        assert kept("<article><p>One</p></article>" + comments) == "One"
    assert kept("<article><p>One</p><div class='comment-list'><p>No</p></div><div class=ad-slot>Buy</div></article>") == "One"


def test_open_blocks_of_articles(spark):
    """Blocks of an article outside its paragraphs, or under a compound name, go where the neighbour has them too."""
    page = ("<article><p>Shared sentence.</p><p>Own {0}</p><section class='related-work'><h2>Related work</h2><p>Work {0}</p></section>"
            "<div class='share-buttons'>Share this</div><div>Loose {0}</div><div>Follow us</div></article>").format
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: f"Shared sentence.\nOwn {i}\nWork {i}\nLoose {i}" for i in range(1, 6)}
    one = {r["page_id"]: r["text"] for r in H.extract(df.limit(1)).collect()}  # no neighbour: nothing is the site's
    assert one == {1: "Shared sentence.\nOwn 1\nRelated work\nWork 1\nShare this\nLoose 1\nFollow us"}
    assert {i: t for i, t in enumerate(brute(rows).values(), 1)} == got


def test_pages_table_keeps_the_article():
    for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        blocks = H.read_page(r["html"])
        assert not any(s == H.OPEN for _, s in blocks)
        article = r["html"].split("<article>")[1].split("</article>")[0]
        want = [" ".join(t.split()) for t, _ in H.read_page(f"<article>{article}</article>")]
        assert kept(r["html"]).split("\n") == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines_is_a_longest_common_subsequence(a, b):
    at = H.common_lines(a, b)
    assert at == sorted(set(at)) and len(at) == lcs(a, b)
    it = iter(b)
    assert all(a[i] in it for i in at)  # a subsequence of b


def brute(rows):
    """Texts by comparing each open page with its neighbours in the whole sorted host."""
    seen = []
    for k, (i, url, html) in enumerate(rows):
        host, path = H.host_and_path(url)
        seen.append((host or "", path, -1 if i is None else i, k, H.read_page(html or "")))
    out = {}
    order = sorted(seen, key=lambda x: x[:4])
    for n, (host, path, _, k, blocks) in enumerate(order):
        lines = [t for t, _ in blocks]
        near = [o for o in order[max(0, n - 1):n] + order[n + 1:n + 2] if o[0] == host and host and [t for t, _ in o[4]] != lines]
        shared = set()
        if near:
            def prefix(o):
                c = 0
                while c < min(len(o[1]), len(path)) and o[1][c] == path[c]:
                    c += 1
                return c
            other = [t for t, _ in max(near, key=prefix)[4]]
            shared = set(H.common_lines(lines, other))
        out[k] = "\n".join(t for j, (t, s) in enumerate(blocks) if s == H.KEEP or (s == H.OPEN and j not in shared))
    return out


def test_differencing_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        host = rng.choice(["a.example", "a.example", "b.example", "c.example"])
        own = [f"<p>text {rng.randrange(10**6)} of page {i}</p>" for _ in range(rng.randint(0, 5))]
        body = f"<div>Top of {host}</div><div>Links</div>" + "".join(own) + f"<div>End of {host}</div>"
        if i % 7 == 0:
            body = f"<article>{body}</article><div>Beside</div>"
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{i}", f"<html><body>{body}"))
    rows += [(500, None, "<p>alone</p>"), (501, "http://d.example/only", "<p>alone</p>"), (502, "http://d.example/e", None),
             (None, "http://e.example/p", "<p>1</p>"), (503, "http://[bad", "x"), (504, "http://f.example/", "<p>" + "w " * 90_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r["text"] for r in H.extract(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for k, (i, url, _) in enumerate(rows):
        assert got[i, url] == want[k], rows[k]
    assert sum("Top of" in t for t in got.values()) <= 20  # articles, and single pages of a host


def test_copies_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.example/1", "<p>x</p><p>y</p>")] * 2 + [(2, "http://a.example/2", "<p>x</p><p>z</p>")],
                               "page_id long, url string, html string")
    assert sorted(r["text"] for r in H.extract(df).collect()) == ["y", "y", "z"]
    assert H.extract(df.limit(0)).count() == 0


def test_runs_of_copies_at_one_path(spark):
    """Every copy of a page, however many lie at its path, gives the text that a single one gives."""
    html = "<div>Site</div><p>{}</p><div>End</div>".format
    rows = [(1, "http://a.example/x", html("one")), (50, "http://a.example/y", html("two"))]
    for copies in (1, 5):
        more = [(10 + i, f"http://a.example/xx{s}", html("copied")) for i, s in enumerate(["", "?utm_source=feed", "#top", "/", "?p=2"][:copies])]
        df = spark.createDataFrame(rows + more, "page_id long, url string, html string").repartition(3)
        assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == {1: "one", 50: "two"} | {m[0]: "copied" for m in more}
