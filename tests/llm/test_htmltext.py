import random

import pytest

from foliate.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="has-sidebar">
<header class=top><a href="/">Home</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- note <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article class="post"><header><h1>A &amp; B</h1></header><p>One
  two&nbsp;three<br>four<p><b>Bold</b>er <i>x</i>&lt;y&gt; caf&eacute; &#x41;<div class="ad">Buy</div><p>Last
<table><tr><td>c1</td><td>c2</td></tr></table><section id="comments"><p>First!</p></section></article><aside>Side</aside>
<form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_markup():
    assert htmltext.main_text(htmltext.lines(PAGE), None) == "A & B\nOne two three four\nBolder x<y> café A\nLast\nc1 c2"
    assert htmltext.main_text(htmltext.lines("<p>a<b>c</p><script>never closed"), None) == "ac"
    assert htmltext.main_text(htmltext.lines("plain < text"), None) == "plain < text"
    assert htmltext.lines(None) == htmltext.lines("") == []


@pytest.mark.parametrize("seed", range(20))
def test_common_subsequence_is_longest(seed):
    rnd = random.Random(seed)
    a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = htmltext.common(a, b)
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(a[i] in rest for i in sorted(found))


def test_neighbours_lose_what_they_share(spark):
    site = lambda i: f"<div>Logo</div><div>Tag line</div><p>story {i}</p><p>more {i}</p><div>Imprint</div>"
    rows = [(i, f"https://Host.example/{i % 2}/{i:03}?q={i}", site(i), "") for i in range(40)]
    rows += [(100, "https://alone.example/x", "<p>Logo</p><p>text</p>", ""), (101, None, "<p>Logo</p>", ""), (102, "https://host.example/9", None, ""), (103, "not a url", "", "")]
    rows += [(200, "http://copy.example/a", "<p>same</p><p>text</p>", ""), (201, "http://copy.example/b", "<p>same</p><p>text</p>", ""), (201, "http://copy.example/b", "<p>same</p><p>text</p>", "")]
    rows += [(300, "http://art.example/a", "<p>top</p><article><p>same</p></article>", ""), (301, "http://art.example/b", "<p>top</p><article><p>same</p><p>new</p></article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = sorted((r.page_id, r.text) for r in htmltext.extracted(pages).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [t for i, t in got if i < 100] == [f"story {i}\nmore {i}" for i in range(40)]
    assert [x for x in got if x[0] >= 100] == [(100, "Logo\ntext"), (101, "Logo"), (102, ""), (103, ""), (200, "same\ntext"), (201, "same\ntext"), (201, "same\ntext"), (300, "same"), (301, "same\nnew")]


def test_empty_table(spark):
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_page():
    assert len(htmltext.main_text(htmltext.lines("<p>" + "word " * 200_000 + "<p>" * 50_000 + "end"), None)) == 1_000_003


def _texts(spark, pages):
    rows = [(i, f"https://site.example/{i:03}", page) for i, page in enumerate(pages)]
    return [r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).sort("page_id").collect()]


def test_neighbours_decide_inside_and_outside_articles(spark):
    page = lambda i: f"<div>Logo</div><p>teaser {i} of the day</p><article><p>By our staff</p><p>the long story number {i}</p></article><article><p>a second story {i}</p></article>"
    want = lambda i: f"teaser {i} of the day\nthe long story number {i}\na second story {i}"
    assert _texts(spark, [page(i) for i in range(6)]) == [want(i) for i in range(6)]
    # The same text at two and at three addresses stays, and loses the template still.
    assert _texts(spark, [page(i) for i in (0, 1, 1, 2, 3, 3, 3, 4)]) == [want(i) for i in (0, 1, 1, 2, 3, 3, 3, 4)]


def test_large_template_and_copies_without_articles(spark):
    head = "".join(f"<div>part {k} of the site</div>" for k in range(40))
    page = lambda i: head + "".join(f"<p>own line {k} of page {i}</p>" for k in range(5))
    want = lambda i: "\n".join(f"own line {k} of page {i}" for k in range(5))
    for pages in (range(2), range(7), (0, 1, 1, 2, 3)):
        assert _texts(spark, [page(i) for i in pages]) == [want(i) for i in pages]
    assert _texts(spark, [page(0), head, page(1), page(2)])[1] == ""


def brute(rows):
    """Every page beside all others of its host, sorted as a list."""
    import re

    cut = lambda url: (m[1].lower(), m[2]) if (m := re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", url or "")) else ("", "")
    order = sorted(((*cut(url), key, page or "", htmltext.lines(page)) for key, url, page in rows), key=lambda r: r[:4])
    out = []
    for i, (host, path, key, _, own) in enumerate(order):
        near = [(-htmltext._prefix(order[j][1], path), abs(j - i), j < i, order[j][4]) for j in range(max(i - 2, 0), min(i + 3, len(order))) if j != i and host and order[j][0] == host]
        out.append((key, htmltext.main_text(own, [x[3] for x in sorted(near, key=lambda x: x[:3])])))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_matches_brute_force_for_any_number_of_partitions(spark, parts):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(40))
    block = lambda n: "".join(f"<p>{word()} {word()}</p>" for _ in range(n))
    frames = {h: (block(4), block(3)) for h in ("a.example", "b.example", "c.example")}
    rows = []
    for i in range(150):
        host = rnd.choice(["a.example"] * 5 + ["b.example", "c.example"])
        body = block(rnd.randrange(6))
        rows.append((i, rnd.choice([None, f"https://{host}/{rnd.choice('xyz')}/{rnd.randrange(60)}"]) if i % 9 == 0 else f"https://{host}/{rnd.choice('xyz')}/{rnd.randrange(60)}", frames[host][0] + (f"<article>{body}</article>" if i % 3 else body) + frames[host][1]))
    rows += rows[5:9]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = sorted((r.page_id, r.text) for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 40_000, '<a "' * 40_000 + ">", "<div>" * 40_000 + "</p>" * 40_000, "<span class=ad>" * 40_000, "<!--" * 40_000, "<" * 80_000):
        began = time.perf_counter()
        htmltext.lines(page)
        assert time.perf_counter() - began < 2


def test_names_that_only_mention_a_part():
    text = lambda page: htmltext.main_text(htmltext.lines(page), None)
    assert text('<div class="content has-sidebar"><article><p>kept</p></article></div>') == "kept"
    assert text('<article class="post related-topic"><p>kept</p></article>') == "kept"
    assert text('<div class="sidebar"><p>gone</p></div><p>kept</p>') == "kept"
