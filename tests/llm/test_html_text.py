import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.html_text import BLOCKS, ENDS_P, FURNITURE, P_SCOPE, candidates, differences, extract_text, lines_of, neighbours, shared


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(7)
    for size in (3, 5, 12, 40):
        for _ in range(400):
            a, b = ([rng.randrange(size) for _ in range(rng.randrange(14))] for _ in range(2))
            found = shared(a, b)
            rest = iter(b)
            assert len(found) == lcs(a, b) and all(any(x == y for y in rest) for x in (a[i] for i in sorted(found)))
    many = list(range(20_000))
    assert len(shared(many, many[1:])) == 19_999
    assert len(shared([i % 7 for i in range(2000)], [i % 5 for i in range(2000)])) > 0


PAGES = {
    "<article><h1>T&amp;t</h1><p>a  b<br>c</p><nav>menu</nav><p>d<b>e</b></article><footer>f</footer>": "T&t\na b c\nde",
    "<main><p>x</p><div class='ad banner'>buy</div><!-- no --><script>var a='</p>';</script><style>p{}</style></main>": "x",
    "<body><header>h</header><p>one &lt;two&gt; &copy &#233;</p><aside>s</aside><form><p>q</p></form></body>": "one <two> © é",
    "<article><p>cut off<p>second": "cut off\nsecond",
    "<article>text <a href='x>y'>link</a> more<div id=comments><p>reader</p></div></article>": "text link more",
    "<ARTICLE><P>Upper</P></ARTICLE>": "Upper",
    "a < b and c > d": "a < b and c > d",
    "<article><header><h1>Title</h1><nav>n</nav></header><div class='article-header related-work'>kept</div><div class='page-header'>not</div></article>": "Title\nkept",
    "<div class='comment-body'>reader</div><div class='post-header'>kept</div><p id=related>no</p>": "kept",
    "": "",
    "<p></p>  ": "",
    "<article><p>end of tag <b": "end of tag",
    "<main><div class='content'><p>The real story.</p></div><article class='teaser related'><p>Read on</p></article></main>": "The real story.",
    "<article><p>Text</p><article class='comment'><p>reader</p></article></article><article class=comment><p>another</p></article>": "Text",
    "<body><p class='ad'>Buy now<p>Two.<p>Three.": "Two.\nThree.",
    "<ul><li class=ad>x<li>one<ul><li>in<li class=promo>y</ul><li>two</ul><p>after": "one\nin\ntwo\nafter",
    "<table><tr><td class=ad>x<td>a<tr><td>b<table><tr><td>in</table>c</table>d": "a\nb\nin\nc\nd",
    "<dl><dt>a<dd class=sponsored>b<dt>c</dl>": "a\nc",
    "<div>a<b>b</div>c</b>d<p>e</i></p></p>f": "ab\ncd\ne\nf",
    "<article><div><p>in</div>out</article></article>": "in\nout",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    lines = lines_of(page)
    assert "\n".join(lines[i].text for i in candidates([x.stands for x in lines])) == PAGES[page]


def test_the_longer_of_articles_and_main_counts_without_what_is_shared(spark):
    page = "<main><p>{}</p><article><p>a card of another story</p></article><article><p>and of a third, with more words</p></article></main>"
    rows = [(i, f"http://h.example/a/{i}", page.format(f"the story {i} in words")) for i in range(2)] + [(7, "http://alone.example/", page.format("short"))]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # Without a neighbour the articles are longer; with one, they are what every page has.
    assert got == {0: "the story 0 in words", 1: "the story 1 in words", 7: "a card of another story\nand of a third, with more words"}


def slow_lines(page):
    """The rules once more, with the open elements searched each time."""
    stack, out, text = [], [], []

    def flush():
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, "aside" in stack))

    for token in re.findall(r"</?\w+>|[^<]+", page):
        if token[0] != "<":
            text.append(token)
            continue
        tag = token.strip("</>")
        block = tag in BLOCKS
        if block:
            flush()
        if token[1] == "/":
            if tag in stack and (block or not any(t in BLOCKS for t in stack[len(stack) - stack[::-1].index(tag) :])):
                at = len(stack) - 1 - stack[::-1].index(tag)
                if "aside" in stack[at:]:
                    flush()
                del stack[at:]
            continue
        last = lambda names: max((i for i, t in enumerate(stack) if t in names), default=-1)
        at = len(stack)
        if tag == "li" and last(["li"]) > last(["ul", "ol", "menu"]):
            at = last(["li"])
        if (tag in ENDS_P) and last(["p"]) > last(P_SCOPE):
            at = min(at, last(["p"]))
        if "aside" in stack[at:]:
            flush()
        del stack[at:]
        if tag == "aside":
            flush()
        stack.append(tag)
    flush()
    return out


def test_malformed_pages_against_brute_force():
    rng = random.Random(9)
    for _ in range(3000):
        page = "".join(rng.choice(["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<b>", "</b>", "<i>", "</i>", "<div>", "</div>", "<aside>", "</aside>", "x ", "y "]) for _ in range(rng.randrange(25)))
        assert [(x.text, x.stands == FURNITURE) for x in lines_of(page)] == slow_lines(page), page


def test_time_is_in_step_with_the_page():
    for page in ("<p>x</b>" * 200_000, "<b><i>" * 100_000 + "</u>" * 100_000, "<li><b>" * 100_000, "<div>" * 100_000 + "x<p>" * 100_000):
        began = time.perf_counter()
        lines_of(page)
        assert time.perf_counter() - began < 6


def test_differencing_drops_what_the_neighbour_shares(spark):
    page = "<body><div>Site name</div><div>Home</div><p>{}</p><div>Imprint</div></body>"
    rows = [
        (1, "http://h.example/a/1", page.format("first story"), "clash"),
        (2, "http://h.example/a/2?x=1", page.format("second story"), ""),
        (3, "http://h.example/b/9#top", page.format("third story"), ""),
        (4, "http://alone.example/", page.format("fourth story"), ""),
        (5, None, page.format("fifth"), ""),
        (6, "http://h.example/z", None, ""),
        (7, "http://h.example/a/1", page.format("first story"), ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert got[2] == ("second story", 12) and got[3] == ("third story", 11)
    assert got[4] == got[4][:0] + ("Site name\nHome\nfourth story\nImprint", 35) and got[5][0].endswith("Imprint") and got[6] == ("", 0)
    # Pages 1 and 7 are copies: 7 is held against its other neighbour, 1 has no other and keeps all.
    assert got[7] == ("first story", 11) and got[1][0] == "Site name\nHome\nfirst story\nImprint"
    assert extract_text(pages.limit(0)).count() == 0
    assert sorted((r.page_id, r.n_lines, r.n_shared, r.n_deleted) for r in differences(pages).collect())[:4] == [(1, 4, 0, 0), (2, 4, 3, 3), (3, 4, 3, 3), (4, 4, 0, 0)]


def test_paragraphs_of_articles_stay_and_bare_text_goes(spark):
    page = "<article><h1>{0}</h1><p>a passage that was copied</p><p>{0} own</p><div>Share this</div></article>"
    rows = [(i, f"http://h.example/a/{i}", page.format(f"t{i}")) for i in range(3)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"t{i}\na passage that was copied\nt{i} own" for i in range(3)}


def paths_alike(a, b):
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def brute_neighbours(rows):
    """(near, far) by rid of (rid, host, path) rows."""
    rows = sorted(rows, key=lambda r: (r[1].encode(), r[2].encode(), r[0]))
    out = {}
    for k, (rid, host, path) in enumerate(rows):
        sides = [rows[i] for i in (k - 1, k + 1) if 0 <= i < len(rows) and rows[i][1] == host]
        sides.sort(key=lambda r: -paths_alike(r[2], path))
        ids = [r[0] for r in sides]
        out[rid] = (ids[0] if ids else None, ids[1] if len(ids) > 1 else None)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_neighbours_against_brute_force(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, f"h{rng.randrange(6)}", "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(4)))) for i in range(200)] + [(200, "alone", "")]
    df = spark.createDataFrame(rows, "rid long, host string, path string")
    assert {r.rid: (r.near, r.far) for r in neighbours(df, ranges).collect()} == brute_neighbours(rows)


def test_query_against_brute_force(spark):
    """Pages without markup, whose text is what the next page by URL lacks."""
    rng = random.Random(11)
    furniture = [f"menu {i}" for i in range(6)]
    rows = []
    for i in range(120):
        own = [f"story {i} line {k}" for k in range(rng.randrange(1, 6))]
        lines = furniture[: rng.randrange(2, 7)] + own + rng.choice([[], ["imprint"]])
        rows.append((i, f"https://h{i % 5}.example/{rng.choice('ab')}/{i:03d}.html", "<br>".join(f"<div>{x}</div>" for x in lines), lines))
    near = brute_neighbours([(i, url.split("/")[2], "/" + url.split("/", 3)[3]) for i, url, _, _ in rows])
    lines = {r[0]: r[3] for r in rows}
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for i, (a, b) in near.items():
        other = next((lines[x] for x in (a, b) if x is not None and lines[x] != lines[i]), [])
        kept = [x for k, x in enumerate(lines[i]) if k not in shared(lines[i], other)] or lines[i]
        assert got[i] == ("\n".join(kept), len("\n".join(kept)))
        assert lcs(lines[i], other) == len(shared(lines[i], other))


def test_long_pages(spark):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://h.example/1", long), (2, "http://h.example/2", long + "<div>x</div>"), (3, "http://h.example/3", "<p>" + "word " * 300_000)]
    got = {r.page_id: r.n_chars for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: sum(len(f"line {i}") + 1 for i in range(30_000)) - 1, 2: sum(len(f"line {i}") + 1 for i in range(30_000)) - 1, 3: 5 * 300_000 - 1}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/pages.parquet"), reason="needs the given tables")
def test_lines_that_differencing_finds_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    lines, common = differences(pages).agg(F.sum("n_lines"), F.sum("n_shared")).first()
    assert lines > 40_000 and common > 700
