"""HTML extraction against brute force."""

import html
import random
import re
import time

import numpy as np
import pytest

from pairweave.llm import html_text


def test_suffix_array():
    r = random.Random(3)
    for _ in range(100):
        t = [r.randint(0, 2) for _ in range(r.randint(1, 40))]
        order, levels = html_text.suffix_array(np.array(t))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want

        def shared(i, j):
            k = 0
            while i + k < len(t) and j + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            return k

        assert html_text.common_prefixes(order, levels).tolist() == [0] + [shared(a, b) for a, b in zip(want, want[1:])]


def test_repeated_runs_by_brute_force():
    r = random.Random(9)
    for _ in range(100):
        streams = [[r.randint(0, 4) for _ in range(r.randint(0, 25))] for _ in range(r.randint(1, 8))]
        share = r.choice([0.1, 0.3, 0.6])
        got = html_text.repeated([np.array(s, np.uint32) for s in streams], run=3, share=share)
        runs = {tuple(s[i : i + 3]) for s in streams for i in range(len(s) - 2)}
        often = [w for w in runs if 0 not in w and sum(any(tuple(s[i : i + 3]) == w for i in range(len(s) - 2)) for s in streams) >= share * len(streams)]
        want = html_text.shingles(np.array([x for w in often for x in w], np.uint64), 3)[::3].astype(np.int64) if often else []
        assert got.tolist() == sorted(want)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Top</header><nav><a href="/a">A</a></nav><div class="cookie-notice">We use cookies</div><!-- c --><div class="ad">Buy</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One<br>two  <b>th</b>ree\n four<p>five &copy; &#233;<script>x()</script> six
<ul><li>i1<li>i2</ul><aside>no</aside><form><input value="a>b">f</form><div id="comments"><p>bad</p></div><p>last</p></article><div class="sidebar">side</div></main><footer>foot</footer></body></html>"""


@pytest.mark.parametrize(
    "page,main",
    [
        ('<div class="site-header">S</div><div class="content has-sidebar"><article class="post"><div class="post-header"><h1>T</h1></div><p hidden>x</p><p style="display: none">y</p><p>ok</p><div class="post-comments">c</div><section class="comments"><article class="comment"><p>z</p></article></section></article><div class="sidebar">no</div></div>', ["T", "ok"]),
        ('<main><h1>A</h1><p>b</p><div class="share-bar"><a>s</a></div><div id="notice">n</div></main><p>out', ["A", "b"]),
        ('<article><p>x<article class="related"><a>r</a></article></p>tail</article>', ["x", "tail"]),
        ("<article><p>a &lt;b&gt; <!-- <p>no</p> --> c<![CDATA[ d ]]></p><template><p>t</p></template><p>1 < 2 and 3 > 2</p></article>", ["a <b> c d", "1 < 2 and 3 > 2"]),
        ("<article><p>cut off <b>here", ["cut off here"]),
        ("<article><script>unclosed", []),
        ("<main><p>lead</p><article>teaser</article></main>", ["lead", "teaser"]),
        ('<article><p class="share-price">12</p><p class="notice-of-motion">m</p><p class="social history">h</p></article>', ["12", "m", "h"]),
        ("<article><p>E <math><mi>m</mi></math> c</p><video>v<p>after<object> o</article>", ["E m c", "v", "after o"]),
        ('<form id="aspnetForm"><div><article><p>in a form</p></article></div><p>no</p></form>', ["in a form"]),
        ("<form><p>the whole page</p></form>", ["the whole page"]),
        ("<article>x<![CDATA[ abc", ["x abc"]),
        ("<p class=ad>buy<p>text<ul><li class=ad>x<li>y</ul>", ["text", "y"]),
        ('<p>Hello <span class="ad">x</span> world</p><p title="it>is">q</p>', ["Hello world", "q"]),
        ("<p>a<!-- no end <p>b", ["a"]),
        ("<div class='login-form adBox cookieNotice'>x</div><div id='mainContent' class='header'>y</div><div class='widget'>w", ["w"]),
    ],
)
def test_blocks(page, main):
    assert [t for r, t in html_text.blocks(page) if r != "drop"] == main


def test_odd_pages_take_time_in_proportion():
    for unit in ('<a title="x ', "<a b='c d=\">", "<x '>'\"", "<svg><li><p>", "<!--", "<", "<a ="):
        began = time.perf_counter()
        html_text.blocks(unit * 8000)
        assert time.perf_counter() - began < 0.5
    began = time.perf_counter()
    html_text.blocks("<div>" * 20000 + "</span>" * 20000 + "x" + "</div>" * 20000)
    assert time.perf_counter() - began < 2


def extracted_by_hand(rows, run=5, share=0.3):
    """The rule itself, with sets of runs of words instead of a suffix array, windows and counts."""
    hosts = {}
    for key, host, page in rows:
        hosts.setdefault(host, []).append((key, html_text.blocks(page or "")))
    out = {}
    for pages in hosts.values():
        stretches = lambda found: [(main, list(own)) for main, own in html_text.groupby(found, lambda x: x[0] == "main")]
        runs = lambda words: {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
        votes = {}
        for _, found in pages:
            sides = votes.setdefault("\n".join(t for r, t in found if r != "drop"), (set(), set()))
            for main, own in stretches(found):
                sides[main].update(runs([w for _, t in own for w in t.split()]))
        least = max(3, -(-len(votes) * share // 1))
        outside, both = ({w for w in set().union(*(v[k] for v in votes.values())) if sum(w in v[k] for v in votes.values()) >= least} for k in (0, 1))
        for key, found in pages:
            kept = []
            for main, own in stretches(found):
                flat = [(k, w) for k, (_, t) in enumerate(own) for w in t.split()]
                anywhere, within = set(), set()
                for i in range(len(flat) - run + 1):
                    if tuple(w for _, w in flat[i : i + run]) in (outside & both if main else outside):
                        anywhere |= set(range(i, i + run))
                        within |= set(range(i, i + run)) if flat[i][0] == flat[i + run - 1][0] else set()
                for k, (role, text) in enumerate(own):
                    places = [i for i, x in enumerate(flat) if x[0] == k]
                    if role == "drop" or set(places) <= anywhere:
                        continue
                    gone = set(places) & within
                    kept.append(" ".join(flat[i][1] for i in places if i not in gone) if gone and role != "weak" else text)
            out[key] = "\n".join(kept)
    return out


def random_pages(r, n):
    """Pages of three hosts, with and without landmarks: shared lines outside and inside main text, headlines in menus, passages of articles only."""
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    line = lambda k: " ".join(word() for _ in range(k))
    hosts = [{"lines": [line(r.randint(2, 9)) for _ in range(4)], "passage": line(12), "top": line(7)} for _ in range(3)]
    rows = []
    for i in range(n):
        h = r.randrange(3)
        own, title = hosts[h], line(7)
        bits = [f"<p>{line(r.randint(1, 20))}</p>" for _ in range(r.randint(0, 4))]
        bits += [f"<p>{x} {line(2) if r.random() < 0.4 else ''}</p>" for x in own["lines"] if r.random() < 0.5]
        bits += [f"<p>{own['passage']}</p>"] * (r.random() < 0.6) + ['<div class="related">' + r.choice(own["lines"]) + "</div>"] * (r.random() < 0.3)
        r.shuffle(bits)
        head = f"<nav>{own['top'] if r.random() < 0.7 else title}</nav>" + "".join(f"<div>{x}</div>" for x in own["lines"] if r.random() < 0.6)
        body = "".join(bits)
        main = r.random() < 0.6
        rows.append((i, f"h{h}", f"{head}<article><h1>{own['top'] if i % 7 == 0 else title}</h1>{body}</article><footer>{own['lines'][0]}</footer>" if main else f"{head}{body}<footer>{own['lines'][1]}</footer>"))
    return rows + [(n + i, *rows[r.randrange(n)][1:]) for i in range(n // 5)]


@pytest.mark.parametrize("seed,n", [(1, 60), (3, 14)])
def test_extraction_by_brute_force(spark, seed, n):
    rows = random_pages(random.Random(seed), n)
    want = extracted_by_hand(rows)
    assert sum(want[i] != "\n".join(t for r, t in html_text.blocks(p) if r != "drop") for i, _, p in rows) > len(rows) / 4
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p, "t") for i, h, p in rows], "page_id long, url string, html string, text string")
    for group in (2000, 3):
        got = {r.page_id: r.text for r in html_text.extract(df.repartition(3), group=group).collect()}
        assert got == want


def test_windows_have_no_bearing():
    r = random.Random(4)
    pages = [[(x[0], x[1]) for x in html_text.blocks(p)] for _, h, p in random_pages(r, 80) if h == "h1"]
    streams = [html_text._outside(p, {}).astype(np.uint32) for p in pages]
    whole = set(html_text.repeated(streams).tolist())
    assert whole
    for size in (1, 3, 10):
        parts = [set(html_text.repeated(streams[i : i + size]).tolist()) for i in range(0, len(streams), size)]
        assert whole <= set().union(*parts)


def test_edge_cases(spark):
    rows = [(0, "http://x.example/", PAGE), (1, None, None), (2, "http://x.example/", ""), (3, "no url", "just text &lt; here"), (4, "http://x.example/", "<p>unclosed <b>tag"), (5, "http://x.example/", "<article></article><p>out</p>"), (6, "http://x.example/", "<article><p>" + "word " * 50000 + "</p></article>"), (7, "http://y.example/", "<p>" + " ".join(f"w{i}" for i in range(html_text.WINDOW + 5)) + "</p>"), (0, "http://x.example/", PAGE), (None, "http://x.example/", "<p>null id</p>")]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], "page_id long, url string, html string, text string, host int")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[0] == "Title & more\nOne two three four\nfive © é six\ni1\ni2\nlast"
    assert by[1] == by[2] == "" and by[3] == "just text < here" and by[4] == "unclosed tag" and by[5] == "out" and by[None] == "null id"
    assert len(by[6]) == 249999 and by[7].count(" ") == html_text.WINDOW + 4
    assert html_text.extract(df.limit(0)).count() == 0


def test_unique_words_stay_and_copies_do_not_vote(spark):
    foot = "All rights reserved by the owner 2024"
    other = lambda i: " ".join(f"v{i}_{k}" for k in range(12))
    rows = [(i, "http://h.example/", f"<p>{other(i)}</p><div>{foot} s{i} t{i}</div><div>{foot} " + " ".join(f"x{i}_{k}" for k in range(40)) + "</div>") for i in range(6)]
    rows += [(20 + i, "http://h.example/", f"<nav>menu {other(50 + i)}</nav><p>one copied article that is on many pages of the host</p>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i in range(6):
        assert got[i] == f"{other(i)}\ns{i} t{i}\n" + " ".join(f"x{i}_{k}" for k in range(40))
    assert {got[20 + i] for i in range(8)} == {"one copied article that is on many pages of the host"}


def test_extraction_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)
