import random
import re
from html import unescape

import duckdb
import numpy as np

from lorekit.llm import html

FRAME = '<nav><a href="/">Home</a> <a href="/x">All posts we have</a></nav><div>Follow our site on every channel today</div>'


def text(page):
    """What structure alone gives: no token is known to repeat."""
    p = html.parse(page)
    return html.assemble(p, [np.ones(len(t.split(" ")) + 1, np.int64) for t in p.texts])


def test_blocks_and_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="menu">
    <header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">We use cookies</div><!-- <article>no</article> -->
    <article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two
      three<br>four <b>bo</b>ld<p>Second &#233;&#x1F600; &lt;tag&gt;</p><aside>side</aside><form><input value="x">send</form><ul><li>i<li>j</ul>
    <table><tr><td>c1<td>c2</table><div class="ad">Buy</div><p title='a > b'>after</p><div id="comments"><article class="comment"><p>me too</p></article></div><footer>by</footer></article>
    <div class="sidebar">s</div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Title & more\nOne two three four bold\nSecond é😀 <tag>\ni\nj\nc1\nc2\nafter"


def test_odd_pages():
    assert text(None) == text("") == text("<script>x") == text("<!-- <p>x") == text("<article></article>") == ""
    assert text("plain text only") == "plain text only"
    assert text("<article><p><b>never closed<br>") == "never closed"
    assert text("<div>a<div>b</div>c</div>") == "a\nb\nc"
    assert text("1 < 2 <article>x <y z='></article>").startswith("x")
    assert text("<main>m</main><main>n</main></p></div>") == "m\nn"
    assert text('<div id="content"><p>x</div><div class="footer">y</div>') == "x"
    assert text('<article><p style="display: none">h</p><p hidden>i</p>k</article>') == "k"
    assert len(text("<article>" + "<p>x" * 50_000)) == 99_999
    assert text('<div class="widget"><p>w</p><main><p>m</p><aside>a</aside></main><article>t</article></div>') == "m"


def test_host_decides_where_structure_does_not(spark):
    pages = [(i, f"http://A.example.org:80/{i}", f"<body>{FRAME}<div>Story number {i} tells what happened in town {i} on that day {i}</div><div>Legal words that stand under every one of our pages</div></body>") for i in range(30)]
    pages += [(100, "https://b.example.org/1", f"<body>{FRAME}<div>Alone on its host</div></body>"), (101, None, "<p>x y</p>"), (None, None, None), (102, "", ""), (103, "notanurl", "<article>z</article>")]
    pages += [(200, "https://c.example.org/1", "<div>twice the very same text on this host</div>"), (201, "https://c.example.org/2", "<div>twice the very same text on this host</div>")] * 2
    df = spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == len(pages)
    by = {(x.page_id, x.url): x.text for x in got}
    for i in range(30):
        assert by[i, f"http://A.example.org:80/{i}"] == f"Story number {i} tells what happened in town {i} on that day {i}"
    assert by[100, "https://b.example.org/1"] == "Follow our site on every channel today\nAlone on its host"
    assert by[101, None] == "x y" and by[None, None] == by[102, ""] == "" and by[103, "notanurl"] == "z"
    assert by[200, "https://c.example.org/1"] == "twice the very same text on this host"
    assert html.extract(df.limit(0)).count() == 0


def suffix_array(tokens):
    """Plain sorted suffixes of (host, page, tokens) with, for each place, the number of pages of its interval of RUN tokens in common."""
    flat = sorted((h, p, i, t[i : i + 40]) for (h, p), t in tokens.items() for i in range(len(t) - html.RUN + 1))
    flat.sort(key=lambda x: (x[0], x[3]))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out, since = {}, 0
    for j in range(1, len(flat) + 1):
        if j == len(flat) or flat[j][0] != flat[j - 1][0] or common(flat[j - 1][3], flat[j][3]) < html.RUN:
            m = len({p for _, p, _, _ in flat[since:j]})
            out |= {(h, p, i): m for h, p, i, _ in flat[since:j]}
            since = j
    return out


def test_equals_plain_sorted_suffixes(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    shared = [" ".join(r.choices(words, k=n)) for n in (7, 9, 14, 30, 60)]
    rows = []
    for i in range(120):
        parts = [f"<p>{' '.join(r.choices(words, k=r.randint(1, 40)))} u{i}x{j}</p>" for j in range(4)] + [f"<div>{x}</div>" for x in r.sample(shared, 3)]
        r.shuffle(parts)
        rows.append((i, f"https://h{i % 3}.example.org/{i}", "<body>" + "".join(parts)))
    rows += [(200, "https://h1.example.org/x", rows[1][2]), (201, "https://h1.example.org/y", rows[1][2])]
    pages = [html.parse(x[2]) for x in rows]
    tokens = {(u.split("/")[2], k): [w for t in p.texts for w in [*t.split(" "), html._END]] for (k, u, _), p in zip(rows, pages, strict=True)}
    interval = suffix_array(tokens)
    want = []
    for (k, u, _), p in zip(rows, pages, strict=True):
        host = u.split("/")[2]
        grams, chosen, _, block = html.streams([p], [host])
        assert len(grams) == len(tokens[host, k])
        m = np.array([interval[host, k, i] for i in np.flatnonzero(chosen)])
        counts = np.split(html.frequencies(grams, chosen, block, m), np.cumsum(np.bincount(block))[:-1])
        want.append((k, html.assemble(p, counts)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((x.page_id, x.text) for x in html.extract(df).collect()) == want
    assert any(t != html.assemble(p, [np.ones(len(x.split(" ")) + 1, np.int64) for x in p.texts]) for (_, t), p in zip(want, pages, strict=True))


def test_long_blocks_that_two_pages_share(spark, monkeypatch):
    """Every suffix counts: notices longer than menus, each on two pages of a host that lie in different chunks, all go."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    stories = [text(80) for _ in range(60)]
    notices = [text(n) for n in range(html.RUN, 36) for _ in range(2)]
    pages = [(i, f"https://x.example.org/{i}", f"<p>{notices[i]}</p><p>{s}</p><p>{notices[i - 1]}</p>") for i, s in enumerate(stories)]
    pages += [(100 + i, f"https://y{i}.example.org/", f"<p>{notices[i]}</p><p>{s}</p>") for i, s in enumerate(stories)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8)
    want = dict(enumerate(stories)) | {100 + i: f"{notices[i]}\n{s}" for i, s in enumerate(stories)}
    assert {x.page_id: x.text for x in html.extract(df).collect()} == want
    monkeypatch.setattr(html, "SPARE", 0)  # leading bits that many suffixes share change nothing
    assert {x.page_id: x.text for x in html.extract(df).collect()} == want


def test_array_finds_the_text_where_no_tag_or_class_tells(spark):
    """Menus, adverts and footers are plain elements here; they repeat, and the story, also one that two pages share, does not as often."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    menu = "".join(f"<div><a href='/'>{word()} {word()}</a></div>" for _ in range(30))
    foot = "<div>" + " ".join(word() for _ in range(40)) + "</div>"
    stories = [[" ".join(word() for _ in range(25)) for _ in range(4)] for _ in range(40)]
    stories[7] = stories[8]
    pages = [(i, "https://x.example.org/" + str(i), f"<body><div>{menu}</div><div>{''.join(f'<p>{t}</p>' for t in s)}</div>{foot}</body>") for i, s in enumerate(stories)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html.extract(df).collect()} == {i: "\n".join(s) for i, s in enumerate(stories)}
    without = {x.page_id: x.text for x in html.extract(df, array=False).collect()}
    assert all(menu_word in without[0] for menu_word in foot[5:-6].split())


def test_marks_take_whole_names():
    article = "<article><h1>T</h1><section class='related-work'><p>r</p></section><p class='promo-code-explained'>q</p></article>"
    assert text(article) == "T\nr\nq"
    for wrap in ("<div class='page-with-sidebar'>{}</div>", "<div id='content' class='no-sidebar'>{}</div>", "<div class='content-sidebar-wrap'>{}</div>", "<div class='site-sidebar'>{}</div>"):
        assert text(f"<nav>n</nav>{wrap.format(article)}<footer>f</footer>") == "T\nr\nq", wrap
    assert text("<article class='post category-social tag-search'><p>x</p><div class='share-links'>s</div><div class='post-comments'>c</div></article>") == "x"
    assert text("<main><p>m</p></main><div class='related-posts'><article>a</article></div>") == "m"
    assert text("<div class='widget'>only a frame</div>") == "only a frame"


def test_oracle(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{path}/pages.parquet'")
    want = sorted(con.sql(html.OP1_SQL).fetchall())
    assert sorted(tuple(x) for x in html.op1_html(spark, path).collect()) == want


def test_pages(spark):
    path = "/root/testdata/sf0.01"
    want = {}
    for x in spark.read.parquet(f"{path}/pages.parquet").collect():
        body = x.html[x.html.index("<article>") + 9 : x.html.index("</article>")]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", body)]
        want[x.page_id] = (x.url, "\n".join(p for p in parts if p))
    got = {x.page_id: (x.url, x.text) for x in html.op1_html(spark, path).collect()}
    assert got == want
