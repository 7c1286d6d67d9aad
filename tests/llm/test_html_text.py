import math
import random

from strandwise.llm import html_text as ht

SCHEMA = "page_id long, url string, html string, text string, host int"


def test_articles_of_the_pages_table(spark):
    """The article is its h1 and the lines of one document."""
    squeeze = lambda t: "\n".join(x for x in (" ".join(s.split()) for s in t.split("\n")) if x)
    docs = {squeeze(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = ht.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(out) == 250 and all(r.n_chars == len(r.text) for r in out)
    assert all(r.text.split("\n", 1)[1] in docs for r in out)


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_style_tree_removes_what_repeats_on_a_host_without_named_markup(spark):
    draw = random.Random(4)
    data, want = [], {}
    for k in range(8):
        title, one, two = words(draw, 5), words(draw, 30), words(draw, 40)
        html = (
            f"<html><body><div><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></div><div><h2>{title}</h2><p>{one}<p>{two}</p>"
            "<p>Subscribe today and never miss a story</p></div><div><p>Copyright and all that</p><p>Terms of use</p></div></body></html>"
        )
        data.append((k, "http://h.example.org/x", html, None, None))
        want[k] = f"{title}\n{one}\n{two}"
    data.append((99, "http://single.example.org/", "<body><div>Home</div><div>Own text</div></body>", None, None))
    want[99] = "Home\nOwn text"
    frame = spark.createDataFrame(data, SCHEMA)
    got = {r.page_id: r.text for r in ht.extract_text(frame).collect()}
    assert got == want
    # without the broadcast
    limit, ht.BROADCAST_BYTES = ht.BROADCAST_BYTES, -1
    try:
        assert {r.page_id: r.text for r in ht.extract_text(frame).collect()} == want
    finally:
        ht.BROADCAST_BYTES = limit


def test_equal_pages_and_articles_are_not_cut(spark):
    html = "<body><nav>m</nav><article><h1>T</h1><p>Same words</p></article></body>"
    data = [(k, "http://h/", html, None, None) for k in range(9)] + [(20 + k, "http://h/", html.replace("T<", f"T{k}<"), None, None) for k in range(9)]
    got = {r.page_id: r.text for r in ht.extract_text(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[0] == "T\nSame words" and got[23] == "T3\nSame words"


def test_what_markup_rules_out():
    cases = {
        "<header>Site</header><article><header><h1>Title</h1></header><p>a&nbsp;b  c&amp;d &lt;x&gt; &#233; &hellip;</p><footer>f</footer></article>": "Title\na b c&d <x> é …",
        "<body><main><p>x<br>y</p><aside>no</aside><form>no<input></form><div class='ad-slot'>no</div><section id=comments><p>no</p></section></main>": "x y",
        "<div class='cookie-notice'>no</div><div class='content'><p>yes</p></div><div class=sidebar>no</div>": "yes",
        "<article><p>a<b>b</b>c<script>var t='</p>';</script><style>p{}</style><!-- no --><p>d</article><p>after": "abc\nd",
        "<nav>never closed<article><p>text</article>": "text",
        "<article><div class='article comment-free'>a</div><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>": None,
        "<aside><article>teaser</article></aside><article><p>own</p></article><section class=comments><article><p>said</p></article></section>": "own",
        "plain < text & more &copy; 3<4": "plain < text & more © 3<4",
        "": "",
        "<p hidden>no</p><p style='display: none'>no</p><p>yes</p>": "yes",
        "<article><p>" + "<b>" * 3000 + "deep</article>": "deep",
    }
    for html, want in cases.items():
        if want is not None:
            assert ht.main_text(html) == want, html
    assert ht.main_text("<article><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>") == "1\n2\nx\ny"


def test_edges(spark):
    long = "<article>" + "<p>w w</p>" * 40000 + "</article>"
    data = [(1, None, None, "clash", 1), (2, "x", "", None, None), (None, "http://a/", "<p>t", None, None), (3, "http://a/", long, None, None), (3, "http://a/", long, None, None)]
    out = ht.extract_text(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", 0), ("2", 0), ("3", 159999), ("3", 159999), ("None", 1)]
    assert ht.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_are_read_whole():
    cases = {
        "<div id=content><h1>..</h1><p>real</p></div><section><article>Teaser card</article></section>": "..\nreal\nTeaser card",
        "<article><section class='alert-fatigue'><p>Body on alerts</p></section></article>": "Body on alerts",
        "<article><div class='related-work'><p>a</p></div><div class='search-results-explained'><p>b</p></div></article>": "a\nb",
        "<div class='layout with-sidebar has-comments'><article><p>own</p></article><div class='left-sidebar'>no</div></div>": "own",
        "<article><p>own</p><div class='comment-list'>no</div><div class='socialShare'>no</div><div id=related_posts>no</div></article>": "own",
    }
    for html, want in cases.items():
        assert ht.main_text(html) == want, html


def site(pages=30):
    """A host whose markup is of no use: a teaser within the article, a headline and a footer line beside it."""
    draw, data, want = random.Random(5), [], {}
    for k in range(pages):
        head, title, body, lead = (words(draw, n) for n in (6, 5, 60, 9))
        data.append((k, "http://h.example.org/x", (
            f"<body><div class=top><h1>{head}</h1></div><article><h2>{title}</h2><p>{lead}</p><p>{body}</p>"
            "<div class=x><p>Read it all for a small fee</p></div></article><div class=end><p>Made in a small town</p></div></body>"
        ), None, None))
        want[k] = f"{head}\n{title}\n{lead}\n{body}"
    return data, want


def test_the_tree_decides_inside_and_beside_a_named_article(spark):
    data, want = site()
    frame = spark.createDataFrame(data, SCHEMA)
    assert {r.page_id: r.text for r in ht.extract_text(frame).collect()} == want
    # alone, the page has the markup's word only
    assert ht.main_text(data[0][2]) == want[0].split("\n", 1)[1] + "\nRead it all for a small fee"


def test_a_hot_host_is_split_for_the_join(spark, monkeypatch):
    data, want = site()
    frame = spark.createDataFrame(data + [(100 + k, f"http://o{k}.example.org/", "<p>own</p>", None, None) for k in range(10)], SCHEMA)
    monkeypatch.setattr(ht, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ht, "HOT_SHARE", 0.1)
    got = {r.page_id: r.text for r in ht.extract_text(frame).collect()}
    assert got == want | {100 + k: "own" for k in range(10)}


def test_importances_by_their_definition(spark):
    """Entropies from the distributions themselves, page by page."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", "html").collect()
    data, _ = site(6)
    rows = [(r.url, r.html) for r in rows] + [(d[1], d[2]) for d in data] + [(data[0][1], data[0][2])]
    hosts = {}
    for url, html in rows:
        hosts.setdefault(url.split("/")[2].split(":")[0].lower(), set()).add(html)
    entropy = lambda items, m: -sum(items.count(x) / m * math.log(items.count(x) / m) for x in set(items)) / math.log(m)
    want = {}
    for host, pages in hosts.items():
        held = {}  # place: for each page the texts of its branch and its children's styles
        for html in pages:
            blocks, shapes = ht.parse(html)
            for place in {p for b in blocks for p in b.path[1:]}:
                branch = tuple((b.path[-1], b.text) for b in blocks if place in b.path)
                held.setdefault(place, []).append((branch, sum(len(t) for _, t in branch), tuple(shapes.get(place, ()))))
        for place, seen in held.items():
            m = len(seen)
            if m >= ht.MIN_PAGES:
                branches = [b for b, _, _ in seen]
                chars = sum(c for _, c, _ in seen)
                repeats = sum(c * math.log(branches.count(b)) for b, c, _ in seen) / chars / math.log(m)
                want[host, place] = m, ht.CONTENT_SHARE * (1 - repeats) + (1 - ht.CONTENT_SHARE) * entropy([s for _, _, s in seen], m)
    frame = spark.createDataFrame([(u.split("/")[2].split(":")[0].lower(), h) for u, h in rows], "host string, html string")
    names = {r.h: r.host for r in frame.selectExpr("host", "xxhash64(host) as h").distinct().collect()}
    places, _ = ht.importances(frame)
    got = {(names[r.host], r.key): (r.m, r.importance) for r in places.collect()}
    assert set(got) == set(want) and len({h for h, _ in got}) > 1
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
