"""Operators on pages and embeddings against brute force, and their edge cases."""

from __future__ import annotations

import time

import numpy as np

from ballastry.llm import cap_filters, html_text, url_reputation
from compare import differences


def brute(vectors, threshold=0.9):
    x = []
    for v in vectors:
        a = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float64)
        x.append(a if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    n = len(x)
    links, root = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if x[i] is None or x[j] is None or len(x[i]) != len(x[j]):
                continue
            if x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


def test_cap_filters(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 32))
    rows = [[float(np.float32(c)) for c in centres[k % 6] + 0.25 * rng.standard_normal(32)] for k in range(150)]
    rows += [None, [0.0] * 32, [float("nan")] * 32, [None, *rows[0][1:]], [float("inf")] * 32, rows[0], rows[0], [1.0, 2.0]]
    vectors = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "vec_id long, embedding array<float>")
    links, root = brute(rows)
    for block in (cap_filters.BLOCK, 16):
        got = {r["vec_id"]: r for r in cap_filters.near_duplicates(vectors, block=block).collect()}
        assert len(got) == len(rows)
        found = sum(got[k]["n_links"] for k in range(len(rows)))
        assert 0.9 * sum(links) <= found <= sum(links)
        assert all(got[k]["n_links"] <= links[k] for k in range(len(rows)))
        assert np.mean([got[k]["component_id"] == root[k] for k in range(len(rows))]) >= 0.95
        assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(150, 155))
    assert cap_filters.near_duplicates(vectors.limit(0)).count() == 0


def test_cap_filter_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    links, _ = brute([r["embedding"] for r in rows])
    got = {r["vec_id"]: r["n_links"] for r in cap_filters.op10_cap_filters(spark, sf).collect()}
    assert all(got[r["vec_id"]] <= n for r, n in zip(rows, links, strict=True))
    assert sum(got.values()) >= 0.9 * sum(links)


def test_cap_filters_match_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(cap_filters.op10_cap_filters(spark, sf), cap_filters.OP10_SQL, sf) == []


def test_cap_filter_recall_on_many_vectors(spark):
    """Pairs next to the threshold among 50,000 vectors; ids divisible by 100 are compared with all rows."""
    rng, n, dim = np.random.default_rng(9), 50_000, 64
    x = rng.standard_normal((n, dim))
    for k in range(0, n, 100):  # 1 to 3 rows near every hundredth, from cosine 0.9 on
        x[k] /= np.linalg.norm(x[k])
        for j in range(1, 1 + rng.integers(1, 4)):
            side = rng.standard_normal(dim)
            side -= (side @ x[k]) * x[k]
            cosine = rng.uniform(0.9, 0.93)
            x[k + j] = cosine * x[k] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    x = x.astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = cap_filters.near_duplicates(table).toPandas().set_index("vec_id").sort_index()["n_links"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit[::100] @ unit.T >= 0.9).sum(axis=1) - 1
    found = got.loc[::100].to_numpy()
    assert near.sum() > 800 and (found <= near).all()
    assert found.sum() >= 0.97 * near.sum()


def test_pairs_below_the_threshold_do_not_link_in_large_blocks():
    below = 0.9 - 5e-13
    for copies in (5, 460, 1100):  # 1,100 copies fill more than two stripes
        x = np.array([[1.0, 0.0]] * copies + [[below, float(np.sqrt(1 - below * below))]])
        n, side = np.ones(copies + 1, dtype=np.int64), np.zeros(copies + 1, dtype=np.int32)
        links, root = cap_filters._links_in(7, x, n, [np.array([7])] * (copies + 1), side, 0, 0, 0.9)
        assert links.tolist() == [copies - 1] * copies + [0]
        assert root.tolist() == [0] * copies + [copies]


def test_list_decoding_finds_all_filters():
    for n in (100, 10_000, 3_000_000):
        code = cap_filters.ProductCode(16, n)
        x = np.random.default_rng(2).standard_normal((5, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        names, counts = code.filters(x)
        products = (x @ code.directions).reshape(5, code.rotations, 2, code.words)
        ends = np.cumsum(counts)
        for k in range(5):
            r, i, j = np.nonzero(products[k, :, 0, :, None] + products[k, :, 1, None, :] >= code.alpha)
            assert names[ends[k] - counts[k] : ends[k]].tolist() == sorted(((r * code.words + i) * code.words + j).tolist())


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-banner">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First   <b>bold</b>&nbsp;text<br>next</p><div class="share">Share</div><ul><li>one<li>two</ul>
<aside>Side</aside><form><input value=x>Send</form><div class=comments><p>Reader says</p></div></article><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & more\nFirst bold text next\none\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert html_text.main_text("<p>a<p>b<!-- c --><p>d") == "a\nb\nd"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_stray_tags_are_linear():
    many = 150_000
    for page in ("<b>" * many + "</i>" * many, "<b><p>x</i>" * many, "<li>x</ul>" * many):
        start = time.perf_counter()
        html_text.parse(page)
        assert time.perf_counter() - start < 10  # a search of the stack for each tag takes over half an hour


def test_closing_tags_find_the_innermost():
    assert html_text.main_text("<article><div><p>a<b>b</div><p>c</i>d</article>") == "ab\ncd"
    assert html_text.main_text("<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul></article>").split("\n") == ["a", "b", "c", "d"]
    assert html_text.main_text("<article><p>a<p>b</p></p>c</article>") == "a\nb\nc"


def test_templates(spark):
    strip = "<div><span>Latest: call us now</span></div>"
    pages = [(k, f"http://a.org/{k}", f"<body>{strip}<p>own text {k}</p></body>") for k in range(12)]
    pages += [(20, None, f"<body>{strip}<p>x</p></body>"), (21, "http://b.org/", f"<body>{strip}<p>y</p></body>"), (22, "http://a.org/q", None)]
    out = {r["page_id"]: r for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[3]["text"] == "own text 3" and out[3]["n_chars"] == 10
    assert out[20]["text"] == "Latest: call us now\nx" and out[21]["text"] == "Latest: call us now\ny"
    assert out[22]["text"] == "" and out[22]["n_chars"] == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(empty).count() == 0


def test_host_with_many_templates(spark):
    strips = [f"<div><span>Strip {k}</span><div>call us</div></div>" for k in range(20)]
    pages = [(k, f"http://big.org/{k}", f"<body>{strips[k % 20]}<div>own text {k}</div></body>") for k in range(320)]
    pages += [(1000 + k, f"http://few.org/{k}", f"<body>{strips[k % 3]}<div>own text {k}</div></body>") for k in range(24)]
    pages += [(2000, None, f"<body>{strips[0]}<div>x</div></body>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for rows in (html_text.BROADCAST_ROWS, 0):
        out = {r["page_id"]: r["text"] for r in html_text.extract_text(table, broadcast_rows=rows).collect()}
        assert all(out[k] == f"own text {k}" for k in range(320))
        assert all(out[1000 + k] == f"Strip {k % 3}\nown text {k}" for k in range(24))  # on 8 pages each, but "call us" on 24
        assert out[2000] == "Strip 0\ncall us\nx" and len(out) == len(pages)


def test_copies_make_no_templates(spark):
    article = "<article><div><p>text</p></div><ul><li>one</ul></article>"
    pages = [(k, "http://copies.org/", f"<body>{article}</body>") for k in range(12)]
    pages += [(20 + k, f"http://menus.org/{k}", f"<body><nav>Menu {k}</nav>{article}</body>") for k in range(12)]
    pages += [(40 + k, "http://bare.org/", "<body><p>first</p><div>second</div></body>") for k in range(12)]
    pages += [(60 + k, f"http://mixed.org/{k % 9}", f"<body><div>strip</div><div>own {k % 9}</div></body>") for k in range(27)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for rows in (html_text.BROADCAST_ROWS, 0):
        out = {r["page_id"]: r["text"] for r in html_text.extract_text(table, broadcast_rows=rows).collect()}
        assert all(out[k] == out[20 + k] == "text\none" and out[40 + k] == "first\nsecond" for k in range(12))
        assert all(out[60 + k] == f"strip\nown {k % 9}" for k in range(27))  # 9 contents are too few
        assert len(out) == len(pages)


def test_url_rules(spark):
    urls = ["http://News.ORG/x", "https://a.example.org/es/1", "http://example.org/en/12?q#f", "http://b.com/fr/", "http://b.com/de/x", "http://b.com", "no url", None, "http://badexample.org.net/es/", "x://h?p/q"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.filter_urls(pages, labels).collect()}
    assert got[0] == ("news.org", "/x", "org/", "allow")
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("b.com", "/fr/", "com/fr/", "allow") and got[4] == ("b.com", "/de/x", "com/de/", "block")
    assert got[5] == ("b.com", "", None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2] is None and got[9][:2] == ("h", "")


def test_reputation_shrinks(spark):
    pages = [(k, f"http://bad.net/{k}") for k in range(40)] + [(100 + k, f"http://good.net/{k}") for k in range(40)] + [(200, "http://new.net/")]
    labels = [(k, 0, 1) for k in range(40)] + [(100 + k, 1, 0) for k in range(40)]
    out = url_reputation.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["page_id"]: r for r in out.collect()}
    assert got[0]["verdict"] == "block" and got[100]["verdict"] == "allow"
    assert got[100]["bad_mean"] < got[200]["bad_mean"] < got[0]["bad_mean"]


def canonical(node):
    """A subtree written out, where the operator takes hashes."""
    if isinstance(node, str):
        return " ".join(node.split())
    named = sorted((k, v) for k, v in html_text.attributes(node).items() if k in ("class", "id", "role"))
    return (node.tag, tuple(named), tuple(canonical(k) for k in node.kids))


def test_templates_by_brute_force(spark):
    """A site without telling names: what recurs decides, outside of articles and inside of them."""
    bars = [f"<div><div>Bar {k}</div><ul><li>Start<li>Shop {k % 3}</ul></div>" for k in range(4)]
    inside = "<div><span>Subscribe to our letter</span></div>"
    pages = []
    for k in range(60):
        body = f"<p>Own words of page {k}.</p><p>Said again and again.</p><div>Loose {k}</div>"
        body = f"<article>{body}{inside if k % 2 else ''}</article>" if k < 30 else body + (inside if k % 2 else "")
        pages.append((k, f"http://site{k % 2}.org/{k}", f"<body>{bars[k % 4]}{body}<div><b>Imprint</b></div></body>"))
    pages += [(100 + k, "http://site1.org/copy", pages[1][2]) for k in range(20)]
    seen = {}
    for _, url, html in pages:
        root = html_text.parse(html)
        content = html_text._text_of(root, set())
        for node in html_text._hash_all(root):
            seen.setdefault((url.split("/")[2], canonical(node)), set()).add(content)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    changed = 0
    for k, url, html in pages:
        root = html_text.parse(html)
        gone = {id(n) for n in html_text._hash_all(root) if len(seen[url.split("/")[2], canonical(n)]) >= html_text.MIN_PAGES}
        want = html_text._text_of(root, gone)
        assert got[k] == want
        changed += want != html_text._text_of(root, set())
    assert changed == sum(k >= 100 or k >= 30 or k % 2 for k, _, _ in pages)
    assert got[1] == "Own words of page 1.\nSaid again and again.\nLoose 1"
    assert got[31] == "Own words of page 31.\nLoose 31"  # outside of an article, what all pages say is the site's


def test_share_next_to_the_least_count(spark):
    """A subtree on MIN_PAGES - 1 pages stays, one on MIN_PAGES goes."""
    pages = [(k, "http://a.org/", f"<body><div>nine {'x' if k < 9 else k}</div><div>ten {'x' if k < 10 else k}</div><p>own {k}</p></body>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "nine x\nown 0" and got[11] == "nine 11\nten 11\nown 11"


def test_rules_of_equal_length_and_long_urls(spark):
    urls = ["http://b.com/fr/" + "x" * 100_000, "http://" + "a." * 2000 + "org/", "http://example.org/en/1", "http://example.org/en/2"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = url_reputation.filter_urls(pages, labels).collect()
    assert sorted((r["page_id"], r["rule"]) for r in rows) == sorted([(0, "com/fr/"), (1, "org/"), (2, "example.org/en/1"), (3, "org/")] * 2)
