from lectern.llm import htmlgbt as H


def test_held_out_layouts():
    pages = H.made_up_pages(150, seed=5)
    texts = H.main_texts(pages, H.fitted_trees())
    want = ["\n\n".join(t for t in H.Page(p).text if t and H.MARK in t) for p in pages]
    assert sum(a == b for a, b in zip(texts, want)) > 0.93 * len(pages)


def test_decoding_has_no_contradictions():
    parent, odds = [-1, 0, 1, 2, 0, 4], [0, -1, -2, 5, 1, -3]
    assert H.decode(parent, odds) == [True, True, True, True, True, False]
    assert H.decode(parent, [0, -4, -2, 5, 1, 2]) == [True, False, False, False, True, True]


def test_what_a_browser_does():
    p = H.Page("<body><p>a &amp; b&nbsp;c<p>d<br>e<b>f</b><script>x='</p>'</script><ul><li>g<li>h</ul><!-- no --><style>q</style> i </body>")
    assert [t for t in p.text if t] == ["a & b c", "d ef", "g", "h", "i"]
    assert [t for t in H.Page("<div").text if t] == [] and H.Page("").text == [None]


def test_rows(spark):
    article = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>Some words of the text, and more.</p></article><footer>&copy; me</footer></body></html>"
    df = spark.createDataFrame([(1, "u", article), (1, "u", article), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 100_000)], "page_id long, url string, html string")
    out = H.extract_main_text(df).collect()
    assert len(out) == 5 and sum(r.text == "Title here\n\nSome words of the text, and more." for r in out) == 2
    assert all(r.n_chars == len(r.text) for r in out) and {r.text for r in out if r.page_id in (2, 3)} == {""}
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_the_article_of_every_page(spark, sf):
    import html
    import re

    for r in H.extract_main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|ul|li)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_time_is_linear_in_hostile_pages():
    import time

    trees = H.fitted_trees()
    for unit in ("<div>", "<iframe>x ", "<li>a<ul>", "<table><tr><td>", "<a \" '", "<!--x"):
        began = time.perf_counter()
        H.main_texts([unit * (400_000 // len(unit))], trees)
        assert time.perf_counter() - began < 10, unit


def test_tags_are_mended_at_any_depth():
    p = H.Page("<div><ul><li>a<div>b<li>c</div></ul><table><tr><td>d<p>e<table><tr><td>f</table>g<td>h</table><p>i<p>j<p>k<iframe>")
    assert [t for t in p.text if t] == list("abcdefghijk")
    parents = [p.parent[k] for k, t in enumerate(p.text) if t]
    assert len(set(parents)) == 11 - 1 and all(e > k for k, e in enumerate(p.end))
