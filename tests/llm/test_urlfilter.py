import random

from lectern.llm.urlfilter import RULES, filter_urls

SCHEMA = "page_id long, url string"


def judge(url, rules):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    r = random.Random(5)
    label = lambda: r.choice(["a", "b", "www", "example", "org", "com", "net", "A-B", ""])
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{'.'.join(label() for _ in range(r.randint(1, 4)))}{r.choice(['', '/', '/en/1', '/en/12/x', '/es/', '/es', '/de/7', '/fr/1?x=/de/', '#/de/'])}" for _ in range(3000)]
    urls += [None, "", "no scheme", "://", "http://org/", "http://com.org/de/", "http://xorg/", "x" * 50_000, "http://example.org/en/1"] + ["http://hot.example.org/en/1"] * 500
    rules = [*RULES, ("allow", "a.example.org", "/en/1"), ("block", "b.com", "/"), ("allow", "www.b.com", "/en/"), ("block", "example.org", "/")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], SCHEMA)
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in filter_urls(df, rules, n_ranges=23).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = judge(u, rules)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def test_repeats_empty_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://x.org/a"), (1, "http://x.org/a"), (None, "http://y.com/de/")], SCHEMA)
    assert filter_urls(df).count() == 3
    assert filter_urls(df.limit(0)).count() == 0
    assert [r.rule for r in filter_urls(df, ()).collect()] == [None] * 3
