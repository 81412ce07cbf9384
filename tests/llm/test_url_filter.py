import re

from quillon.llm import url_filter as uf

URLS = ["http://example.org/es/1", "http://www.Example.org/en/12?x", "https://a.example.org", "http://notexample.org/es/1", "http://example.org:80/es/", "http://b.example.com/fr/x#y", "http://x.com/de/", "ftp://x.com/fr", "example.org/es/", None, "", "a://b://c/d", "http://free-bets.example.net/en/1",
        "http://x.net/casino/1", "http://x.net/casinos/1", "http://ads-track.example.org/en/1", "http://example.org/en/1", "http://example.org/EN/1", "://example.org/es/", "http://user@example.org/es/", "http://x.org?a=/b"]


def judge(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = m[1].translate(str.maketrans(uf.UPPER, uf.LOWER)) if m else ""
    path = m[2] if m else ""
    fits = [r for r in rules if re.search(r.regex, host + path)]
    site = max((r for r in fits if r.site), key=lambda r: (len(r.text), r.text), default=None)
    if site:
        h, s, p = site.text.partition("/")
        assert (host == h or host.endswith("." + h)) and path.startswith(s + p)
        return host, path, site.text, site.verdict
    best = max(fits, key=lambda r: (len(r.text), r.text), default=None)
    return host, path, None, best.verdict if best else default


def check(spark, rules, rows):
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    got = sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in uf.url_filter(df, rules).collect())
    want = sorted((i or -1, h, p, t or "", v) for i, u in rows for h, p, t, v in [judge(u, rules or uf.SITE_RULES + uf.PATTERN_RULES)])
    assert got == want


def test_cases(spark):
    check(spark, None, [*enumerate(URLS, 1), (None, URLS[0]), (3, URLS[0]), (3, URLS[0])])


def test_join_path_agrees(spark, monkeypatch):
    monkeypatch.setattr(uf, "MAP_RULES", 0)
    check(spark, None, list(enumerate(URLS, 1)))


def test_no_rules_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert uf.url_filter(df, [], default="block").collect()[0].verdict == "block"
    assert uf.url_filter(df.limit(0)).count() == 0


def test_rarest_token(spark):
    rows = spark.createDataFrame([("a.com/x",), ("a.com/y",), ("b.com/x",)], "_s string")
    (word, _), = uf.filed(rows, [uf.pattern_rule("com", "b")])
    assert word == "b"
    # the word at the end of a path prefix may go on, so it is no token
    assert "1" not in uf.site_rule("example.org/en/1", "block").tokens


def test_native(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = uf.url_filter(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
