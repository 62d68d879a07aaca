"""Verdicts against every rule tried on every URL."""

import re

from netsluice.llm import url_rules as ur

SITES = ur.SITES + [("Example.ORG", "", "block"), ("", "/any/", "block"), ("a*b.net", "/*(x", "allow"), ("net", "/es/", "allow"), ("b.net", "/Es/", "block")]
PATTERNS = ur.PATTERNS + [
    ("tracker", "block"), ("^ads^", "block"), ("|http://exact.test/|", "block"), ("||Sub.Test^", "block"), ("*", "allow"), ("a.b+c$", "block"),
    ("", "block"), (None, "block"), ("^ads^", "block"), ("^ads^", "allow"), (r"/x[0-9]{3}$/", "block"), ("^é^", "block"), ("kelvin", "block"),
    ("^only*here^", "block"), ("^100%^", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://www.example.com/en/", "http://example.com/en/1", "http://xexample.com/en/1",
    "http://example.com/EN/1", "http://example.com", "http://com/", "http://com.", "ftp://user@host.net/es/x?y#z", "http://a.net/es", "http://a.net/es/",
    "http://a.net:80/es/", "http://x.net/fr/?q=http://com/", "x://y://com/z", "http://example.org?x", "http://a.example.org/any/", "http://q.test/any/thing",
    "http://a*b.net/*(x)", "http://c.b.net/Es/", "http://t.test/tracker.js", "http://t.test/ads/1", "http://t.test/loads/1", "http://t.test/ads",
    "http://exact.test/", "http://exact.test/1", "https://deep.sub.test/", "https://subx.test/", "http://t.test/a.b+c$d", "http://t.test/x123", "http://t.test/x123\n",
    "http://t.test/\u212aads/", "http://t.test/\u212aelvin", "http://t.test/é/", "http://t.test/only-and-here", "http://t.test/onlyhere/", "http://t.test/100%",
    "http://t.test/100%/", "line\nbreak://com/\n/en/", "http://casino/", "http://my-casino.test/a", "http://mycasino.test/a", "http://t.test/casino",
    "https://m.casino-win.example.org/en/", "http://blog.tionsh.example.org/en/5?utm_source=feed", "http://t.test/12345.html", "http://t.test/1234/",
    "http://t.test/de/a?page=2&ref=x", "http://a.com/" + "long/" * 20_000, "http://t.test/" + "z" * 100_000 + "/ads/",
]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def parts(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return fold(host), re.match(r"[^?#]*", rest[len(host):])[0]


def pattern_fits(pattern, url):
    p = fold(pattern)
    if len(p) > 2 and p[0] == p[-1] == "/":
        # Java's $ also stands before a last line end, as Python's does
        return re.search(pattern[1:-1], fold(url)) is not None
    head = r"\A[a-z][a-z0-9+.-]*://([^/?#]*\.)?" if p.startswith("||") else r"\A" if p.startswith("|") else ""
    body = p[2:] if p.startswith("||") else p[1:] if p.startswith("|") else p
    tail = ""
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    inner = "".join({"^": r"([^a-z0-9%]|\Z)", "*": ".*"}.get(c, re.escape(c)) for c in body)
    return re.search("(?s)" + head + inner + tail, fold(url)) is not None


def brute(page_id, url, sites, patterns):
    host, path = parts(url)
    fits = []
    for h, p, verdict in sites:
        h = fold(h)
        if url and "://" in url and (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), verdict == "block", h + p))
    if fits:
        _, blocks, rule = max(fits)
        return page_id, host, path, rule, "block" if blocks else "allow", None
    hits = [(v == "block", -len(p), p) for p, v in patterns if p and url is not None and pattern_fits(p, url)]
    if hits:
        blocks, _, pattern = min(hits)
        return page_id, host, path, None, "block" if blocks else "allow", pattern
    return page_id, host, path, None, "allow", None


def table(spark, urls):
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(3, urls[3], "again", "x"), (None, "http://t.test/ads/1", "no id", "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")


def check(spark, sites, patterns):
    rows, df = table(spark, URLS)
    got = sorted((tuple(r) for r in ur.judged(df, ur.rule_table(spark, sites, patterns)).collect()), key=str)
    want = sorted((brute(i, u, sites, patterns) for i, u, *_ in rows), key=str)
    assert got == want
    return want


def test_every_rule_on_every_url(spark):
    want = check(spark, SITES, PATTERNS)
    # an allow pattern that fits all hides the block patterns
    assert {w[4] for w in want} == {"allow", "block"}
    blocking = check(spark, SITES, [(p, v) for p, v in PATTERNS if p != "*"])
    assert {w[5] for w in blocking} >= {"tracker", "^ads^", "||Sub.Test^", "^only*here^", "|http://exact.test/|"}


def test_production_rules(spark):
    check(spark, ur.SITES, ur.PATTERNS)


def test_no_rules_and_no_pages(spark):
    none = ur.rule_table(spark, [], [])
    rows, df = table(spark, URLS)
    assert {(r.rule, r.verdict, r.pattern) for r in ur.judged(df, none).collect()} == {(None, "allow", None)}
    assert ur.judged(df.limit(0), ur.rule_table(spark, ur.SITES, ur.PATTERNS)).collect() == []


def test_rarest_token_and_shares(spark):
    urls = [f"http://common.test/{i}/rare{i % 50}/" for i in range(500)]
    rules = ur.pattern_rules(spark.createDataFrame([("||common.test^*^rare7^", "block"), ("/x/", "block"), ("^common^", "allow")], "pattern string, verdict string"))
    index = {r.rule: (r.token, r.parts) for r in ur.rule_index(rules, spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert index["||common.test^*^rare7^"] == ("rare7", 1)
    assert index["/x/"][0] == "" and index["/x/"][1] > 1
    assert index["^common^"][0] == "common" and index["^common^"][1] > 1


def test_no_python_in_the_plan(spark):
    _, df = table(spark, URLS)
    plan = ur.judged(df, ur.rule_table(spark, ur.SITES, ur.PATTERNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
