"""Operator 2 against a direct reading of the rules."""

import time

from saleslens.llm import url_filter


def direct(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path, at = "", "", 0
    while at < len(rest) and rest[at] not in "/?#":
        at += 1
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    fits = []
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    best = max(fits) if fits else None
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x", "http://a.example.net/de/", "http://example.net",
    "http://net/", "http://xnet/", "http://a.b.net/?q#f", "ftp://w.example.com/de/1#t", "http://example.com/d",
    "x://y.org/fr/?://z.net/", "http://org/fr", "http://u@example.net:80/en/", "http://ünet/é", "http://..net/",
]


def check(spark, rules):
    pages = spark.createDataFrame([(i % 5, u, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "action string, rule string")
    got = sorted(map(str, (tuple(r) for r in url_filter.judge_urls(pages, table).collect())))
    assert got == sorted(str((i % 5, *direct(u, rules))) for i, u in enumerate(URLS * 2))


def test_the_four_rules(spark):
    check(spark, list(url_filter.RULES))


def test_long_lists_and_a_full_filter(spark, monkeypatch):
    rules = list(url_filter.RULES) + [("block", f"h{i}.test/p{i}/") for i in range(500)] + [("block", "example.net/en/x")]
    check(spark, rules)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", 1)
    check(spark, rules)


def test_no_rules_and_no_pages(spark):
    empty = spark.createDataFrame([], "action string, rule string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, empty).collect()] == [(1, "a.net", "/", None, "allow")]
    table = spark.createDataFrame(list(url_filter.RULES), "action string, rule string")
    assert url_filter.judge_urls(pages.limit(0), table).collect() == []


def test_very_long_urls(spark):
    long_host = "a." * 40_000 + "example.net"
    rows = [(1, f"http://{long_host}/en/x"), (2, "http://" + "b" * 100_000 + "/fr/"), (3, "http://x.org/fr/" + "p/" * 50_000), (4, "http://" + "." * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(list(url_filter.RULES), "action string, rule string")
    begun = time.monotonic()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert time.monotonic() - begun < 60
    assert got == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow")}
