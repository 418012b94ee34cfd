import random

import pytest

from orbweave.llm import urls
from orbweave.llm.components import connected_components

PAGES = "page_id long, url string, html string, host string, rule string"


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + [(None, 5)], "a long, b long")).collect()}
    want = {k: v for k, v in _components([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def _judge(spark, rows, rules=urls.RULES, redirects=None):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    return {r["page_id"]: r for r in urls.judge_urls(df, rules, redirects).collect()}


def test_rules(spark):
    rows = [(1, "http://A.Example.COM/en/7?x", None), (2, "http://x.com/en/1", ""), (3, "http://example.net/de/8", None), (4, "http://z.example.net/de/9", None), (5, None, None),
            (6, "no scheme.com/en/", None), (7, "http://notcom/en/", None), (8, "http://com", None), (9, "https://b.org?x=/es/", None), (10, "https://b.org/es/", None), (10, "https://b.org/es/", None)]
    for rules in (urls.RULES, spark.createDataFrame(urls.RULES, "verdict string, host string, path string")):
        r = _judge(spark, rows, rules)
        assert {k: (v["host"], v["path"], v["rule"], v["verdict"]) for k, v in r.items()} == {
            1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("x.com", "/en/1", "com/en/", "block"), 3: ("example.net", "/de/8", "example.net/de/8", "block"),
            4: ("z.example.net", "/de/9", "net/de/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notcom", "/en/", None, "allow"), 8: ("com", "", None, "allow"),
            9: ("b.org", "", None, "allow"), 10: ("b.org", "/es/", "org/es/", "block")}


def test_blocks_travel_along_links_and_allow_prevails(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.io/x", canonical("HTTP://B.io/y#f")), (2, "http://b.io/y", '<meta http-equiv="refresh" content="0; url=/z">'), (3, "http://b.io/z#q", canonical("http://bad.com/en/1")),
            (4, "http://other.io/", canonical("")), (5, "http://m.example.com/en/71", canonical("http://bad.com/en/1")), (6, "http://b.io/y", None)]
    redirects = spark.createDataFrame([("http://c.io/1", "http://a.io/x"), (None, "http://a.io/x")], "source string, target string")
    r = _judge(spark, [*rows, (7, "http://c.io/1", None)], redirects=redirects)
    assert {k: v["verdict"] for k, v in r.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block"}
    assert r[5]["alias_blocked"] and r[1]["rule"] is None


def test_empty_table(spark):
    assert _judge(spark, []) == {}
