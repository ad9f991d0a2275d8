"""Hosts, paths, rules and the learned verdicts."""

import pytest
from pyspark.sql import functions as F

from mailsift.llm import urlmodel

CASES = [
    ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://a.example.com/de/1", "a.example.com", "/de/1", "com/", "allow"),
    ("ftp://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://é.NET/fr/a", "é.net", "/fr/a", "net/fr/", "block"),
    ("http://plain.com", "plain.com", "", None, None),
    ("http://dotcom/x", "dotcom", "/x", None, None),
    ("no scheme", "", "", None, None),
    ("x://y://z.com/q", "y:", "//z.com/q", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://a.org/" + "p" * 20000, "a.org", "/" + "p" * 20000, None, None),
]


def run(spark, urls):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("gram", F.lit(1)).withColumn("score", F.lit("s"))
    return {r.page_id: r for r in urlmodel.judge_urls(pages).collect()}


def test_hosts_paths_and_rules(spark):
    found = run(spark, [c[0] for c in CASES] * 2)
    assert len(found) == 2 * len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_the_model_separates(spark):
    good = [f"https://shop{i}.com/news/{i}" for i in range(150)]
    bad = [f"https://bad{i}.net/es/casino-win-{i}" for i in range(150)]
    asked = [f"https://z{i}.org/news/{i}" for i in range(20)] + [f"https://bad{i}.org/casino-win-{i}" for i in range(20)]
    found = run(spark, good + bad + asked)
    verdicts = [found[300 + i].verdict for i in range(40)]
    assert verdicts[:20].count("allow") >= 18 and verdicts[20:].count("block") >= 18


@pytest.mark.parametrize("urls", [[], [None], ["http://a.org/x"], ["http://a.com/x", "http://b.com/y"]])
def test_small_tables(spark, urls):
    found = run(spark, urls)
    assert len(found) == len(urls) and all(r.verdict == "allow" for r in found.values())
