"""Lexical features of URLs against their definitions, and very long URLs."""

import math
import random
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantscope.llm import url_filter


def plain(url, host, path):
    """The features by their names, from the URL alone."""
    url = url or ""
    data = url.encode("utf-8", "replace")
    shares = [n / len(data) for n in Counter(data).values()] if data else []
    rest, _, _ = url.partition("#")
    query = rest.split("?", 1)[1] if "?" in rest else ""
    return [
        len(url), len(host), len(path), path.count("/"), sum(map(str.isdigit, url)) / max(1, len(url)), sum(map(str.isdigit, host)), -sum(p * math.log2(p) for p in shares), sum(bool(x) for x in query.split("&")), len(query),
        "#" in url, host.count("."), host.count("-"), sum(c in "-_" for c in path), path[-1:] == "/", "." in path.split("/")[-1], url[:5] == "https",
    ]


def test_features_against_brute_force():
    rng = random.Random(1)
    urls = [None, "", "x", "https://a.example.com/", "http://1-2.example.org/a_b/c-d.html?x=1&&y=2#f", "https://é.example/ü?", "no scheme/?a&b#?c", "http://h/" + "a1" * 50_000]
    urls += ["".join(rng.choice("abc0129./-_?&=#:é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    parts = [urlsplit("http://h/") if u is None or "://" not in u else urlsplit(u.partition("#")[0].replace("[", "").replace("]", "")) for u in urls]
    hosts, paths = [p.netloc for p in parts], [p.path for p in parts]
    folds, slots = np.array([rng.randrange(url_filter.FOLDS) for _ in urls]), np.array([rng.randrange(7) for _ in urls])
    stats = np.random.default_rng(1).random((url_filter.FOLDS, 7, 2)).astype(np.float32)
    found = url_filter.features(urls, hosts, paths, folds, slots, stats)
    want = [[*plain(u, h, p), *stats[f, s]] for u, h, p, f, s in zip(urls, hosts, paths, folds, slots, strict=True)]
    assert found == pytest.approx(np.array(want, np.float32), rel=1e-5, abs=1e-6)


def test_very_long_urls(spark):
    long = "http://www.Example.com/en/" + "x/" * 200_000 + "?" + "q=1&" * 100_000
    df = spark.createDataFrame([(1, long), (2, None), (3, "http://casino.example.net/de/1")], "page_id long, url string")
    rules = [url_filter.Rule.of("com/en/", False), url_filter.Rule.of("net/de/", True)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark, df, rules, labelled=url_filter.by_host_words(df)).select("page_id", "host", F.length("path").alias("n"), "rule", "verdict").collect()}
    assert (got[1].host, got[1].n, got[1].rule, got[1].verdict) == ("www.example.com", 4 + 400_000, "com/en/", "block")
    assert got[3].verdict == "allow" and got[2].rule is None
