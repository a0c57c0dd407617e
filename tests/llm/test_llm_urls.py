"""URL rules and character models against plain Python."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factorloom.llm import urls
from factorloom.llm.queries import URL_RULES


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    best = None
    for kind, rule in URL_RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://Ä.EXAMPLE.Com/x?y#z", "x://example.com/en/1", "x://www.example.com/en/1", "x://a.www.example.com/en/",
        "x://notexample.com/en/", "x://com/", "x://com", "x://a.net/es/", "x://a.net/es", "x://net/fr/?q=://b.com/", "x://a.org#/b.com/", "x://a.com?/en/", "a://b\n.com/c\nd"]


def test_rules_and_whole_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(URLS)], "page_id long, url string")
    both = pages.unionAll(extra).withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {r["page_id"]: r for r in urls.filter_urls(both, URL_RULES).collect()}
    rows = both.collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = plain(r["url"])
        rule = plain_rule(host, path)
        out = got[r["page_id"]]
        assert (out["host"], out["path"]) == (host, path), r["url"]
        assert out["rule"] == (rule and rule[1])
        if rule:
            assert out["verdict"] == rule[0] and out["difference"] is None
        else:
            assert out["verdict"] in ("allow", "block") and out["difference"] is not None


def test_models_equal_plain_counts():
    accepted, rejected = ["a.com/x", "b.com/y", "a.com/x"], ["a.net/x", "c.net/é"]
    counts = np.zeros((2, 2, urls.CELLS), "int64")
    plain_counts = []
    for kind, group in ((0, rejected), (1, accepted)):
        contexts, grams, _ = urls.cells_of(group)
        counts[kind, 0] = np.bincount(contexts.ravel(), minlength=urls.CELLS)
        counts[kind, 1] = np.bincount(grams.ravel(), minlength=urls.CELLS)
        c = Counter()
        for u in group:
            data = bytes(urls.ORDER) + u.encode() + b"\x01"
            for i in range(urls.ORDER, len(data)):
                for k in range(urls.ORDER + 1):
                    c[data[i - k : i]] += 1
                    c[data[i - k : i], data[i]] += 1
        plain_counts.append(c)

    def logp(c, data, i):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            p = (c[data[i - k : i], data[i]] + urls.PRIOR * p) / (c[data[i - k : i]] + urls.PRIOR)
        return math.log(min(p, 1))

    tests = ["a.com/x", "zz", "", "c.net/é"]
    want = []
    for u in tests:
        data = bytes(urls.ORDER) + u.encode() + b"\x01"
        at = range(urls.ORDER, len(data))
        want.append(sum(logp(plain_counts[1], data, i) - logp(plain_counts[0], data, i) for i in at) / len(at))
    assert np.allclose(urls.UrlModels(counts).difference(tests), want)
    assert want[0] > 0 > want[3]


def test_more_grams_than_cells_are_counted_exactly(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 40)) for _ in range(6000)]
    rows = [(i, f"http://h{i % 9}.{'com/' if i % 2 else 'net/es/'}{t}") for i, t in enumerate(texts)]
    asked = [(-1 - i, f"http://h{i}.org/{t[:20]}{t[5:]}") for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(rows + asked, "page_id long, url string")
    held = {r["page_id"] for r in df.where(F.pmod(F.xxhash64("url"), F.lit(urls.CALIBRATE)) == 0).select("page_id").collect()}
    counts = [Counter(), Counter()]
    for i, u in rows:
        if i not in held:
            data, c = bytes(urls.ORDER) + u.encode() + b"\x01", counts[i % 2]
            for j in range(urls.ORDER, len(data)):
                for k in range(urls.ORDER + 1):
                    c[data[j - k : j + 1], k] += 1
                    c[data[j - k : j]] += 1
    assert len(counts[0] | counts[1]) > 2 * urls.CELLS

    def logp(c, data, j):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            p = (c[data[j - k : j + 1], k] + urls.PRIOR * p) / (c[data[j - k : j]] + urls.PRIOR)
        return math.log(min(p, 1))

    got = {r["page_id"]: r["difference"] for r in urls.filter_urls(df, URL_RULES).collect()}
    for i, u in asked:
        data = bytes(urls.ORDER) + u.encode() + b"\x01"
        at = range(urls.ORDER, len(data))
        assert np.isclose(got[i], sum(logp(counts[1], data, j) - logp(counts[0], data, j) for j in at) / len(at))


def test_models_tell_planted_kinds_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'spam'}{i % 37}.{'com' if i % 2 else 'net'}/{'es/' if i % 2 == 0 else ''}{i}") for i in range(600)]
    rows += [(1000, "http://good5.org/71"), (1001, "http://spam5.org/es/72"), (1002, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, URL_RULES).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_empty_and_one_sided(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.filter_urls(df, URL_RULES).collect()} == {"allow"}
    assert urls.filter_urls(df.where("false"), URL_RULES).collect() == []
