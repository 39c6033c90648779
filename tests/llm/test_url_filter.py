import math
import re
from collections import Counter

from pyspark.sql import functions as F

from poolsieve.llm import groups
from poolsieve.llm.url_filter import RULES, filter_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def model(urls):
    n, kinds = Counter(), {}
    for u in urls:
        s = "\x02" * 3 + u + "\x03"
        for i in range(3, len(s)):
            for k in range(4):
                n[s[i - k : i], s[i]] += 1
    total = Counter()
    for (h, c), m in n.items():
        total[h] += m
        kinds.setdefault(h, set()).add(c)

    def p(h, c):
        low = p(h[1:], c) if h else 1 / 256
        return (n[h, c] + len(kinds[h]) * low) / (total[h] + len(kinds[h])) if total[h] else low

    return p


def test_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    extra = [(None, "http://a.com/x"), (-1, None), (-2, ""), (-3, "no scheme/en/"), (-4, "HTTP://WWW.Example.COM/en/7x?a://b"), (-5, "http://xcom/en/"), (-6, "s://com/en/"), (-7, "s://org"), (-8, "s://h?/en/#"), (-9, "s://example.net/de/8/" + "x" * 50_000), (-1, None), (-10, "x://a.b\n/p\nq#r")]
    df = pages.unionByName(spark.createDataFrame(extra, pages.schema)).selectExpr("*", "1 AS host", "2 AS u", "3 AS score").repartition(3)
    got = filter_urls(df).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.url for r in rows}
    urls = {r.url or "" for r in rows}
    cal = {r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").where(F.pmod(F.xxhash64("u", F.lit("calibration")), F.lit(5)) == 0).collect()}
    verdict = {u: rule(*split(u))[1] for u in urls}
    models = [model([u for u in urls if verdict[u] == v and u not in cal]) for v in ("block", "allow")]

    def score(u):
        s = "\x02" * 3 + u + "\x03"
        return sum(math.log(models[1](s[i - 3 : i], s[i]) / models[0](s[i - 3 : i], s[i])) for i in range(3, len(s))) / (len(s) - 3)

    allowed, blocked = [], []
    for r in got:
        u = by[r.page_id]
        assert (r.host, r.path) == split(u)
        want = rule(*split(u))
        assert r.rule == want[0]
        if want[1]:
            assert r.verdict == want[1]
        else:
            assert abs(r.score - score(u or "")) < 1e-9
            (allowed if r.verdict == "allow" else blocked).append(r.score)
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(df).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/c")], df.schema)
    assert [tuple(r)[:5] for r in filter_urls(one).collect()] == [(1, "a.b", "/c", None, "allow")]


def test_hot_urls_are_dealt(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    more = [(1000 + i, u) for i in range(40) for u in (None, "http://hot.example/x", "s://a.com/en/")]
    df = pages.unionByName(spark.createDataFrame(more, pages.schema))
    plain = sorted(map(tuple, filter_urls(df).collect()), key=str)
    assert len(plain) == df.count() and all((r[5] is None) == (r[3] is not None) for r in plain)
    monkeypatch.setattr(groups, "LEAST", 5)
    monkeypatch.setattr(groups, "HOT_KEYS", 50)
    assert sorted(map(tuple, filter_urls(df).collect()), key=str) == plain


def test_kept_columns_with_the_names_of_results(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "x")], "page_id long, url string, host string")
    (r,) = filter_urls(df, keep=["page_id", "host", "url"]).collect()
    assert (r.page_id, r.url, r.host) == (1, "http://a.b/c", "a.b") and len(r) == 7
