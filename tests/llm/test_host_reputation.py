import math
import os

import duckdb
import pytest

from tillscope.llm import fm_decontam, host_reputation as M, secret_links

SF = "/root/testdata/sf0.001"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, rule string")


def test_host_path_and_rules(spark):
    cases = [  # url, host, path, rule
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"),
        ("https://example.net/de/", "example.net", "/de/", "net/"),
        ("ftp://example.net", "example.net", "", None),
        ("http://example.net?x=/en/", "example.net", "", None),
        ("x://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/"),
        ("x://notexample.com/de/1", "notexample.com", "/de/1", None),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/"), ("x://a.org/FR/", "a.org", "/FR/", None),
        ("a://b.net/c://d.org/fr/", "b.net", "/c://d.org/fr/", "net/"),
        ("no scheme.net/en/", "", "", None), (None, "", "", None), ("", "", "", None), ("http://", "", "", None),
        ("http://ÉA.com/ü\n/x#y", "Éa.com", "/ü\n/x", None), ("http://a.net#/x/", "a.net", "", None)]
    got = {r.page_id: r for r in M.filter_urls(frame(spark, [c[0] for c in cases])).collect()}
    kinds = dict(M.RULES)
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == kinds.get(rule, "allow")


def moments(groups):
    groups = [(n, k) for n, k in groups if n]
    n, k, g = sum(x for x, _ in groups), sum(x for _, x in groups), len(groups)
    m = k / n
    spread = sum(a * (b / a - m) ** 2 for a, b in groups)
    rho = (spread - m * (1 - m) * (g - 1)) / (m * (1 - m) * (n - sum(a * a for a, _ in groups) / n - (g - 1)))
    return min(1e4, max(1.0, 1 / rho - 1)) if rho > 0 else 1e4


def test_posterior_against_brute_force(spark):
    hosts = {"a.x.com": (40, 39), "b.x.com": (3, 3), "c.x.com": (0, 0), "a.y.com": (50, 2), "b.y.com": (5, 0), "z.org": (30, 3), "w.org": (4, 4), "": (2, 1)}
    rows = [(h, int(i < k)) for h, (n, k) in hosts.items() for i in range(n)] + [(h, None) for h in hosts]
    got = {r.host: r for r in M.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    cut = lambda h, n: ".".join(h.split(".")[-n:])
    level = {n: {} for n in (1, 2)}
    for h, (n, k) in hosts.items():
        for x in (1, 2):
            a, b = level[x].get(cut(h, x), (0, 0))
            level[x][cut(h, x)] = (a + n, b + k)
    s = {0: moments(hosts.values()), 1: moments(level[1].values()), 2: moments(level[2].values())}
    mean = sum(k for _, k in hosts.values()) / sum(n for n, _ in hosts.values())
    for h, (n, k) in hosts.items():
        p = mean
        for x in (1, 2):
            a, b = level[x][cut(h, x)]
            p = (p * s[x] + b) / (a + s[x])
        p = (p * s[0] + k) / (n + s[0])
        assert got[h]["mean"] == pytest.approx(p) and got[h].sd == pytest.approx(math.sqrt(p * (1 - p) / (n + s[0] + 1)))
    pages = frame(spark, ["http://a.x.com/", "http://c.x.com/", "http://a.y.com/", "http://new.com/", None])
    verdicts = [r.verdict for r in M.filter_urls(pages, spark.createDataFrame(rows, "host string, bad int")).orderBy("page_id").collect()]
    assert verdicts[0] == "block" and verdicts[2:] == ["allow"] * 3


def test_odd_rows(spark):
    pages = frame(spark, [None, None, "http://a.com/", "http://a.com/", "http://" + "x" * 50_000 + ".com/" + "y" * 50_000])
    got = M.filter_urls(pages)
    assert got.count() == 5 and {"page_id", "url", "host", "path", "rule", "verdict"} == set(got.columns)
    assert M.filter_urls(pages.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out = M.page_outcomes(frame(spark, ["http://a.com/en/1", "http://b.com/en/2.html", "http://c.com/en/3", "http://d.com/en/" + "9" * 40, None]), labels)
    assert sorted((r.host, r.bad) for r in out.collect()) == [("a.com", 1), ("b.com", 0)]


@pytest.mark.parametrize("query, sql", [(M.op3_host_reputation, M.ORACLE), (fm_decontam.op1_fm_decontamination, fm_decontam.ORACLE),
                                        (secret_links.op2_secret_links, secret_links.ORACLE)])
def test_oracles(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    clean = lambda v: None if v is None else v
    a = sorted((tuple(clean(x) for x in r) for r in want.select(*cols).fetchall()), key=repr)
    assert a == sorted((tuple(r) for r in query(spark, SF).select(*cols).collect()), key=repr)


def test_registered_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com.au": ("x.com.au", "com.au"), "1.2.3.4": ("1.2.3.4", "address"),
            "10.2.3.4:8080": ("10.2.3.4:8080", "address"), "a.b.com": ("b.com", "com"), "co.info": ("co.info", "info"), "notco.uk": ("notco.uk", "uk"),
            "localhost": ("localhost", "localhost"), "": ("", "")}
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = M.domain_of(F.col("host"))
    assert {r.host: (r.d, r.s) for r in d.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want
