import random
from itertools import combinations

from vaporline.llm import queries, url_filter as U

SCHEMA = "page_id long, url string, html string, host string, verdict string, rule string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "x", "y", "z") for i, u in urls], SCHEMA)


def test_stated_rules(spark):
    urls = {
        1: "http://A.Example.NET/en/x?q#f",
        2: "http://b.net/de/",
        3: "http://b.net",
        4: "https://example.com/de/1",
        5: "https://notexample.com/de/1",
        6: "https://x.org/fr/",
        7: "no scheme net/",
        8: None,
        9: "",
        10: "a://b://c/d",
        11: "http://b.net:80/",
        12: "http://x.org?/fr/",
    }
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(spark, urls.items()), queries.URL_RULES, mined=[]).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("b.net", "/de/", "net/", "block"),
        3: ("b.net", "", None, "allow"),
        4: ("example.com", "/de/1", "example.com/de/", "block"),
        5: ("notexample.com", "/de/1", None, "allow"),
        6: ("x.org", "/fr/", "org/fr/", "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("b:", "//c/d", None, "allow"),
        11: ("b.net:80", "/", None, "allow"),
        12: ("x.org", "", None, "allow"),
    }


def brute(rows, support, confidence):
    """All combinations of tokens, counted."""
    every, strong = {}, {}
    for have, verdict in rows:
        for n in range(1, len(have) + 1):
            for part in combinations(sorted(have), n):
                every[part] = every.get(part, 0) + 1
                if verdict:
                    strong[part, verdict] = strong.get((part, verdict), 0) + 1
    rows_n = len(rows)
    found = [U.MinedRule(p, v, n, n / every[p]) for (p, v), n in strong.items() if n >= support * rows_n and n / every[p] >= confidence]
    return [r for r in found if not any(o.verdict == r.verdict and set(o.tokens) < set(r.tokens) and o.confidence >= r.confidence for o in found)]


def test_mined_rules_against_brute_force(spark):
    r = random.Random(2)
    urls = [(i, f"http://{r.choice(('www', 'm', 'blog'))}.{r.choice('abc')}.{r.choice(('com', 'net', 'org'))}/{r.choice(('en', 'de', 'fr'))}/{r.choice('12')}{r.choice(('', '.html', '?a=1'))}") for i in range(400)]
    frame = U.described(pages(spark, urls), queries.URL_RULES, "page_id", "url")
    rows = [(x.tokens, x.stated) for x in frame.collect()]
    mined = U.mine(frame.select("tokens", "stated"), min_support=0.02, min_confidence=0.8)
    assert sorted(mined, key=str) == sorted(brute(rows, 0.02, 0.8), key=str) and mined
    index = U.Index(mined)
    got = {x.page_id: x.verdict for x in U.judge(pages(spark, urls), queries.URL_RULES, min_support=0.02).collect()}
    for (i, _), (have, stated) in zip(urls, rows):
        fits = sorted((m for m in mined if set(m.tokens) <= set(have)), key=U.MinedRule.rank)
        assert index.verdict(have, "allow") == (fits[0].verdict if fits else "allow")
    stated = {x.page_id: x.stated for x in frame.collect()}
    assert all(got[i] == s for i, s in stated.items() if s)


def test_empty_and_repeated_rows(spark):
    assert U.judge(pages(spark, []), queries.URL_RULES).count() == 0
    assert U.judge(pages(spark, [(1, None), (None, None), (2, "x"), (2, "x")]), queries.URL_RULES).count() == 4


def test_mined_rules_decide_unlabelled_urls(spark):
    labelled = [(i, f"https://www.ads.com/de/{i}") for i in range(10)] + [(100 + i, f"https://www.good.org/fr/{i}") for i in range(10)]
    others = [(200 + i, f"https://www.ads.com/es/{i}") for i in range(30)] + [(300, "https://www.good.org/es/1")]
    rules = [U.HostRule("ads.com", "/de/", "block"), U.HostRule("good.org", "/fr/", "allow")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages(spark, labelled + others), rules, default="unknown").collect()}
    assert all(got[200 + i] == (None, "block") for i in range(30)) and got[300] == (None, "allow")
