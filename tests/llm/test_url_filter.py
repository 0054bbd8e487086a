from carelog.llm.url_filter import RULES, judge_urls

URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "http://a.example.net/en", "http://a.example.net/en/?q#f",
        "https://notexample.net/en/", "x://org/fr/1", "x://my.ORG/fr/1?a=/b", "x://org/de", "x://net", "x://net/", "x://net?/en/",
        "x://example.com/de/", "x://m.example.com/de/a#b", "x://y.org#/fr/", "a://b://net/", "x://.net/", "x://net:80/", "x://net/"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for verdict, rule in RULES:
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(URLS)], "page_id long, url string, host string, short string")
    got = {r[0]: tuple(r[4:]) for r in judge_urls(pages).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_rows_and_default(spark):
    pages = spark.createDataFrame([(1, "x://net/"), (1, "x://net/"), (None, "x://a/")], "page_id long, url string")
    got = judge_urls(pages, default="block").select("page_id", "verdict").collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", "block"), ("1", "block"), ("None", "block")]
    assert judge_urls(pages.limit(0)).count() == 0


def test_native(spark):
    plan = judge_urls(spark.createDataFrame([(1, "x://net/")], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
