import re

from groundmill.llm import urls

URLS = [
    (1, "http://a.example.com/en/1?x"), (2, "https://www.example.com/en/"), (3, "https://EXAMPLE.com/en/p#q"), (4, "http://example.com/fr/"), (5, "http://b.net/es/x"),
    (6, "http://net/fr/"), (7, "http://notnet/fr/"), (8, "http://x.net/en/"), (9, "http://x.com"), (10, None), (11, ""), (12, "no scheme"), (13, "http://my.casino.org/a"),
    (14, "http://casinos.org/a"), (15, "http://x.com/casino"), (2, "https://www.example.com/en/"), (None, "http://q.com/"), (16, "x://y.com?/en/"), (17, "http://x.net/ES/"), (18, "http://m.www.example.com/en/é"),
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if re.search(r"(?<![A-Za-z0-9])(casino|porn|torrent|viagra|xxx)(?![A-Za-z0-9])", host + path) else "allow"


def test_verdicts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    got = sorted(urls.judge_urls(df).collect(), key=str)
    want = sorted([(i, *brute(u)) for i, u in URLS], key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert urls.judge_urls(df, rules=[]).where("verdict = 'allow' and rule is null").count() == len(URLS)


def test_main_path_is_native(spark):
    plan = urls.judge_urls(spark.createDataFrame([(1, "a")], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rules_without_a_token(spark):
    rules = [urls.host_rule("block", "example"), urls.host_rule("allow", "example.org/"), urls.Rule("block", "sub", "^sub", (), 50), urls.Rule("block", "any", "zz", (), 0, True)]
    assert not rules[0].tokens and rules[1].tokens
    pages = [(1, "http://a.example/x"), (2, "http://example.org/"), (3, "http://sub.example.org/"), (4, "http://x.com/zz"), (5, "http://x.com/"), (5, "http://x.com/"), (None, "http://examples.com"), (6, None)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()), key=str)
    want = [(1, "example", "block"), (2, "example.org/", "allow"), (3, "sub", "block"), (4, None, "block"), (5, None, "allow"), (5, None, "allow"), (None, "example", "block"), (6, None, "allow")]
    assert got == sorted(want, key=str)
