import itertools

import pytest

from rowgrove.llm import url_rules as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://a.example.org/en/12?x=/es/#f", "HTTP://Example.ORG/es/", "http://notexample.org/en/1", "http://example.org/en/1", "http://example.org", "x://y://example.org/es/", "http://com/de/1", "http://a.com/de", "http://a.com/de/#", "http://é.COM/fr/", "http://a..org//", "http://org?/es/", "http://x.example.org:80/en/1", "\n://org/\n"]


@pytest.mark.parametrize("rules", [u.RULES, (), (("block", "", ""), ("allow", "org", "")), (("block", "a.com", "/d"), ("allow", "com", "/de/"), ("block", "com", "/de/"), ("allow", "a.com", "/d"))])
def test_against_plain_rules(spark, rules):
    rows = list(enumerate(URLS)) + [(5, URLS[5])]
    df = spark.createDataFrame([(i, x, "clash", "clash") for i, x in rows], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    got = sorted(u.judge_urls(df, table).collect(), key=lambda r: (r.page_id, str(r.rule)))
    assert [tuple(r) for r in got] == [(i, *judged(x, rules)) for i, x in sorted(rows, key=lambda x: x[0])]
    assert u.judge_urls(df.where("false"), table).count() == 0


def test_many_rules_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(u, "BROADCAST_RULES", 3)
    rules = [(v, h, p) for (h, p), v in zip(itertools.product(["a.org", "b.a.org", "com"], ["/", "/x", "/x/y"]), itertools.cycle(["allow", "block"]), strict=False)]
    urls = [f"http://{h}{p}" for h in ("a.org", "c.b.a.org", "x.com", "z.net") for p in ("/", "/x/yz", "/q", "")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, u.judge_urls(df, u.rule_table(spark, rules), default="block").collect()))
    assert got == [(i, *judged(x, rules, "block")) for i, x in enumerate(urls)]


def test_no_false_match_on_a_short_hash(spark, monkeypatch):
    monkeypatch.setattr(u, "PREFIX_DIGITS", 1)
    urls = [f"http://h{i}.org/p{i % 7}" for i in range(200)]
    rules = [("block", f"h{i}.org", f"/p{i % 5}") for i in range(0, 200, 3)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, u.judge_urls(df, u.rule_table(spark, rules)).collect()))
    assert got == [(i, *judged(x, rules)) for i, x in enumerate(urls)]
