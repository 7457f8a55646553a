import random

import duckdb
import pytest

from graphloom.llm import urls

PAGES = "page_id long, url string, key string, action string"
RULES = "rule_id long, pattern string, action string"


def key_of(url):
    rest = url.split("//", 1)[-1].split("#")[0]
    cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    return ",".join(reversed(host.split("."))) + "," + (path if path.startswith("/") else "/" + path)


def brute(pages, rules):
    out = set()
    for i, url in pages:
        covering = []
        for r, pattern, action in rules:
            key = key_of(pattern)
            prefix = key if "/" in pattern else key[:-1]
            if key_of(url).startswith(prefix):
                covering.append((len(prefix), r, action))
        if covering:
            _, r, action = max(covering)
            out.add((i, r, action, len(covering)))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_against_all_pairs(spark, ranges):
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "ab", "c-d", "Ü"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join("/" + label() for _ in range(rng.randrange(3)))
    pages = [(i, f"https://{host()}{path()}{rng.choice(['', '?q=1', '#x', '/'])}") for i in range(400)]
    rules = [(i, host() + (path() or "/") if rng.random() < 0.5 else host(), rng.choice(["block", "allow"])) for i in range(60)]
    got = urls.url_decisions(spark.createDataFrame([(i, u, "k", "z") for i, u in pages], PAGES), spark.createDataFrame(rules, RULES), ranges).collect()
    assert {tuple(r) for r in got} == brute(pages, rules) and len(got) > 50


def test_edge_cases(spark):
    pages = [(1, None, "k", "z"), (2, "", "k", "z"), (None, "http://x.org/", "k", "z"), (3, "http://x.org/" + "a" * 100_000, "k", "z"), (4, "HTTP://user:pw@X.ORG.:80/a", "k", "z"), (4, "HTTP://user:pw@X.ORG.:80/a", "k", "z"), (5, "x.org?b", "k", "z"), (6, "http://notx.org/", "k", "z")]
    rules = [(1, "x.org", "block"), (1, "x.org", "block"), (2, None, "block"), (None, "x.org", "allow"), (3, "x.org/a", None), (4, "x.org/a", "allow")]
    df, lines = spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES)
    got = sorted(map(tuple, urls.url_decisions(df, lines).collect()))
    assert got == [(3, 4, "allow", 3), (4, 4, "allow", 3), (4, 4, "allow", 3), (5, 1, "block", 2)]
    assert urls.url_decisions(df.limit(0), lines).count() == 0 and urls.url_decisions(df, lines.limit(0)).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    assert sorted(map(tuple, urls.op6_url_filters(spark, folder).collect())) == sorted(con.execute(urls.OP6_SQL).fetchall())


def test_many_nested_rules(spark):
    rng = random.Random(3)
    base = ["/".join([f"h{k}.org", *("a" * n for n in range(1, 9))]) for k in range(3000)]
    patterns = [b[: b.index("/")] if n == 0 else "/".join(b.split("/")[: n + 1]) for b in base for n in range(9)]
    patterns += [f"s{i}.d{i % 7}.net" for i in range(75_000)]
    rules = [(i, p, "block" if i % 3 else "allow") for i, p in enumerate(patterns)]
    pages = [(i, f"http://{rng.choice(base)[: rng.randrange(8, 60)]}") for i in range(3000)] + [(10_000 + i, f"https://x.s{rng.randrange(100_000)}.d{i % 7}.net/q") for i in range(3000)]
    known = {}
    for i, p, action in rules:
        key = key_of(p)
        known[key if "/" in p else key[:-1]] = (i, action)
    want = set()
    for i, u in pages:
        key = key_of(u)
        covering = [known[key[:n]] for n in range(1, len(key) + 1) if key[:n] in known]
        if covering:
            want.add((i, *covering[-1], len(covering)))
    got = urls.url_decisions(spark.createDataFrame([(i, u, "k", "z") for i, u in pages], PAGES), spark.createDataFrame(rules, RULES), 8).collect()
    assert len(rules) > 100_000 and {tuple(r) for r in got} == want and len(want) > 3000


def test_equal_rules_and_one_range_for_each_task(spark):
    rules = [(1, "x.org", "block"), (2, "x.org", "allow"), (3, "x.org/", "block"), (9, "x.org/", "allow"), (5, "x.org/", "block")]
    got = urls.url_decisions(spark.createDataFrame([(1, "http://x.org/a", "k", "z"), (2, "http://y.x.org", "k", "z")], PAGES), spark.createDataFrame(rules, RULES)).collect()
    assert {tuple(r) for r in got} == {(1, 9, "allow", 5), (2, 2, "allow", 2)}
    dealt = urls._dealt(spark, 37)
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(dealt)], "range int, deal long").repartition(37, "deal").selectExpr("range", "spark_partition_id() AS task").collect()
    assert all(r.range == r.task for r in rows)
