import itertools
import math
import random
import re
from collections import Counter

from tallymark.llm import op2_url_filter as m


def parts(url):
    if not url or "://" not in url:
        return "", "", ""
    host, rest = re.match(r"(?s)([^/?#]*)(.*)", url.split("://", 1)[1]).groups()
    path, tail = re.match(r"(?s)([^?#]*)(.*)", rest).groups()
    return re.sub("[A-Z]", lambda x: x[0].lower(), host), path, tail


def listed(host, path):
    fit = [r for r in m.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def tokens(host, path, tail):
    names = host.split(".")
    return frozenset(["host:" + x for x in names] + ["top:" + names[-1]] + ["path:" + re.sub("[0-9]+", "#", x.lower()) for x in path.split("/") if x] + ["query:" + x.lower() for x in re.findall(r"[?&]([^=&#]+)", tail)])


def bound(h, n, z=1.96):
    p, zz = h / n, z * z
    return round((p + zz / (2 * n) - z * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 9)


def brute(rows, mining=m.Mining()):
    """All token combinations counted one by one."""
    split = {u: parts(u) for _, u in rows}
    train = [(tokens(*split[u]), r.verdict) for _, u in rows if (r := listed(*split[u][:2]))]
    n = len(train)
    floor = max(mining.min_pages, math.ceil(mining.min_support * n))
    single = Counter(t for s, _ in train for t in s)
    by_label = Counter((t, v) for s, v in train for t in s)
    keep = {t for t, c in single.items() if c <= mining.max_share * n}
    mixed = sorted((t for t in keep if single[t] >= floor and all(by_label[t, v] < single[t] for v in ("allow", "block"))), key=lambda t: (-single[t], t))
    sets, hits = Counter(), Counter()
    for s, v in train:
        for c in [(t,) for t in s & keep] + [c for k in range(2, len(mixed) + 1) for c in itertools.combinations(sorted(s & set(mixed)), k)]:
            sets[c] += 1
            hits[c, v] += 1
    rules = {(c, v): (bound(h, sets[c]), h) for (c, v), h in hits.items() if h >= floor and bound(h, sets[c]) >= mining.min_confidence}
    rules = {(c, v): x for (c, v), x in rules.items() if not any((d, v) in rules and rules[d, v][0] >= x[0] for k in range(1, len(c)) for d in itertools.combinations(c, k))}
    out = []
    for i, u in rows:
        host, path, tail = split[u]
        r = listed(host, path)
        fit = [(*x, v) for (c, v), x in rules.items() if set(c) <= tokens(host, path, tail)]
        out.append((i, host, path, r.host + r.path if r else None, r.verdict if r else max(fit)[2] if fit else "allow"))
    return sorted(out, key=str)


ODD = [None, "", "no scheme/en/", "http://", "https://EXAMPLE.com/en/x", "http://www.Example.com/en/", "http://net/es/", "http://a.net/fr/9?x=1#y", "ftp://com", "http://com/", "http://com?q", "a://b://c/d", "http://xcom/", "http://É.org/fr/ü#q?z", "http://a.org/fr/1\n?b=2&c"]


def test_odd_urls(spark):
    rows = list(enumerate(ODD)) + [(None, ODD[4]), (4, ODD[4])]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, tokens string")
    mining = m.Mining(min_support=0.2, min_pages=1, min_confidence=0.3)
    got = sorted(map(tuple, m.judge_urls(pages, mining=mining).collect()), key=str)
    assert got == brute(rows, mining)
    assert m.judge_urls(pages.limit(0)).count() == 0
    assert [r.verdict for r in m.judge_urls(pages.where("page_id < 4")).collect()] == ["allow"] * 4


def test_query_matches_brute_force(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()]
        assert sorted(map(tuple, m.op2_url_filter(spark, folder).collect()), key=str) == brute(rows)


def test_many_shared_tokens_end_soon(spark):
    rng = random.Random(1)
    long = "/".join(f"seg{i}x" for i in range(40))
    urls = [f"http://a.com/{long}/{i}" for i in range(60)] + [f"http://a.net/es/{long}?{'&'.join(f'k{j}=1' for j in rng.sample(range(30), 15))}" for i in range(60)] + [f"http://b.org/{long}"] * 30 + [f"http://c.org/?k{i % 30}=1" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in m.judge_urls(pages).collect()}
    assert all(got[i] == ("block" if 60 <= i < 120 else "allow") for i in range(120))
    assert sum(got[i] == "block" for i in range(150, 210)) > 40  # keys that only blocked pages have


def test_rules_of_one_page_decide_nothing(spark):
    rows = [(i, f"http://shop{i}.com/x") for i in range(50)] + [(100, "http://a.net/es/only"), (101, "http://q.org/only")]
    got = {r.page_id: r.verdict for r in m.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[101] == "allow" and got[100] == "block"


def test_rules_among_many_frequent_tokens(spark):
    """Two tokens that together always mean block, behind sixteen more frequent ones."""
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        p, q = rng.random() < 0.5, rng.random() < 0.4
        keys = [f"c{j}" for j in range(16) if rng.random() < 0.75] + ["p"] * p + ["q"] * q
        rows.append((sorted(f"query:{k}" for k in keys), "block" if p and q else "allow" if rng.random() < 0.85 else "block"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, listed string")
    rules, same = m.mine_rules(labelled, m.Mining())
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.hits) for r in rules.collect()}
    hits = sum({"query:p", "query:q"} <= set(t) for t, _ in rows)
    assert got[("query:p", "query:q"), "block"] == (bound(hits, hits), hits) and not same


def test_tokens_that_come_together_are_one(spark):
    rows = [([*(f"s{j:02}" for j in range(40)), *(["x"] if i % 2 else [])], "block" if i % 2 and i % 3 else "allow") for i in range(300)] + [(["x", "other"], "allow")] * 100
    rules, same = m.mine_rules(spark.createDataFrame(rows, "tokens array<string>, listed string"), m.Mining(min_confidence=0.55))
    assert set(same) == {f"s{j:02}" for j in range(1, 40)} and set(same.values()) == {"s00"}
    assert (["s00", "x"], "block") in [(r.tokens, r.verdict) for r in rules.collect()]


def test_rare_rules_of_three_tokens_among_many_pairs(spark):
    """Three keys mean block only together, on fewer pages than each of 240 pairs of other keys has on average."""
    rng = random.Random(5)
    keys = [f"?{'&'.join(f'{rng.choice("abcd")}{x}=1' for x in rng.sample('uvwxyz', 4))}" for _ in range(2000)]
    keys = [(x, rng.random() < 0.5) for x in keys] + [("?p=1&q=1&r=1", True)] * 25 + [(f"?{x}=1&{y}=1", False) for x, y in ("pq", "pr", "qr") for _ in range(15)]
    urls = [f"http://a.net/es/{x}" if blocked else f"http://a.com/{x}" for x, blocked in keys] + ["http://b.org/?p=2&q&r", "http://b.org/?q=1&r=1", "http://b.org/?r&z&q&p"]
    rows = list(enumerate(urls))
    got = sorted(map(tuple, m.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=str)
    assert got == brute(rows)
    assert [{r[0]: r[4] for r in got}[len(keys) + i] for i in range(3)] == ["block", "allow", "block"]


def test_pages_that_are_all_alike(spark):
    for url in ("http://a.com/x", "http://a.net/es/"):
        rows = [(i, url) for i in range(40)] + [(50, "http://a.org/x"), (51, "http://b.org/es")]
        assert sorted(map(tuple, m.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=str) == brute(rows)


def test_least_hits():
    for confidence in (0.0, 0.3, 0.55, 0.8, 0.95, 0.999):
        least = m.least_hits(confidence)
        assert all(bound(h, h) < confidence for h in range(1, least)) and bound(least + 2, least + 2) >= confidence
