"""The judgement of whole page tables against plain Python: hosts, paths, rules, the host graph, both ranks, verdicts."""

import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import queries, url_filters

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(x.lower() if x.isascii() else x for x in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path, rules):
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def rank(edges, seeds, iterations=10, damping=0.85):
    total = sum(seeds.values())
    seeds = {h: n / total for h, n in seeds.items()} if total else {}
    out = Counter()
    for (a, _), w in edges.items():
        out[a] += w
    now = dict(seeds)
    for _ in range(iterations):
        new = defaultdict(float)
        for (a, b), w in edges.items():
            if a in now:
                new[b] += damping * now[a] * w / out[a]
        for h, s in seeds.items():
            new[h] += (1 - damping) * s
        now = dict(new)
    total = sum(now.values()) or 1.0
    return {h: x / total for h, x in now.items()}


def judged(pages, rules):
    rows, edges, allow, block = [], Counter(), Counter(), Counter()
    for page, url, html in pages:
        host, path = split(url)
        rule = rule_of(host, path, rules)
        rows.append((page, host, path, rule))
        if host:
            allow[host] += rule is not None and rule[0] == "allow"
            block[host] += rule is not None and rule[0] == "block"
            for m in re.finditer(r"""\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)""", html or "", re.I):
                to = split("x:" + m[1][m[1].index("//") :])[0]
                if to and to != host:
                    edges[host, to] += 1
    steps = set()
    for host in allow:
        labels = host.split(".")
        for k in range(len(labels) - 2):
            steps.add((".".join(labels[k:]), ".".join(labels[k + 1 :])))
    for low, high in steps:
        edges[low, high] += 1
        edges[high, low] += 1
    trust = rank(edges, {h: n for h, n in allow.items() if n})
    distrust = rank(Counter({(b, a): w for (a, b), w in edges.items()}), {h: n for h, n in block.items() if n})
    out = []
    for page, host, path, rule in rows:
        t, d = (trust.get(host, 0.0), distrust.get(host, 0.0)) if host else (None, None)
        own = "block" if host and d > t else "allow"
        out.append((page, host, path, rule and rule[1], rule[0] if rule else own, t, d))
    return out


def same(found, want):
    key = lambda r: tuple(map(str, r[:5]))
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for f, w in zip(found, want):
        assert (f[5] is None) == (w[5] is None) and (w[5] is None or (f[5:] == pytest.approx(w[5:], abs=1e-9)))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    same([tuple(r) for r in queries.op3_url_filters(spark, folder).collect()], judged(pages, RULES))


def test_linked_hosts(spark):
    """Links between hosts in every form, hosts of one label, repeated pages, nulls."""
    pages = [
        (1, "https://A.b.example.com/en/x?q#f", '<a href="//evil.net/es/">x</a> <a HREF=http://mid.org>'), (2, "http://evil.net/es/1", "<a href='https://www.example.com/en/'>"), (3, "http://mid.org", '<a href="ftp://far.mid.org:80/x">'),
        (4, "http://far.mid.org:80/", None), (5, "localhost", "<a href=http://no.org>"), (6, "x://localhost/en", '<a href="http://evil.net/q">'), (7, None, "x"), (8, "http://www.example.com/en/", ""), (8, "http://www.example.com/en/", ""), (9, "http://evil.net?es/", '<a href="/es/">'), (10, "http://net/fr/", "<a href=//Mid.ORG/x>"),
    ]
    table = spark.createDataFrame([(*p, 0.5) for p in pages], "page_id long, url string, html string, trust double")
    rules = [(v, h.partition("/")[0], "/" + h.partition("/")[2]) for v, h in RULES]
    same([tuple(r) for r in url_filters.filter_urls(table, rules).collect()], judged(pages, RULES))
