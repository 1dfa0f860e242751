import math
import re
from collections import defaultdict

from carelens.llm import host_reputation as H


def url_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)), m.group(2)) if m else ("", "")


def brute(pages, outcomes):
    parts = {i: url_parts(u) for i, u in pages}
    worst = {}
    for i, b in outcomes:
        if b is not None:
            worst[i] = max(worst.get(i, 0), b)
    hosts = defaultdict(lambda: [0, 0])
    for i, _ in pages:
        counts = hosts[parts[i][0]]  # also of hosts without an outcome
        if i in worst:
            counts[0] += 1
            counts[1] += worst[i]

    def up(groups, key):
        out = defaultdict(lambda: [0, 0])
        for g, (n, k) in groups.items():
            out[key(g)][0] += n
            out[key(g)][1] += k
        return out

    def strength(groups, prior):
        a = sum((k - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (n, k) in groups.items())
        b = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, k) in groups.items())
        rho = a / b if b else 0
        return max(1.0, min(10_000.0, 1 / rho - 1)) if rho > 0 else 10_000.0

    def level(h, n):
        name = re.sub(":[0-9]*$", "", h)
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", name):
            return name
        labels = name.split(".")
        return ".".join(labels[-(n + (".".join(labels[-2:]) in H.SECOND_LEVEL)):])

    def domain(h):
        return level(h, 2)

    def suffix(h):
        return level(h, 1)

    domains, blocked = up(hosts, domain), set()
    if any(n for n, _ in hosts.values()):
        suffixes = up(domains, suffix)
        n, k = (sum(v[j] for v in suffixes.values()) for j in (0, 1))
        prior = {s: k / n for s in suffixes}
        for groups, below in ((suffixes, domains), (domains, hosts), (hosts, None)):
            m = strength(groups, prior)
            mean = {g: (k + m * prior[g]) / (n + m) for g, (n, k) in groups.items()}
            if below is not None:
                prior = {g: mean[suffix(g) if below is domains else domain(g)] for g in below}
        blocked = {h for h, (n, _) in hosts.items() if mean[h] - 1.645 * math.sqrt(mean[h] * (1 - mean[h]) / (n + m + 1)) > 0.5}
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    out = set()
    for i, _ in pages:
        host, path = parts[i]
        fits = [(len(r), r, v) for r, v in rules if (("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1]))]
        rule, said = max(fits)[1:] if fits else (None, "block" if host in blocked else "allow")
        out.add((i, host, path, rule, said))
    return out


URLS = ["http://www.example.com/en/1", "https://Example.COM/en/x?q#f", "http://b.example.com/en", "http://x.net/es/1?a", "http://x.net/ES/", None, "",
        "no scheme", "ftp://a.b.net/fr/", "http://com/", "http://com", "http://example.org?x=/en/", "http://ÉX.org/pÀ", "a://b://c.com/d", "http://bad.org/1"]
MORE = ["http://a.shop.co.uk/", "http://b.shop.co.uk/x", "https://c.other.co.uk", "http://co.uk/", "http://x.com:8080/a", "http://10.1.2.3/q", "http://10.1.2.3:81/"]


def test_like_brute_force(spark):
    pages = [(i, URLS[i % len(URLS)]) for i in range(600)]
    outcomes = [(i, int(i % len(URLS) == 14 or i % 7 == 0)) for i in range(0, 600, 2)] + [(3, None), (10**6, 1), (14, 0), (14, 1), (None, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS n", "2 AS bad", "3 AS verdict")
    o = spark.createDataFrame(outcomes, "page_id long, bad int").selectExpr("*", "'y' AS host")
    rows = H.judged_pages(p, o).collect()
    assert len(rows) == len(pages) and set(map(tuple, rows)) == brute(pages, outcomes)
    assert {r["verdict"] for r in rows if r["host"] == "bad.org"} == {"block"}


def test_edges(spark):
    p = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = H.judged_pages(p, none).collect()
    assert len(rows) == len(URLS) + 1 and set(map(tuple, rows)) == brute(list(enumerate(URLS)), [])
    assert H.judged_pages(p.limit(0), none).count() == 0
    plan = H.judged_pages(p, none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hosts_without_an_outcome(spark):
    """A new host takes its domain's rate, a new domain its suffix's; two-label suffixes, ports and addresses."""
    urls = [f"http://h{i}.bad.org/{j}" for i in range(40) for j in range(5)] + [f"http://ok{i}.com/{j}" for i in range(40) for j in range(5)]
    urls += ["http://new.bad.org/", "http://new.ok1.com/", "http://new.com/"] + MORE * 6
    pages = list(enumerate(urls))
    outcomes = [(i, int("bad" in u or "shop" in u)) for i, u in pages if "new" not in u and "b.shop" not in u]
    rows = H.judged_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    assert set(map(tuple, rows)) == brute(pages, outcomes)
    said = {r["host"]: r["verdict"] for r in rows}
    assert said["new.bad.org"] == "block" and said["new.com"] == said["new.ok1.com"] == said["c.other.co.uk"] == "allow"
