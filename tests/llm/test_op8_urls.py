from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import op8_urls as m

URLS = [
    (1, "http://a.com/x"), (2, "http://Example.COM/en/1?q#z"), (3, "https://www.example.com/en/7"), (4, "http://sub.www.example.com/en/"), (5, "http://b.example.net/fr/1"),
    (6, "http://b.example.net/de/1"), (7, "http://net/es/x"), (8, "http://xnet/es/x"), (9, None), (10, "no scheme"), (11, "http://a.com"), (12, "http://a.com?x=/"),
    (13, "ftp://u://v/w"), (14, "://h/p"), (15, "http://Éa.COM/p"), (16, "http:///p"), (17, "http://notcom/"), (18, ""), (19, "http://a.com/x\ny"), (20, "http://example.com/english"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]


def rule(host, path):
    fits = [(len(h + p), len(h), k == "block", h + p, k) for k, h, p in m.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string").repartition(3)


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in m.judge(pages(spark, [(i, u, None) for i, u in URLS])).collect()}
    assert len(got) == len(URLS)
    for i, u in URLS:
        host, path = plain(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        assert got[i].verdict == (verdict or ("block" if got[i].distrust > got[i].trust else "allow"))


def plain_rank(seeds, links, d=0.85):
    hosts = set(seeds) | {h for e in links for h in e}
    out = {h: sum(n for (s, _), n in links.items() if s == h) for h in hosts}
    total = sum(seeds.values())
    s = {h: seeds.get(h, 0) / total for h in hosts}
    r = dict(s)
    for _ in range(300):
        lost = sum(v for h, v in r.items() if not out[h])
        new = {h: (1 - d) * s[h] + d * lost * s[h] for h in hosts}
        for (a, b), n in links.items():
            new[b] += d * r[a] * n / out[a]
        r = new
    return r


LINKS = {("good.com", "friend.org"): 2, ("friend.org", "mate.org"): 1, ("farm.org", "bad.net"): 3, ("ring.org", "farm.org"): 1, ("mate.org", "good.com"): 1, ("good.com", "both.org"): 1, ("both.org", "bad.net"): 1}
SEEDS = {"trust": {"good.com": 1.0}, "distrust": {"bad.net": 1.0}}


def test_propagation_equals_power_iteration(spark):
    rows = [("trust", a, b, n) for (a, b), n in LINKS.items()] + [("distrust", b, a, n) for (a, b), n in LINKS.items()]
    seeds = spark.createDataFrame([(k, h, s) for k, x in SEEDS.items() for h, s in x.items()], "kind string, host string, seed double")
    got = m.propagate(seeds, spark.createDataFrame(rows, "kind string, src string, dst string, n long"), tolerance=1e-4)
    got = {(r.kind, r.host): r.score for r in got.collect()}
    for kind, links in (("trust", LINKS), ("distrust", {(b, a): n for (a, b), n in LINKS.items()})):
        for h, v in plain_rank(SEEDS[kind], links).items():
            assert got.get((kind, h), 0) == pytest.approx(v, abs=1e-3)


def test_verdicts_from_links(spark):
    html = {}
    for (a, b), n in LINKS.items():
        html[a] = html.get(a, "") + f'<a href="https://{b.upper()}/p">x</a><img src=//{b}/i.png>' * n + '<a href="/own">y</a>'
    path = {"good.com": "/", "bad.net": "/fr/1"}
    hosts = {h for e in LINKS for h in e}
    rows = [(k, f"http://{h}{path.get(h, '/z')}", html.get(h)) for k, h in enumerate(sorted(hosts))]
    got = {r.host: r.verdict for r in m.judge(pages(spark, rows)).collect()}
    assert got == {"good.com": "allow", "friend.org": "allow", "mate.org": "allow", "bad.net": "block", "farm.org": "block", "ring.org": "block", "both.org": got["both.org"]}


def test_links_are_counted_once_a_pair(spark):
    rows = spark.createDataFrame([("a.com", '<a HREF = "http://b.org:80/x"> <a href=\'HTTPS://B.org\'> <a href="http://a.com/"> <a href="/r"> data-href="//c.d/e"'), ("a.com", "x"), ("", '<a href="//q.r">')], "host string, html string")
    assert sorted(tuple(r) for r in m.host_links(rows).collect()) == [("a.com", "b.org", 1), ("a.com", "b.org:80", 1), ("a.com", "c.d", 1)]


def test_empty_and_repeated(spark):
    assert m.judge(pages(spark, [])).count() == 0
    assert m.judge(pages(spark, [(1, "http://a.com/", None)] * 3)).agg(F.count("*")).first()[0] == 3


def test_hosts_without_links_change_no_verdict(spark):
    """A blocked seed heads a chain of hosts; the other seeds are linked to nothing."""
    chain = [(f"h{k + 1}.org", f"h{k}.org") for k in range(8)]
    links = spark.createDataFrame([("distrust", b, a, 1) for a, b in chain], "kind string, src string, dst string, n long")
    for others in (0, 20_000):
        alone = spark.range(others).selectExpr("'distrust' AS kind", "concat('s', id, '.net') AS host", "1.0D AS seed")
        seeds = spark.createDataFrame([("distrust", "h0.org", 1.0)], "kind string, host string, seed double").union(alone)
        got = {r.host: r.score for r in m.propagate(seeds, links).where("host LIKE 'h%'").collect()}
        assert len(got) == 9 and all(x > 0 for x in got.values())
        assert [got[f"h{k + 1}.org"] / got[f"h{k}.org"] for k in range(8)] == pytest.approx([0.85] * 8, rel=1e-3)


def test_hosts_of_a_third_of_all_pages(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT_SHARE", 0.05)
    rows = [(k, f"http://hot.example.net/{'fr' if k % 2 else 'de'}/{k}", None) for k in range(60)] + [(100 + k, None if k % 2 else "nothing", None) for k in range(60)] + [(200 + k, f"http://h{k}.org/{k}", None) for k in range(60)]
    rows += [(300, "http://trap.org/", '<a href="http://hot.example.net/de/">')]
    got = {r.page_id: r for r in m.judge(pages(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[k].verdict == "block" for k in range(60)) and got[300].verdict == "block"
    assert all(got[100 + k].host == "" and got[100 + k].verdict == "allow" for k in range(60)) and all(got[200 + k].verdict == "allow" for k in range(60))
