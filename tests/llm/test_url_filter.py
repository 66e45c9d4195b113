import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm.queries import OP11_SQL, URL_RULES
from meshwork.llm.url_filter import host_links, host_of, host_trust, judge, keep_allowed, path_of, rule_table

SCHEMA = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def best_rule(host, path, rules):
    fits = [(-len(h + p), -len(h), v != "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[3:] if fits else (None, None)


def brute(rows, rules, threshold=0.5, damping=0.85):
    """Verdicts, trust and distrust by solving the linear systems directly."""
    pages = [(i, *split(u), h or "") for i, u, h in rows]
    links, seeds = {}, {}
    for _, host, path, html in pages:
        if not host:
            continue
        verdict = best_rule(host, path, rules)[1]
        seeds.setdefault(host, []).append(verdict)
        found = re.findall(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'<>\s\\]+)", html)
        for dst in {d.lower() for d in found} - {host}:
            links[host, dst] = links.get((host, dst), 0) + 1
    hosts = sorted(set(seeds) | {h for e in links for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    one, walk = np.eye(len(hosts)), w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    allowed, blocked = (np.array([np.mean([v == kind for v in seeds[h]]) if h in seeds else 0.0 for h in hosts])
                        for kind in ("allow", "block"))
    trust, every = (np.linalg.solve(one - damping * walk.T, s) for s in (allowed, np.ones(len(hosts))))
    trust = trust / every
    distrust = np.linalg.solve(one - damping * (1 - blocked)[:, None] * walk, blocked)
    out = []
    for i, host, path, _ in pages:
        rule, verdict = best_rule(host, path, rules)
        if verdict is None:
            bad = host and distrust[at[host]] >= threshold and distrust[at[host]] > trust[at[host]]
            verdict = "block" if bad else "allow"
        out.append((str(i), host, path, rule, verdict))
    return sorted(out, key=str), dict(zip(hosts, zip(trust, distrust)))


def web(seed):
    rng = random.Random(seed)
    hosts = [f"{a}.example.{b}" for a in ("a", "www.b", "c", "m.d", "e", "f") for b in ("com", "net", "org")]
    hosts += ["net", "Example.ORG", "xnet", "other.io", "far.io", "spam.io"]
    paths = ["/", "", "/en/1", "/de/2?x=/fr/", "/fr/3#a", "/EN/", "?q=/en/", "#/en/", "/de", "/fr/x/de/"]
    rows = []
    for i in range(400):
        src = rng.choice(hosts) if rng.random() < 0.7 else hosts[0]
        out = []
        for _ in range(rng.choice([0, 0, 1, 3])):
            dst = rng.choice(hosts[::2] if "io" in src else hosts)
            out.append(rng.choice(['<a href="http://{}/x">', "<a HREF='//{}'>", "<a href = https://{}?q>", '<a href="/{}">',
                                   '<link href="HTTPS://{}#x">', "http://{}/", '<a href="mailto://{}">']).format(dst))
        rows.append((i, f"{rng.choice(['http', 'HTTPS', ''])}://{src}{rng.choice(paths)}", " ".join(out)))
    rows += [(500, "https://spam.io/x", '<a href="//c.example.net/">' * 3), (501, "https://far.io/1", '<a href="//spam.io">'),
             (600, None, '<a href="//a.example.com">'), (601, "no scheme", None), (602, "", ""), (603, "x:///p", "<a href=//q.io>"),
             (None, "http://e.example.com/en/", None), (1, "http://e.example.com/en/", None), (604, "a://b://c/d", None),
             (605, "http://h\nost/p\nq", None), (606, "http://ÄX.net/é", "")]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_equal_the_brute_force_and_the_sql(spark, tmp_path, seed):
    rows = web(seed)
    pages = spark.createDataFrame(rows, SCHEMA)
    out = judge(pages.repartition(5), rule_table(spark, URL_RULES)).collect()
    want, shares = brute(rows, URL_RULES)
    assert sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in out), key=str) == want
    for r in out:
        if r.host:
            assert abs(r.trust - shares[r.host][0]) < 1e-3 and abs(r.distrust - shares[r.host][1]) < 1e-3
    assert {r.verdict for r in out if r.rule is None} == {"allow", "block"}
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages/*.parquet')")
    got = [(str(i), *rest) for i, *rest in con.execute(f"select page_id, host, path, rule, verdict from ({OP11_SQL})").fetchall()]
    assert sorted(got, key=str) == want


def test_distrust_runs_against_the_links_and_trust_along(spark):
    seeds = spark.createDataFrame([("good", 1.0, 0.0), ("bad", 0.0, 1.0), ("x", 0.0, 0.0)], "host string, allowed double, blocked double")
    links = spark.createDataFrame([("good", "praised", 1), ("farm", "bad", 5), ("bad", "victim", 1)], "src string, dst string, pages long")
    got = {r.host: (round(r.trust, 3), round(r.distrust, 3)) for r in host_trust(seeds, links).collect()}
    assert got["praised"][0] > 0.4 and got["praised"][1] == 0
    assert got["farm"] == (0, 0.85)
    assert got["victim"] == (0, 0) and got["x"] == (0, 0) and got["bad"] == (0, 1) and got["good"] == (1, 0)


def test_a_tie_of_rules_and_a_rule_table_of_any_size(spark):
    rules = [("allow", f"h{i}.io", "/a") for i in range(500)] + [("block", "io", "/a/bcd"), ("block", "h7.io", "/a"), ("allow", "IO", "/")]
    pages = spark.createDataFrame([(1, "http://h3.io/a/bcd", None), (2, "http://h7.io/abc", None), (3, "http://x.h9.io/b", None)], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in judge(pages, rule_table(spark, rules)).collect()}
    assert got == {1: ("io/a/bcd", "block"), 2: ("h7.io/a", "block"), 3: ("io/", "allow")}


def test_empty_tables_clashing_columns_and_long_html(spark):
    rules = rule_table(spark, URL_RULES)
    assert judge(spark.createDataFrame([], SCHEMA), rules).count() == 0
    assert judge(spark.createDataFrame([(1, "http://a.net/", None)], SCHEMA), rules.limit(0)).first().verdict == "allow"
    schema = "page_id long, url string, html string, host int, rules int, row int, verdict int, `a.b` int"
    pages = spark.createDataFrame([(1, "http://a.net/", "href=" + " " * 200000 + "<a href" * 50000, 2, 3, 4, 5, 6),
                                   (2, "http://a.org/fr/", None, 2, 3, 4, 5, 6)], schema)
    out = judge(pages, rules).collect()
    assert [(r.host, r.rules, r.row, r.verdict, r["a.b"]) for r in sorted(out, key=lambda r: r.page_id)] == [
        ("a.net", 3, 4, "block", 6), ("a.org", 3, 4, "allow", 6)]
    kept = keep_allowed(pages, rules)
    assert kept.columns == pages.columns and [r.page_id for r in kept.collect()] == [2]


def test_parts_of_urls(spark):
    urls = [u for _, u, _ in web(3)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert all((r.h, r.p) == split(r.url) for r in got)


def test_links_of_a_hot_host_are_one_row_a_pair(spark):
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.lit("http://hot.io/").alias("url"),
                                      F.lit('<a href="//x.io"><a href="//x.io/2"><a href="//hot.io">').alias("html"))
    assert [tuple(r) for r in host_links(pages).collect()] == [("hot.io", "x.io", 20000)]
