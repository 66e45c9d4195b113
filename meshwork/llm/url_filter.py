"""URL filter: allow and block rules, and trust over the link graph of hosts.

* A rule names a host and the start of a path; it fits its host and all
  subdomains if the url's path starts with the rule's, and the longest fitting
  rule gives the verdict (same length: the longer host, then block).
* Pages without a fitting rule get the verdict of their host. Hosts are linked
  by the absolute ``href``s of their pages: an edge's weight is the number of
  pages with such a link; links within a host don't count. Trust starts at
  hosts with allowed pages, as much as the share of such pages, and is carried
  along the links by personalised PageRank; ``trust`` is the part of a host's
  plain PageRank, by the same links from all hosts alike, that stems from
  trusted seeds. Distrust starts at hosts with blocked pages and is carried
  against the links: ``distrust`` is the chance that a surfer who starts on a
  page of the host, and goes on to another host with the damping's probability
  a step, meets a blocked page (personalised PageRank with blocked pages as
  ends). Both lie between 0 and 1 whatever the size of graph and host. A host
  is blocked if its distrust reaches ``threshold`` and exceeds its trust.
  The rank of hosts without outgoing links would return to the start; that
  scales both PageRanks by nearly the same and is left out.

All of it is DataFrame functions. Pages are scanned for hosts and rules, for
links, and for the result; only hosts, distinct pairs of hosts and their ranks
are shuffled, combined before the shuffle, so a host with a third of all pages
is one row a task. Ranks are written after every three steps and iterated
until no share changes by more than ``tolerance``; without an edge there is
nothing to iterate. The table of hosts is joined to the pages, by broadcast
only if Spark finds it small; otherwise skewed hosts are split by AQE.

Edge cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is allowed; an empty host takes no part in the graph. A host that
is only linked to has no pages and no seeds. Null html has no links. Repeated
rows count each, as pages of their host. Empty tables give empty results. All
columns of the pages stay but those named like a result column, which are
replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

RESULTS = ("host", "path", "rule", "verdict", "trust", "distrust")
DAMPING = 0.85
#: The host of a link with an authority of its own; possessive repeats, so
#: that no text makes the search go back.
LINK = r"""(?i)\bhref\s*+=\s*+["']?+\s*+(?:https?:)?+//([^/?#"'<>\s\\]++)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of a host and of the domains above it, the
    longest first. Hosts without rules have no row."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rank = F.struct((-F.length(F.concat("domain", "path"))).alias("size"), (-F.length("domain")).alias("host_size"),
                    (F.col("verdict") != "block").alias("allows"), "path", "verdict",
                    F.concat("domain", "path").alias("rule"))
    named = rules.select(F.translate("host", _UPPER, _LOWER).alias("domain"), "path", "verdict").distinct()
    return (hosts.select("host", F.explode(above).alias("domain")).join(named, "domain")
            .groupBy("host").agg(F.array_sort(F.collect_list(rank)).alias("rules")))


def _first_fitting() -> Column:
    return F.get(F.filter("rules", lambda r: F.startswith("path", r["path"])), F.lit(0))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, pages): how many pages of a host link to another host."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1)),
                                         lambda h: F.translate(h, _UPPER, _LOWER)))
    return (pages.select(host_of(F.col(url_col)).alias("src"), F.explode(found).alias("dst"))
            .where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("pages")))


def host_trust(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) of all hosts of ``seeds`` (host, allowed,
    blocked: shares of its pages) and ``links`` (src, dst, pages)."""
    links = materialise(links, narrow=True)
    hosts = (seeds.select("host", "allowed", "blocked")
             .unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("allowed"),
                                       F.lit(0.0).alias("blocked")))
             .groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")))
    # a step gives a = a0 + a1 * inflow of a, and b alike; the share is a / b
    numbers = lambda kind, *c: F.struct(F.lit(kind).alias("kind"), *(
        F.lit(x).cast("double").alias(n) for n, x in zip(("a0", "a1", "b0", "b1"), c)))
    kinds = F.explode(F.array(
        numbers("trust", (1 - damping) * F.col("allowed"), damping, 1 - damping, damping),
        numbers("distrust", F.col("blocked"), damping * (1 - F.col("blocked")), 1.0, 0.0))).alias("k")
    base = materialise(hosts.select("host", kinds).select("host", "k.*"), narrow=True)
    weighted = links.join(links.groupBy("src").agg(F.sum("pages").alias("total")), "src").select(
        "src", "dst", (F.col("pages") / F.col("total")).alias("w"))
    edge = lambda kind, source, target: F.struct(
        F.lit(kind).alias("kind"), F.col(source).alias("host"), F.col(target).alias("target"))
    edges = materialise(weighted.select(F.explode(F.array(
        edge("trust", "src", "dst"), edge("distrust", "dst", "src"))).alias("e"), "w").select("e.*", "w"), narrow=True)

    def step(state):
        flow = (edges.join(state, ["kind", "host"]).groupBy("kind", F.col("target").alias("host"))
                .agg(F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b")))
        inflow = lambda c: F.coalesce(flow[c], F.lit(0.0))
        return base.join(flow, ["kind", "host"], "left").select(
            "kind", "host", (F.col("a0") + F.col("a1") * inflow("a")).alias("a"),
            (F.col("b0") + F.col("b1") * inflow("b")).alias("b"))

    share = F.col("a") / F.col("b")
    state = base.select("kind", "host", F.col("a0").alias("a"), F.col("b0").alias("b"))
    moved = 0.0 if edges.isEmpty() else 1.0
    while moved > tolerance:
        for _ in range(3):
            before = state.select("kind", "host", share.alias("before"))
            state = step(state)
        state = materialise(state.join(before, ["kind", "host"]), narrow=True)
        moved = state.agg(F.max(F.abs(share - F.col("before")))).first()[0]
    of = lambda kind: F.max(F.when(F.col("kind") == kind, share)).alias(kind)
    return state.groupBy("host").agg(of("trust"), of("distrust"))


def host_table(pages: DataFrame, rules: DataFrame, threshold: float = 0.5, damping: float = DAMPING,
               tolerance: float = 1e-4, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, rules, trust, distrust, blocked) of every host."""
    urls = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).where("host <> ''")
    fitting = materialise(fitting_rules(urls.select("host").distinct(), rules), narrow=True)
    verdict = urls.join(fitting, "host", "left").select("host", _first_fitting()["verdict"].alias("verdict"))
    of = lambda kind: F.avg(F.coalesce((F.col("verdict") == kind).cast("double"), F.lit(0.0)))
    seeds = verdict.groupBy("host").agg(of("allow").alias("allowed"), of("block").alias("blocked"))
    trust = host_trust(seeds, host_links(pages, url_col, html_col), damping, tolerance)
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return materialise(trust.join(fitting, "host", "left").withColumn("blocked", blocked), narrow=True)


def judge(pages: DataFrame, rules: DataFrame, threshold: float = 0.5, damping: float = DAMPING,
          tolerance: float = 1e-4, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (null if none fits),
    ``verdict`` (allow or block) and their host's ``trust`` and ``distrust``.

    ``rules``: table (verdict, host, path), see ``rule_table``.
    """
    hosts = host_table(pages, rules, threshold, damping, tolerance, url_col, html_col)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"),
                        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.join(hosts, "host", "left").withColumn("rule", _first_fitting())
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in RESULTS]
    return rows.select(*kept, "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"),
                       "trust", "distrust")


def keep_allowed(pages: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The pages whose verdict is allow, with their own columns."""
    judged = judge(pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"),
                                F.col(options.pop("url_col", "url")).alias("url"),
                                F.col(options.pop("html_col", "html")).alias("html")), rules, **options)
    return judged.where("verdict = 'allow'").select(*(F.col("page").getField(c).alias(c) for c in pages.columns))
