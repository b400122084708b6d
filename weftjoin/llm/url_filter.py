"""URL filters: path rules, and trust and distrust propagated over the links between hosts.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the
longest rule wins and decides its pages.  For other pages the host decides.  Hosts with pages under
allow rules are trusted seeds, hosts with pages under block rules are blocked seeds, each in proportion
to such pages.  Trust is personalised PageRank along the links from the trusted seeds; distrust is the
same against the links from the blocked ones, so it reaches hosts that link to bad ones.  A host is
blocked if its distrust exceeds its trust and is at least ``LEAST`` of the even share of all hosts.

Edges are counted per pair of hosts before anything else, so a page's or host's many links shuffle once;
what an iteration carries is one row per host.  Iterations go on until all mass that is still under way, wherever it may
arrive, is below ``SETTLED`` of the score that a verdict asks for; their number grows with the logarithm of the number of hosts.

Cases: null urls and urls without ``://`` have empty host and path and pass no links; null html has no links;
pages are judged row by row, so repeated rows give repeated results; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftjoin.llm.support import durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Up to so many rules are compared one by one in an expression; more are joined as a table.
MOST_RULES = 200
LEAST = 0.25
SETTLED = 0.01


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def with_rules(pages: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """page_id, host, path, rule, rule_verdict; ``rules`` are a list, or a table (verdict, host, path) of any size.

    A list of up to ``MOST_RULES`` is one expression.  A longer one is joined as a table is: every distinct (host, path) with each of its
    host suffixes and each of its path's beginnings of a length that some rule's path has.  Of rules of equal length
    the smallest (text, verdict) wins in either form.
    """
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MOST_RULES:
        if not isinstance(rules, DataFrame):
            rules = pages.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        return _joined_rules(out, rules)
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return out.select("*", (none if text is None else text).alias("rule"), (none if verdict is None else verdict).alias("rule_verdict"))


def _joined_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    rules = rules.groupBy(F.col("host").alias("of"), F.col("path").alias("begins")).agg(F.min("verdict").alias("rule_verdict"))
    lengths = rules.select(F.length("begins").alias("size")).distinct().agg(F.sort_array(F.collect_list("size")).alias("sizes"))  # no more than a url has characters
    sites = pages.select("host", "path").distinct().crossJoin(F.broadcast(lengths))  # one row of lengths
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    sites = sites.select("host", "path", "sizes", F.explode(suffixes).alias("of"))
    sites = sites.join(rules.select("of").distinct(), "of", "left_semi")
    sites = sites.select("host", "path", "of", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    met = sites.withColumn("begins", F.substring("path", F.lit(1), F.col("size"))).join(rules, ["of", "begins"])
    text = F.concat("of", "begins")
    best = met.groupBy("host", "path").agg(F.min(F.struct((-F.length(text)).alias("longest"), text.alias("rule"), F.col("rule_verdict"))).alias("b"))
    return pages.join(best.select("host", "path", "b.rule", "b.rule_verdict"), ["host", "path"], "left").select("page_id", "host", "path", "rule", "rule_verdict")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links from one host to another, counted; a host's links to itself are left out."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src != '' AND dst != '' AND src != dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) of every host that is a seed or has an edge.

    ``seeds`` has (host, allow, block) counts.  Walks that reach a host without onward links end there, as
    in trust propagation their mass isn't handed back; both scores therefore sum to 1 at most.  The scores' distance from where they
tend to, summed over the hosts, is ``tolerance`` at most, unless ``iterations`` are given and end before.
    """
    totals = seeds.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n or 1)))
    start = durable(seeds.select("host", share("allow", totals["a"]).alias("trust0"), share("block", totals["b"]).alias("distrust0")).filter("trust0 > 0 OR distrust0 > 0"))
    scores = start.select("host", (F.col("trust0") * (1 - damping)).alias("trust"), (F.col("distrust0") * (1 - damping)).alias("distrust"))
    out_sum = edges.groupBy(F.col("src").alias("from")).agg(F.sum("links").alias("n"))
    in_sum = edges.groupBy(F.col("dst").alias("from")).agg(F.sum("links").alias("n"))
    along = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "links").join(out_sum, "from").select("from", "to", (F.col("links") / F.col("n")).alias("w"), F.lit(1.0).alias("forth"))
    against = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "links").join(in_sum, "from").select("from", "to", (F.col("links") / F.col("n")).alias("w"), F.lit(0.0).alias("forth"))
    steps = durable(along.unionByName(against))
    if not steps.take(1):
        return scores
    if iterations is None:  # two scores of mass 1 at most, of which each iteration leaves the damped part
        iterations = 1 + math.ceil(math.log(tolerance / 2) / math.log(damping)) if 0 < damping < 1 and tolerance < 2 else 1
    for _ in range(iterations):
        passed = steps.join(scores.withColumnRenamed("host", "from"), "from").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.col("trust") * F.col("w") * F.col("forth") * damping).alias("t"), F.sum(F.col("distrust") * F.col("w") * (1 - F.col("forth")) * damping).alias("d")
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        fresh = passed.join(start, "host", "full").select("host", (zero("t") + zero("trust0") * (1 - damping)).alias("trust"), (zero("d") + zero("distrust0") * (1 - damping)).alias("distrust"))
        fresh = durable(fresh.filter("trust > 0 OR distrust > 0"))
        old = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = fresh.join(old, "host", "full").agg(F.sum(F.abs(zero("trust") - zero("t0")) + F.abs(zero("distrust") - zero("d0"))).alias("x")).first()["x"]
        scores = fresh
        if (moved or 0.0) * damping / (1 - damping) <= tolerance:
            break
    return scores


def judge_pages(pages: DataFrame, rules: list[Rule] | DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust, one row per page."""
    ruled = with_rules(pages, rules)
    count = lambda v: F.count(F.when(F.col("rule_verdict") == v, 1)).alias(v)
    hosts = durable(ruled.filter("host != ''").groupBy("host").agg(count("allow"), count("block")))
    even = 1.0 / max(1, hosts.count())
    scores = propagate(durable(host_edges(pages)), hosts, tolerance=SETTLED * least * even)
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least * even)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    joined = ruled.join(scores.select("host", "trust", "distrust", F.when(blocked, "block").otherwise("allow").alias("host_verdict")), "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"), zero("trust"), zero("distrust"))
