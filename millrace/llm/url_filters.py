"""URL filters: rules for hosts and paths, and propagation of trust and distrust over the graph of linked hosts.

Everything is DataFrame functions and joins; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where :// is missing."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or where :// is missing."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits: a struct of rule and verdict, null where none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between hosts (src, dst, weight): absolute hrefs in the html, counted, and each host with the host above it.

    A host www.a.b.c stands next to a.b.c, and that to b.c, in both directions with weight 1; a name of one label or none
    has no host above it. Links of a host to itself carry nothing and go.
    """
    hosts = pages.select("host").where("host <> ''").distinct()
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'<>]*)"), F.lit(1))
    linked = pages.where("host <> ''").select("host", F.explode(hrefs).alias("href")).select(F.col("host").alias("src"), url_host(F.concat(F.lit(":"), F.regexp_replace("href", "^[^/]*:", ""))).alias("dst"))
    links = linked.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    labels = F.split("host", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("lower"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("upper")))
    tree = hosts.where(F.size(labels) > 2).select(F.explode(steps).alias("s")).select("s.*").distinct()
    sides = tree.select(F.col("lower").alias("src"), F.col("upper").alias("dst")).unionByName(tree.select(F.col("upper").alias("src"), F.col("lower").alias("dst")))
    return links.unionByName(sides.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank that jumps back to seeds (host, seed: shares that sum to 1): host, rank.

    edges: src, dst, share (a host's shares sum to 1). Mass that reaches a host without links goes back to the seeds; as
    that only scales the ranks, they are scaled to sum to 1 at the end. Each step is one join on the source and one
    partially aggregated sum by target.
    """
    rank = seeds.select("host", F.col("seed").alias("rank"))
    for step in range(iterations):
        moved = edges.join(rank, edges["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        rank = moved.unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % 3 == 2 or step == iterations - 1:
            rank = materialize(rank)
    total = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("host", (F.col("rank") / total).alias("rank"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.0, iterations: int = 10, most_broadcast: int = 64 << 20) -> DataFrame:
    """Judges pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Where a rule fits, its verdict holds. Other urls get their host's: hosts with allowed urls are trusted seeds and hosts
    with blocked urls blocked ones, both by their counts; trust goes along links, distrust against them, each as a
    personalised PageRank. A host is blocked if its distrust is above its trust by more than `threshold`, and allowed
    otherwise, as are hosts that nothing reaches and urls without a host. Null html has no links; repeated pages count
    as often as they come; an empty table gives no rows. Extra columns of the input are left out. The hosts' scores are
    broadcast if they are counted to take at most `most_broadcast` bytes; beyond, those of crowded hosts alone.
    """
    url = F.col("url").cast("string")
    judged = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), F.col("html").cast("string").alias("html")).withColumn("rule_found", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = materialize(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_found.verdict") == "allow").cast("double").alias("allow"), F.count_if(F.col("rule_found.verdict") == "block").cast("double").alias("block"), F.count("*").alias("n")))
    totals = verdicts.agg(F.coalesce(F.sum("allow"), F.lit(0.0)), F.coalesce(F.sum("block"), F.lit(0.0))).first()
    edges = materialize(host_edges(judged))

    def ranked(edges: DataFrame, name: str, total: float, score: str) -> DataFrame:
        out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
        shares = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
        seeds = verdicts.where(F.col(name) > 0).select("host", (F.col(name) / F.lit(total or 1.0)).alias("seed"))
        return personalised_rank(shares, seeds, iterations).withColumnRenamed("rank", score)

    trust = ranked(edges, "allow", totals[0], "trust")
    distrust = ranked(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "block", totals[1], "distrust")
    scores = verdicts.join(trust, "host", "left").join(distrust, "host", "left").select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = materialize(scores)
    own = F.when(F.col("distrust") > F.col("trust") + threshold, "block").otherwise("allow")
    rows = judged.drop("html")
    if (scores.agg(F.sum(F.octet_length("host") + 64)).first()[0] or 0) <= most_broadcast:
        found = rows.join(F.broadcast(scores.drop("n")), "host", "left")
    else:  # a host of more than a two-thousandth of the pages is one of at most two thousand; the others' rows are few each
        n_pages = verdicts.agg(F.sum("n")).first()[0]
        hot = scores.where(F.col("n") * 2000 > n_pages).drop("n")
        crowded = rows.join(F.broadcast(hot), "host")
        others = rows.join(F.broadcast(hot.select("host")), "host", "left_anti").join(scores.drop("n"), "host", "left")
        found = crowded.unionByName(others)
    return found.select("page_id", "host", "path", F.col("rule_found.rule").alias("rule"), F.coalesce(F.col("rule_found.verdict"), own).alias("verdict"), "trust", "distrust")
