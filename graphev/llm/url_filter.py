"""URL filter by rules and by trust that spreads over the links between hosts.

A rule fits a URL if the rule's host is the URL's host or a parent domain of it and the URL's
path starts with the rule's path; the longest rule wins (ties: the longer host, then block). URLs
that no rule fits are judged by their host: trust starts at hosts with allowed URLs and follows
links (personalised PageRank); distrust starts at hosts with blocked URLs and follows links
backwards, to those who link there. A host whose distrust exceeds ``threshold`` times its trust
is blocked, any other allowed, so unknown hosts are allowed.

Rules are matched once per distinct host, by joining its parent domains with the rules' hosts.
Links are combined per pair of hosts before ranks flow, and a round is a join and a partial
aggregation, so a host with a third of all pages or links is one row of the rank table. Rank does
not return from hosts without links.

Null or malformed URLs have an empty host and path, which no rule fits: allow. Null html has no
links. Repeated rows are judged alike and weigh as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import LOWER, UPPER, saved, table

#: Rule, verdict.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 1.0


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as rows: host, path, rule, verdict. Their number is the caller's; Spark broadcasts
    the table only where it is small."""
    parts = [(r[: r.index("/")].lower(), r[r.index("/") :], r, v) for r, v in rules]
    return spark.createDataFrame(parts, "rule_host string, rule_path string, rule string, rule_verdict string")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules that fit a host, the strongest first."""
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    depth = F.least(F.size(labels), F.lit(deepest))
    domains = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(labels, -k, k), "."))).alias("rule_host"))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule_verdict"), F.col("rule_path"), F.col("rule"))
    return domains.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(order), asc=False).alias("fits"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path, ...) with rule and rule_verdict, null where none fits."""
    fits = host_rules(pages.select("host").filter("host <> ''").distinct(), rules)
    out = pages.join(fits, "host", "left")
    best = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    return out.withColumn("_r", best).withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.rule_verdict")}).drop("_r", "fits")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    out = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    out = out.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src <> '' and src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def spread_trust(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust). seeds: host, good, bad; each of these sums to 1 or is 0."""
    out_sum = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_sum = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    weighed = links.join(out_sum, "src").join(in_sum, "dst")
    forward = weighed.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("wt"), F.lit(0.0).alias("wd"))
    back = weighed.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("in_n")).alias("wd"))
    flows = saved(forward.unionByName(back))
    nodes = seeds.unionByName(flows.select("host", F.lit(0.0).alias("good"), F.lit(0.0).alias("bad")).distinct())
    nodes = saved(nodes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    ranks = nodes.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for _ in range(rounds):
        got = flows.join(ranks, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") * F.col("wt")).alias("t"), F.sum(F.col("distrust") * F.col("wd")).alias("d"))
        after = nodes.join(got, "host", "left").select(
            "host",
            ((1 - damping) * F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        after = saved(after)
        moved = after.alias("a").join(ranks.alias("b"), "host").filter("a.trust <> b.trust or a.distrust <> b.distrust").limit(1).isEmpty()
        ranks = after
        if moved:  # a fixed point: further rounds change nothing
            break
    return ranks


def filter_urls(pages: DataFrame, rules: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """pages: page_id, url, html. One row each: page_id, host, path, rule, verdict, trust,
    distrust."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = judged(pages.drop("html"), rules)
    hits = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    counts = saved(ruled.filter("rule is not null").groupBy("host").agg(hits("allow").alias("good"), hits("block").alias("bad")))
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    seeds = counts.select("host", (F.col("good") / max(good, 1.0)).alias("good"), (F.col("bad") / max(bad, 1.0)).alias("bad"))
    ranks = spread_trust(host_links(pages), seeds, damping, rounds)
    out = ruled.join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "trust", "distrust")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), rules_table(spark, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")
