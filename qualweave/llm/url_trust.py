"""URL verdicts from rules and, beyond them, from trust and distrust along links between hosts.

Rules (host, path) are matched first; the longest that fits decides. Pages that
rules decide are the seeds: a host is trusted or blocked to the share of its pages
that rules allow or block. Trust follows links, as personalised PageRank with
restart at the trusted seeds; distrust follows them backwards, from blocked hosts to
those that link to them. A host is blocked if its distrust exceeds its trust by
THRESHOLD of what a wholly blocked host has by itself.

Links are the href values of a elements; those that name a host give edges between
hosts, weighted by their number. Ranks stay DataFrames, one row per host; each step is
one join and one sum, and steps go on until no rank moves by more than TOLERANCE.

Defined cases: a null url, or one without ://, has the empty host and path, which
no rule fits and which isn't a host of the graph, so it is allowed; null html has no links; rows that
repeat a page count each; a host without links has its own seed alone; html is
searched whole for links, however long; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualweave.llm.graphs import sized
from qualweave.llm.html_diff import host_of, path_of
from qualweave.session import cut, saved

#: rule text and verdict; the text up to its first slash is the host, the rest the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Ranks are settled when none moves by more; what is under way shrinks by DAMPING a step, so about 90 steps are the most.
TOLERANCE = 1e-6
THRESHOLD = 0.5
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
LINK_HOST = r"(?s)^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]+)"


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    allowed = [t for t, v in rules if v == "allow"]
    return F.when(rule.isNull(), F.lit(None).cast("string")).when(rule.isin(allowed), "allow").otherwise("block")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: numbers of links between different hosts."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(0))
    # A link to another host has // in it; others needn't leave the array.
    outward = F.filter(hrefs, lambda a: a.contains("//"))
    target = F.regexp_extract(F.regexp_replace(F.col("a"), r"(?is)^.*?href\s*=\s*[\"']?", ""), LINK_HOST, 1)
    dst = F.translate(target, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(outward).alias("a")).select("src", dst.alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, rank: rank = (1 - damping) * seed + damping * (what links bring). seeds: host, seed. edges: src, dst, links."""
    total = edges.groupBy("src").agg(F.sum("links").alias("total"))
    flow = saved(edges.join(total, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")))
    ranks = saved(seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("rank")))
    own = ranks.withColumnsRenamed({"rank": "own"})
    if flow.isEmpty():
        return ranks
    while True:
        brought = flow.join(ranks, flow.src == ranks.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("brought"))
        new = own.join(brought, "host", "full").select("host", (F.coalesce("own", F.lit(0.0)) + damping * F.coalesce("brought", F.lit(0.0))).alias("rank"))
        step = saved(new.join(ranks.withColumnRenamed("rank", "was"), "host", "left").withColumn("was", F.coalesce("was", F.lit(0.0))))
        ranks = step.select("host", "rank")
        if not step.where(F.abs(F.col("rank") - F.col("was")) > tolerance).limit(1).count():
            return ranks


def host_verdicts(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust, blocked for each host of a page or a link. pages: url, html."""
    host = host_of(F.col("url"))
    said = verdict_of(rule_of(host, path_of(F.col("url")), rules), rules)
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    seeds = cut(pages.select(host.alias("host"), said.alias("said")).where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    edges = cut(host_edges(pages))
    trust = propagate(seeds.select("host", F.col("good").alias("seed")), edges).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagate(seeds.select("host", F.col("bad").alias("seed")), back).withColumnRenamed("rank", "distrust")
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") - F.col("trust") >= threshold * (1 - DAMPING))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages."""
    hosts = sized(cut(host_verdicts(pages, rules, threshold)).withColumnRenamed("host", "h_host"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return judged.join(hosts, F.col("host") == F.col("h_host"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
