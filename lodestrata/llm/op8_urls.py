"""URL filters: rules, and for urls without one, trust and distrust that spread over the links between hosts.

Trust is a personalised PageRank from the hosts of allowed urls along links; distrust is one from the hosts of blocked urls
against links (who links to a bad host is suspect). Both run in one DataFrame loop, cut off each round, until no host gets
its first score and no score changes by `tolerance` of itself, so hosts without links change no verdict however many they
are, or for `most_rounds` rounds that reach no new host (a bound on a walk that shrinks by the damping each round). Mass that hosts without links lose would go back to the seeds; that only scales the ranks, so
they are normalised in the end instead. A host is blocked if its share of distrust in both exceeds `block_from`.

Links are absolute or protocol-relative urls in href and src attributes; links inside a host are left out. They are counted
per pair of hosts before anything else is shuffled. Pages of a host with more than a thousandth of all of them are not
shuffled to meet its scores: there are at most a thousand such hosts, and their scores are broadcast.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is allowed; a host that
nothing reaches is allowed; a null html has no links; rows that repeat are judged each; an empty table gives no rows;
columns other than page_id, url and html are ignored. Of fitting rules the longest wins (host and path together), then the one with the longer host, then a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, Rounds, cut, look_up, read

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""

DAMPING, TOLERANCE, MOST_ROUNDS, BLOCK_FROM = 0.85, 1e-4, 200, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the rule that wins, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last of these that fits is the outermost, so it wins
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. pages: host, html."""
    found = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(kind, host, score), scores of a kind summing to 1. seeds: kind, host, seed; links: kind, src, dst, n."""
    out_of = links.groupBy("kind", "src").agg(F.sum("n").alias("_all"))
    links = cut(links.join(out_of, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("_all")).alias("share")))
    hosts = seeds.unionByName(links.select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("seed"))).groupBy("kind", "host").agg(F.sum("seed").alias("seed"))
    total = hosts.groupBy("kind").agg(F.sum("seed").alias("_all"))  # a row for each kind
    hosts = cut(hosts.join(F.broadcast(total), "kind").select("kind", "host", F.when(F.col("_all") > 0, F.col("seed") / F.col("_all")).otherwise(0.0).alias("seed")))
    ranks = hosts.select("kind", "host", F.col("seed").alias("score"))
    if links.limit(1).count():
        rounds = Rounds(seeds.sparkSession)
        settling = 0
        while settling < most_rounds:
            flow = ranks.withColumnRenamed("host", "src").join(links, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("_in"))
            new = hosts.join(flow, ["kind", "host"], "left").select("kind", "host", ((1 - damping) * F.col("seed") + damping * F.coalesce("_in", F.lit(0.0))).alias("score"))
            new = rounds.next(new.join(ranks.withColumnRenamed("score", "_old"), ["kind", "host"]))
            reached = F.max(((F.col("score") > 0) & (F.col("_old") == 0)).cast("int"))
            change = F.max(F.when(F.col("score") > 0, F.abs(F.col("score") - F.col("_old")) / F.col("score")))
            reached, change = new.agg(F.coalesce(reached, F.lit(0)), F.coalesce(change, F.lit(0.0))).first()
            ranks = new.drop("_old")
            settling += not reached
            if not reached and change < tolerance:
                break
    total = ranks.groupBy("kind").agg(F.sum("score").alias("_all"))
    return ranks.join(F.broadcast(total), "kind").select("kind", "host", F.when(F.col("_all") > 0, F.col("score") / F.col("_all")).otherwise(0.0).alias("score"))


def judge(pages: DataFrame, rules=RULES, block_from: float = BLOCK_FROM, **propagation) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "_ruled": verdict})
    per_host = parsed.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_ruled") == "allow", 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col("_ruled") == "block", 1).otherwise(0)).alias("_b"))
    per_host = cut(per_host)
    seed = lambda kind, n: F.struct(F.lit(kind).alias("kind"), (F.col(n) / F.col("_n")).alias("seed"))
    seeds = per_host.select("host", F.explode(F.array(seed("trust", "_a"), seed("distrust", "_b"))).alias("x")).select("x.kind", "host", "x.seed")
    links = cut(host_links(parsed.select("host", "html")))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust").alias("kind"), F.col("dst"), F.col("src"), "n"))
    scores = propagate(seeds, both, **propagation)
    scores = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    hot = per_host.where(F.col("_n") > F.lit(HOT_SHARE) * per_host.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    found = parsed.drop("html").withColumn("host", F.nullif("host", F.lit("")))  # pages without a host find no scores
    found = look_up(found, cut(scores), "host", hot).withColumn("host", F.coalesce("host", F.lit("")))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust > 0) & (distrust > F.lit(block_from) * (trust + distrust)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("_ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
