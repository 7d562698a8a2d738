"""URL filter: rules first, then trust that flows along the links between hosts.

Hosts are nodes, and a page that links to another host gives an edge. Personalised
PageRank spreads trust from hosts whose pages the rules allow, along the links, and
distrust from hosts whose pages the rules block, against them: who links to a blocked
host earns distrust. A seed's weight is the share of its host's pages that an allowing
(blocking) rule fits. A host whose distrust exceeds ``threshold`` times its trust is
blocked, all others are allowed. A page gets the verdict of the longest rule that fits
it, else its host's.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end. A rule ``host/path`` fits
its host and all subdomains if the url's path starts with the rule's.

Each round reads and writes one row per host, cuts its lineage in the shared folder, and
sends one row of totals to the driver. Ranks of hosts without links flow back to the
seeds. Rounds end when both ranks change by less than ``tolerance`` in all, or after
``rounds``.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule,
and the empty host is no node, so they are allowed. Null html has no links. Without
seeds all is allowed. Equal rows are judged one by one (their links count once per row).
An empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: pages of a host from which on it may be dealt out, hosts that are (the largest), and tasks for each
HOST_PAGES, HOT_HOSTS, SALTS = 10_000, 1_000, 32
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 20, 1e-6, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)\shref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Rules are a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        of, _, begin = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + begin)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links between different hosts; pages: host, html."""
    links = pages.filter(F.col("html").contains("//") & (F.col("host") != "")).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return links.filter("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread_trust(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust; edges: src, dst, links; seeds: host, good, bad (weights).

    trust = (1 - damping) * good + damping * (what comes along links + what hosts without
    links hand back to the seeds), distrust likewise against the links.
    """
    edges = materialize(edges, "edges")
    out = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
    inward = edges.groupBy("dst").agg(F.sum("links").alias("in_links"))
    shares = edges.join(out, "src").join(inward, "dst").select("src", "dst", (F.col("links") / F.col("out_links")).alias("fw"), (F.col("links") / F.col("in_links")).alias("bw"))
    nodes = seeds.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0.0).alias("good"), F.lit(0.0).alias("bad")))
    nodes = nodes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    nodes = nodes.join(out.select(F.col("src").alias("host"), F.lit(True).alias("has_out")), "host", "left").join(inward.select(F.col("dst").alias("host"), F.lit(True).alias("has_in")), "host", "left")
    ranks = materialize(nodes.withColumns({"trust": F.col("good"), "distrust": F.col("bad")}), "ranks")
    if edges.isEmpty():  # all ranks flow straight back to the seeds
        return ranks.select("host", "trust", "distrust")
    shares = materialize(shares, "shares")
    total = ranks.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    for _ in range(rounds):
        spare = ranks.agg(F.sum(F.when(F.col("has_out").isNull(), F.col("trust")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("has_in").isNull(), F.col("distrust")).otherwise(0.0)).alias("d")).first()
        along = shares.join(ranks.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("fw") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        against = shares.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("bw") * F.col("distrust")).alias("d"))
        got = along.union(against).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        back_t = spare["t"] / total["good"] if total["good"] else 0.0
        back_d = spare["d"] / total["bad"] if total["bad"] else 0.0
        after = ranks.join(got, "host", "left").select(
            "host", "good", "bad", "has_out", "has_in",
            (F.lit(1 - damping) * F.col("good") + F.lit(damping) * (F.coalesce("t", F.lit(0.0)) + F.lit(back_t) * F.col("good"))).alias("trust"),
            (F.lit(1 - damping) * F.col("bad") + F.lit(damping) * (F.coalesce("d", F.lit(0.0)) + F.lit(back_d) * F.col("bad"))).alias("distrust"),
            F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"),
        )
        after = materialize(after, "ranks")
        moved = after.agg(F.sum(F.abs(F.col("trust") - F.col("was_t")) + F.abs(F.col("distrust") - F.col("was_d")))).first()[0] or 0.0
        ranks = after.drop("was_t", "was_d")
        if moved < tolerance:
            break
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rules = RULES if rules is None else rules
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    split = split.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = host_edges(split.select("host", "html"))
    split = split.select("page_id", "host", "path", "fit")
    share = lambda v: F.avg(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = split.filter(F.col("host") != "").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    ranks = spread_trust(edges, seeds)
    # a host with a great share of the pages is dealt to several tasks, and its row goes to each
    parts = split.filter(F.col("host") != "").groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).cast("int").alias("_parts")).filter("_parts > 1")
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))
    hot = F.broadcast(parts.orderBy(F.desc("_parts"), "host").limit(HOT_HOSTS).select(F.col("host").alias("_hot")))  # a bounded number; others have few pages each
    split = split.join(hot, F.col("host") == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(F.lit(0)))
    of = ranks.join(hot, F.col("host") == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    of = of.select(F.col("host").alias("_host"), F.col("_salt").cast("long").alias("_of"), "trust", "distrust")
    out = split.join(of, (split["host"] == of["_host"]) & (split["_salt"] == of["_of"]), "left")
    own = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "trust", "distrust")
