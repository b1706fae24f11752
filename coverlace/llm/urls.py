"""URL filters by rules and by link-graph propagation.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest fitting rule
decides. Other pages are judged by their host's standing in the link graph: trust spreads along the links from hosts
with allowed pages (personalised PageRank), distrust spreads against them from hosts with blocked pages (who links to a
bad host is suspect), and a host whose distrust exceeds its trust is blocked.

Cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is allowed; a null page has no
links; repeated rows are judged alike and their links count each; a page with very many links gives them all, a very long URL
is read whole; an empty table gives an empty result; other columns
are ignored. Hosts without links keep what their own pages' rules give them; equal trust and distrust allow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlace.session import checkpoint, materialize

DAMPING, ROUNDS = 0.85, 8
#: Pages of a host from which on its pages are dealt out, at least, and such hosts at most: the bound rises with the pages,
#: so that the list of hosts, which goes to all tasks, stays bounded.
HOT_PAGES, MAX_HOT = 512, 10_000
#: (verdict, host, beginning of the path)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.locate("://", url)
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, as host and path) and ruled (its verdict)."""
    host, path = host_and_path(F.col("url"))
    # The longest rule first: the host's labels count before the path, as both belong to one text.
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda r: ((F.col("host") == r[1]) | F.endswith(F.col("host"), F.lit("." + r[1]))) & F.startswith(F.col("path"), F.lit(r[2]))
    pick = lambda of: F.coalesce(*[F.when(fits(r), F.lit(of(r))) for r in order], F.lit(None).cast("string"))
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": pick(lambda r: r[1] + r[2]), "ruled": pick(lambda r: r[0])})


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute references in the pages' html."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    targets = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.array_distinct(found)).alias("to"))
    dst = F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER)
    return targets.select("src", dst.alias("dst")).where("dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, score): personalised PageRank of ``edges`` (src, dst, n) from ``seeds`` (host, mass), whose masses sum to 1.

    Mass of hosts without outgoing edges goes back to the seeds.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    rank = seeds.select("host", F.col("mass").alias("score"))
    for k in range(rounds):
        moved = steps.join(rank, steps.src == rank.host).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
        given = moved.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("given"))
        back = seeds.crossJoin(F.broadcast(given)).select("host", (F.col("mass") * (1 - F.col("given"))).alias("score"))  # one row
        rank = moved.unionByName(back).groupBy("host").agg(F.sum("score").alias("score"))
        rank = checkpoint(rank) if k % 2 or k == rounds - 1 else rank
    return rank


def _seeds(hosts: DataFrame, mass: Column) -> DataFrame:
    weighed = hosts.select("host", mass.cast("double").alias("w")).where("w > 0")
    total = weighed.agg(F.sum("w").alias("total"))
    return weighed.crossJoin(F.broadcast(total)).select("host", (F.col("w") / F.col("total")).alias("mass"))  # one row


def verdicts(pages: DataFrame, rules: list[Rule], margin: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host, for every row of ``pages``."""
    rows = ruled(pages, rules)
    edges = checkpoint(links(rows))
    hosts = rows.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.sum((F.col("ruled") == "block").cast("long")).alias("bad"))
    hosts = materialize(hosts, "hosts")
    trust = propagate(edges, _seeds(hosts, F.coalesce("good", F.lit(0))))
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), _seeds(hosts, F.coalesce("bad", F.lit(0))))
    known = reduce(lambda a, b: a.join(b, "host", "left"), [hosts.select("host", "pages"), trust.withColumnRenamed("score", "trust"), distrust.withColumnRenamed("score", "distrust")])
    standing = known.select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bound = max(HOT_PAGES, -(-(hosts.agg(F.sum("pages")).first()[0] or 0) // MAX_HOT))
    copies = F.ceil(F.col("pages") / bound).cast("int")
    hot = hosts.where(F.col("pages") > bound).select("host", copies.alias("copies"))
    dealt = rows.select("page_id", "host", "path", "rule", "ruled", F.xxhash64("page_id", "url").alias("h")).join(F.broadcast(hot), "host", "left")
    dealt = dealt.withColumn("copy", F.pmod("h", F.coalesce("copies", F.lit(1))).cast("int"))
    judged = dealt.join(standing.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))), ["host", "copy"], "left")
    by_graph = F.when(F.col("distrust") > F.col("trust") + margin, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
