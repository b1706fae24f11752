"""Connected components of an edge table, as star contractions over DataFrames.

Each round rewires every edge to the least node its end knows of (large star for greater neighbours, small star for
lesser ones): two min-aggregates, which combine before the shuffle, and two joins. After some rounds all members of a
component hang on its least node, so the edges of nodes with very many are dealt out: a hub's row of the join is copied, and
its edges choose one copy by their other end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlace.session import checkpoint


#: Edges of a node from which on it is a hub, at least, and hubs at most: the bound rises with the edges, so that the list
#: of hubs, which goes to all tasks, stays bounded.
HUB_EDGES, MAX_HUBS = 1 << 16, 10_000


def _joined(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) joined with ``least`` (u, m, n); ``n`` is the number of u's edges, ``total`` that of all."""
    bound = max(HUB_EDGES, -(-2 * total // MAX_HUBS))
    if 2 * total <= bound:  # no node can have more
        return edges.join(least, "u")
    hubs = least.where(F.col("n") > bound).select("u", F.ceil(F.col("n") / bound).cast("int").alias("copies"))
    dealt = edges.join(F.broadcast(hubs), "u", "left").withColumn("copy", F.pmod(F.xxhash64("v"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    copied = least.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / bound).cast("int") - 1, F.lit(0)))))
    return dealt.join(copied, ["u", "copy"]).drop("copy")


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over rows (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        out = _joined(both.where(F.col("v") > F.col("u")), least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        out = _joined(edges, least, total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        out = out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the least node reachable.

    Nulls and self-loops make no link; repeated edges count once; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpoint(e.distinct())
    was = _state(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        e = checkpoint(_star(_star(e, True, was[0]), False, was[0]))
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
