"""Component counts over all thresholds, plateaus, and the threshold in the middle of the widest one.

The counts at all thresholds follow from one maximum spanning forest: the number of components of the edges at or above
a threshold is the number of nodes less the forest's edges there. The forest is found from local forests (an edge that a
part of the edges leaves out, all of them leave out) and, if still large, by Boruvka's rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.operators.components import connected_components
from coverlace.operators.graph import SetGraph
from coverlace.session import checkpoint

BINS = 256
#: Edges up to which the driver finishes a forest; beyond it, rounds over DataFrames do.
DRIVER_EDGES = 200_000
EDGES = "i long, j long, w double"


def _kruskal(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of a maximum spanning forest's edges, by (w descending, i, j)."""
    order = np.lexsort((j, i, -w))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    keep = []
    for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _local_forests(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            held = t.take(pa.array(_kruskal(*(t[c].to_numpy() for c in ("i", "j", "w")))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")).mapInArrow(run, EDGES)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(i, j, w): the maximum spanning forest, ties by (i, j)."""
    spark = edges.sparkSession
    local = checkpoint(_local_forests(edges))
    if local.count() <= DRIVER_EDGES:
        t = local.toPandas()
        keep = _kruskal(*(t[c].to_numpy() for c in ("i", "j", "w")))
        return spark.createDataFrame(t.iloc[keep], EDGES)
    return _boruvka(local)


def _boruvka(edges: DataFrame) -> DataFrame:
    """Every component takes its best outgoing edge; the taken edges join components; again until none goes out."""
    left, forest = edges.select("i", "j", "w", F.col("i").alias("a"), F.col("j").alias("b")), None
    while True:
        ends = left.select(F.col("a").alias("c"), "i", "j", "w").unionByName(left.select(F.col("b").alias("c"), "i", "j", "w"))
        best = ends.groupBy("c").agg(F.max(F.struct("w", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))).alias("e"))
        taken = checkpoint(best.select(F.col("e.w").alias("w"), (-F.col("e.ni")).alias("i"), (-F.col("e.nj")).alias("j")).distinct())
        if not taken.take(1):
            return forest if forest is not None else edges.select("i", "j", "w").limit(0)
        forest = taken.select("i", "j", "w") if forest is None else forest.unionByName(taken.select("i", "j", "w"))
        joined = connected_components(taken.join(left, ["i", "j", "w"]).select("a", "b"), "a", "b")
        of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"n{c}"))
        moved = left.join(of("a"), "a", "left").join(of("b"), "b", "left")
        moved = moved.select("i", "j", "w", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).where("a != b")
        left = checkpoint(moved)


def _bin(w, bins: int):
    return F.least(F.floor(w * bins), F.lit(bins - 1)).cast("int")


def component_curve(forest: DataFrame, n: int, bins: int = BINS) -> DataFrame:
    """(bin, threshold, components) for every bin, from the highest threshold down."""
    spark = forest.sparkSession
    counts = forest.select(_bin(F.col("w"), bins).alias("bin")).groupBy("bin").count()
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left")  # bins rows
    upto = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")))
    return every.select("bin", (F.col("bin") / F.lit(float(bins))).alias("threshold"), (F.lit(n) - upto).cast("long").alias("components"))


def plateaus(curve: DataFrame) -> DataFrame:
    """(start, end, components, length, midpoint): maximal runs of one count, widest first, then from the highest."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))  # bins rows
    change = F.when(F.lag("components").over(w) == F.col("components"), 0).otherwise(1)
    run = curve.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    out = run.groupBy("run", "components").agg(F.max("threshold").alias("start"), F.min("threshold").alias("end"))
    out = out.select("start", "end", "components", (F.col("start") - F.col("end")).alias("length"), ((F.col("start") + F.col("end")) / 2).alias("midpoint"))
    return out.orderBy(F.desc("length"), F.desc("start"))


def change_points(curve: DataFrame) -> DataFrame:
    """(threshold, components) where the count changes, and always the last threshold."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))
    before = F.lag("components").over(w)
    return curve.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("components")) | (F.col("bin") == 0)).select("threshold", "components")


def optimal_threshold(found: DataFrame, n: int) -> float:
    """The middle of the widest plateau with more than one and fewer than n components, else of the widest; 0.5 for none."""
    good = (F.col("components") > 1) & (F.col("components") < n)
    row = found.orderBy(F.desc(good), F.desc("length"), F.desc("start")).limit(1).collect()
    return float(row[0]["midpoint"]) if row else 0.5


def component_labels(nodes: DataFrame, edges: DataFrame, threshold: float, by_size: bool = False, forest: DataFrame | None = None) -> DataFrame:
    """(node_id, label): components of the edges above ``threshold``, numbered by least node, or by size descending."""
    comps = connected_components((forest if forest is not None else edges).where(F.col("w") > threshold), "i", "j")
    root = nodes.select("node_id").join(comps, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("root"))
    return _by_root(root, by_size)


def set_roots(graph: SetGraph, threshold: float) -> DataFrame:
    """(rep, root): the least node that each set of a graph reaches above ``threshold``, which is below one."""
    if threshold >= 1:
        raise ValueError("nodes of a set weigh one among themselves")
    comps = connected_components(graph.pairs(threshold), "i", "j")
    return graph.sets.join(comps, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("root"))


def set_labels(nodes: DataFrame, graph: SetGraph, threshold: float, by_size: bool = False) -> DataFrame:
    """``component_labels`` of a graph of sets: only sets are joined up."""
    if threshold >= 1:  # no edge is above
        return _by_root(nodes.select("node_id", F.col("node_id").alias("root")), by_size)
    own = graph.members.join(set_roots(graph, threshold), "rep").select("node_id", "root")
    return _by_root(nodes.select("node_id").join(own, "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("root")), by_size)


def set_forest(graph: SetGraph) -> DataFrame:
    """(i, j, w): a maximum spanning forest of a graph of sets; those of the nodes of a set weigh one and the others less."""
    return spanning_forest(graph.pairs()).unionByName(graph.star())


def _by_root(root: DataFrame, by_size: bool) -> DataFrame:
    root = checkpoint(root)
    sizes = checkpoint(root.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    order = [F.desc("size"), "root"] if by_size else ["root"]
    return root.join(numbered(sizes, *order), "root").select("node_id", "label")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with label 0, 1, ... in order, by range partitions and their counts."""
    from coverlace.sources.tables import with_node_id

    return with_node_id(rows, *order, name="label")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


# Shapes of a partition -----------------------------------------------------------------------------------------------


def mass_profile(sizes: DataFrame, n: int, small_share: float = 0.01) -> DataFrame:
    """One row: components, singletons, the giant's and the small components' shares of all nodes."""
    size = F.col("size")
    return sizes.agg(
        F.count(F.lit(1)).alias("component_count"),
        F.count_if(size == 1).alias("singleton_count"),
        (F.max(size) / F.lit(float(n))).alias("giant_fraction"),
        (F.count_if(size == 1) / F.lit(float(n))).alias("singleton_fraction"),
        (F.sum(F.when(size <= F.lit(max(1, int(small_share * n))), size).otherwise(0)) / F.lit(float(n))).alias("small_mass_fraction"),
    )


def useful_size(n: int) -> int:
    return max(3, min(round(n**0.5), round(0.005 * n))) if n > 0 else 1
