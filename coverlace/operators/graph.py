"""The similarity graph: edge weights are the Jaccard overlap of two points' sets of balls, exact or by MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlace.session import materialize
from coverlace.sources.tables import with_node_id

#: Weights at or under this are not kept by the MinHash graph.
FLOOR = 0.05
#: Nodes of a set that are paired with others in one block, about, and signatures that are compared as a block.
BLOCK, SIGNATURES = 1024, 512
#: Pairs of nodes that one task makes, about, and tasks at most.
TASK_PAIRS, MAX_TASKS = 2_000_000, 20_000


def global_balls(members: DataFrame, dataset: int = 0) -> DataFrame:
    """(ball, node_id): balls numbered over all maps and datasets by a hash-free pair key."""
    return members.select(F.concat_ws(":", F.lit(dataset), "map_id", "ball_id").alias("ball"), "node_id")


def pooled(members: list[DataFrame]) -> DataFrame:
    """Balls of several datasets over the same rows, as one table."""
    if not members:
        raise ValueError("at least one dataset is needed")
    return reduce(DataFrame.unionByName, [global_balls(m, k) for k, m in enumerate(members)])


def degrees(balls: DataFrame) -> DataFrame:
    """(node_id, d): in how many balls each node is."""
    return balls.groupBy("node_id").agg(F.count(F.lit(1)).alias("d"))


def cooccurrence(balls: DataFrame) -> DataFrame:
    """(i, j, c): in how many balls both nodes i < j are."""
    a, b = balls.select("ball", F.col("node_id").alias("i")), balls.select("ball", F.col("node_id").alias("j"))
    return a.join(b, "ball").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))


def merge_counts(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Sum degrees and co-occurrences of several batches."""
    d = reduce(DataFrame.unionByName, [p[0] for p in parts]).groupBy("node_id").agg(F.sum("d").alias("d"))
    c = reduce(DataFrame.unionByName, [p[1] for p in parts]).groupBy("i", "j").agg(F.sum("c").alias("c"))
    return d, c


def normalised(d: DataFrame, c: DataFrame, threshold: float = 0.0, keep: bool = False) -> DataFrame:
    """(i, j, w, and c to ``keep``): w = c / (d_i + d_j - c), where it is above ``threshold``."""
    of = lambda k: d.select(F.col("node_id").alias(k), F.col("d").alias(f"d_{k}"))
    w = F.col("c") / (F.col("d_i") + F.col("d_j") - F.col("c"))
    return c.join(of("i"), "i").join(of("j"), "j").where(F.col("d_i") + F.col("d_j") > F.col("c")).select("i", "j", w.alias("w"), *(["c"] if keep else [])).where(F.col("w") > threshold)


class SetGraph:
    """A graph in which nodes of one set have the same edges and weigh one among themselves: pairs of nodes are made only
    where they are asked for.

    members (rep, node_id): the nodes of every set, which goes by its least node; sets (rep, size); links (i, j, size_i,
    size_j, w): the sets i < j that have edges, and every set with itself.
    """

    def __init__(self, members: DataFrame, sets: DataFrame, links: DataFrame):
        self.members, self.sets, self.links = members, sets, links

    @cached_property
    def blocks(self) -> DataFrame:
        """(rep, block, ids): the nodes of every set in blocks of about BLOCK."""
        sized = self.members.join(self.sets.select("rep", F.ceil(F.col("size") / BLOCK).alias("n")), "rep")
        placed = sized.select("rep", F.pmod(F.xxhash64("node_id"), F.col("n")).cast("int").alias("block"), "node_id")
        return materialize(placed.groupBy("rep", "block").agg(F.collect_list("node_id").alias("ids")), "blocks")  # about BLOCK each

    def node_pairs(self, links: DataFrame) -> DataFrame:
        """``links`` (i <= j, their sizes, other columns) as the pairs of their nodes: (p, q, other columns), p of set i.

        Blocks meet and are multiplied out where they are used: no pair of nodes is shuffled.
        """
        total = links.agg(F.sum(n_pairs())).first()[0] or 0
        of = lambda k: self.blocks.select(F.col("rep").alias(k), F.col("block").alias(f"block_{k}"), F.col("ids").alias(f"ids_{k}"))
        rows = links.drop("size_i", "size_j").join(of("i"), "i").join(of("j"), "j").where("i != j or block_i <= block_j")
        rows = rows.repartition(max(1, min(-(-int(total) // TASK_PAIRS), MAX_TASKS)), "i", "block_i", "j", "block_j")
        rows = rows.withColumn("p", F.explode("ids_i")).drop("ids_i").withColumn("q", F.explode("ids_j")).drop("ids_j")
        return rows.where("i != j or block_i != block_j or p < q").drop("i", "j", "block_i", "block_j")

    def edges(self, threshold: float | None = None, *columns: str) -> DataFrame:
        """(i, j, w, or the ``columns`` of links): pairs of nodes i < j, of those above ``threshold``."""
        columns = columns or ("w",)
        links = self.links if threshold is None else self.links.where(F.col("w") > threshold)
        return self.node_pairs(links.select("i", "j", "size_i", "size_j", *columns)).select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), *columns)

    def pairs(self, threshold: float | None = None) -> DataFrame:
        """(i, j, w): the sets i < j that have edges."""
        rows = self.links.where("i < j").select("i", "j", "w")
        return rows if threshold is None else rows.where(F.col("w") > threshold)

    def star(self) -> DataFrame:
        """(i, j, w): every node with its set's first."""
        return self.members.where("node_id != rep").select(F.col("rep").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("w"))

    def spanning(self) -> DataFrame:
        """Edges with the same components as all edges at every threshold below one."""
        return self.pairs().unionByName(self.star())

    def weights(self, threshold: float | None = None) -> DataFrame:
        """(w, k): how many pairs of nodes have each weight, above ``threshold``."""
        rows = self.links if threshold is None else self.links.where(F.col("w") > threshold)
        return rows.select("w", n_pairs().alias("k")).where("k > 0").groupBy("w").agg(F.sum("k").alias("k"))

    def ends(self) -> DataFrame:
        """(rep, k, w): how many edges of each weight a node of a set has to one other, or to its own, set."""
        out = self.links.where("i < j").select(F.col("i").alias("rep"), F.col("size_j").alias("k"), "w")
        out = out.unionByName(self.links.where("i < j").select(F.col("j").alias("rep"), F.col("size_i").alias("k"), "w"))
        return out.unionByName(self.links.where("i = j and size_i > 1").select(F.col("i").alias("rep"), (F.col("size_i") - 1).alias("k"), "w"))

    def degrees(self) -> DataFrame:
        """(node_id, degree, val, top): number, sum and maximum of the weights of each node's edges, where it has any."""
        k = F.col("k")
        own = self.ends().groupBy("rep").agg(F.sum("k").alias("degree"), F.sum(k * F.col("w")).alias("val"), F.max("w").alias("top"))
        return self.members.join(own, "rep").select("node_id", "degree", "val", "top")


def n_pairs():
    """How many pairs of nodes a row of links stands for."""
    i, j = F.col("size_i"), F.col("size_j")
    return F.when(F.col("i") < F.col("j"), i * j).otherwise((i * (i - 1) / 2).cast("long"))


def ball_sets(balls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, own, size): every different set of balls that a node is in, under its least node; (rep, node_id): its nodes."""
    whole = materialize(balls.groupBy("node_id").agg(F.array_sort(F.collect_set("ball")).alias("own")), "whole")  # a node's balls
    sets = materialize(whole.groupBy("own").agg(F.min("node_id").alias("rep"), F.count(F.lit(1)).alias("size")), "sets")
    return sets.select("rep", "own", "size"), materialize(whole.join(sets, "own").select("rep", "node_id"), "members")


class ExactGraph(SetGraph):
    """The exact graph over different sets of balls; links have c, the balls that both sets have.

    There are as many sets as the balls cut the points into, which does not grow with the points of a cover.
    """

    def __init__(self, balls: DataFrame):
        sets, members = ball_sets(balls)
        c = cooccurrence(sets.select(F.explode("own").alias("ball"), F.col("rep").alias("node_id")))
        d = sets.select(F.col("rep").alias("node_id"), F.size("own").cast("long").alias("d"), "size")
        of = lambda k: d.select(F.col("node_id").alias(k), F.col("size").alias(f"size_{k}"))
        pairs = normalised(d.select("node_id", "d"), c, keep=True).join(of("i"), "i").join(of("j"), "j")
        own = d.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.col("d").alias("c"), F.lit(1.0).alias("w"), F.col("size").alias("size_i"), F.col("size").alias("size_j"))
        super().__init__(members, sets.select("rep", "size"), materialize(pairs.unionByName(own), "links"))


def exact_graph(balls: DataFrame, threshold: float = 0.0) -> DataFrame:
    return ExactGraph(balls).edges(threshold)


def rescaled(edges: DataFrame) -> DataFrame:
    """Weights divided by the largest where that is over one."""
    top = edges.agg(F.greatest(F.lit(1.0), F.coalesce(F.max("w"), F.lit(1.0))).alias("top"))
    return edges.crossJoin(F.broadcast(top)).select("i", "j", (F.col("w") / F.col("top")).alias("w"))  # one row


# MinHash -------------------------------------------------------------------------------------------------------------


def signatures(balls: DataFrame, d: int = 256, seed: int = 42) -> DataFrame:
    """(node_id, r, h): the least hash of a node's balls in each of ``d`` rows. Partial minima combine before the shuffle."""
    if d < 1:
        raise ValueError("a signature has at least one row")
    rows = balls.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    return rows.groupBy("node_id", "r").agg(F.min(F.xxhash64(F.lit(seed), "ball", "r")).alias("h"))


def merge_signatures(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("node_id", "r").agg(F.min("h").alias("h"))


def choose_bands(d: int, target: float = FLOOR) -> tuple[int, int]:
    """Rows a band and bands, r b = d, whose threshold (1/b)^(1/r) is nearest to ``target``; more bands on ties."""
    pairs = [(r, d // r) for r in range(1, d + 1) if d % r == 0]
    return min(pairs, key=lambda x: (abs((1 / x[1]) ** (1 / x[0]) - target), -x[1]))


def _collapsed(sigs: DataFrame, sets: DataFrame | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rep, hs, size): every different signature under its least node, and how many nodes have it; (rep, node_id): these.

    ``sigs`` are of nodes, or of the ``sets`` (rep, size) that have ``members`` (rep, node_id).
    """
    whole = sigs.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]).alias("hs"))
    size = F.lit(1).cast("long")
    if sets is not None:
        whole, size = whole.join(sets.select(F.col("rep").alias("node_id"), "size"), "node_id"), F.col("size")
    whole = materialize(whole, "signatures")
    reps = materialize(whole.groupBy("hs").agg(F.min("node_id").alias("rep"), F.sum(size).alias("size")), "reps")
    own = whole.select("hs", "node_id").join(reps, "hs").select("rep", "node_id")
    if members is not None:
        own = own.withColumnRenamed("node_id", "of").join(members.select(F.col("rep").alias("of"), "node_id"), "of").select("rep", "node_id")
    return reps.select("rep", "hs", "size"), materialize(own, "members")


def _compare(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """For signatures as rows of ``a`` and ``b``, in how many places each pair agrees; 0 where no band of ``r`` does."""
    n, met = np.zeros((len(a), len(b)), np.int32), np.zeros((len(a), len(b)), bool)
    for k in range(0, a.shape[1], r):
        band = [a[:, c, None] == b[None, :, c] for c in range(k, min(k + r, a.shape[1]))]
        for x in band:
            n += x
        met |= np.logical_and.reduce(band)
    return np.where(met, n, 0)


def _rep_pairs(reps: DataFrame, d: int, r: int, floor: float = 0.0) -> DataFrame:
    """(i, j, w): signatures that agree on all ``r`` rows of a band, with the share of equal rows, where it is above
    ``floor``.

    Signatures are laid out in blocks in their own order, so that like ones stand together; two blocks meet if any two of
    theirs share a band, and are then compared place by place. No bucket is cut, and no pair is made more than once.
    """
    placed = with_node_id(reps.select("rep", "hs"), "hs", name="at").withColumn("blk", F.floor(F.col("at") / SIGNATURES))
    placed = materialize(placed, "placed")
    bands = F.transform(F.sequence(F.lit(0), F.floor((F.size("hs") - 1) / r).cast("int")), lambda k: F.xxhash64(F.slice("hs", k * r + 1, r)))
    keyed = placed.select("blk", F.posexplode(bands).alias("band", "key")).distinct()
    meet = keyed.withColumnRenamed("blk", "x").join(keyed.withColumnRenamed("blk", "y"), ["band", "key"]).where("x <= y").select("x", "y").distinct()
    packed = placed.groupBy("blk").agg(F.collect_list("rep").alias("reps"), F.flatten(F.collect_list("hs")).alias("hs"))  # SIGNATURES rows each
    of = lambda c: packed.select(F.col("blk").alias(c), F.col("reps").alias(f"reps_{c}"), F.col("hs").alias(f"hs_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                i, j = (row[f"reps_{c}"].values.to_numpy() for c in "xy")
                a, b = (row[f"hs_{c}"].values.to_numpy().reshape(-1, d) for c in "xy")
                n = _compare(a, b, r)
                if row["x"].as_py() == row["y"].as_py():
                    n = np.triu(n, 1)
                p, q = np.nonzero(n > floor * d)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[p], j[q])), pa.array(np.maximum(i[p], j[q])), pa.array(n[p, q] / d)], names=["i", "j", "w"])

    return meet.join(of("x"), "x").join(of("y"), "y").mapInArrow(run, "i long, j long, w double")


def _sized(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (i, j, w) of signatures, and each with itself, with their sizes."""
    own = reps.select(F.col("rep").alias("i"), F.col("rep").alias("j"), F.lit(1.0).alias("w"))
    of = lambda k: reps.select(F.col("rep").alias(k), F.col("size").alias(f"size_{k}"))
    return pairs.unionByName(own).join(of("i"), "i").join(of("j"), "j")


def candidates(sigs: DataFrame, d: int, bands: tuple[int, int] | None = None) -> DataFrame:
    """(i, j): all nodes that agree on all rows of a band. Nodes of equal signature are one until the end."""
    r, _ = bands or choose_bands(d)
    reps, members = _collapsed(sigs)
    return SetGraph(members, reps.select("rep", "size"), materialize(_sized(_rep_pairs(reps, d, r), reps), "links")).edges().select("i", "j")


class CollapsedGraph(SetGraph):
    """The MinHash graph over different signatures: the share of equal rows of candidates, where it is above the floor."""

    def __init__(self, sigs: DataFrame, d: int, floor: float = FLOOR, sets: DataFrame | None = None, members: DataFrame | None = None):
        reps, own = _collapsed(sigs, sets, members)
        super().__init__(own, reps.select("rep", "size"), materialize(_sized(_rep_pairs(reps, d, choose_bands(d)[0], floor), reps), "links"))

    @classmethod
    def of(cls, balls: DataFrame, d: int = 256, seed: int = 42) -> CollapsedGraph:
        """Nodes of the same balls have the same signature, which is taken once."""
        sets, members = ball_sets(balls)
        sigs = signatures(sets.select(F.explode("own").alias("ball"), F.col("rep").alias("node_id")), d, seed)
        return cls(sigs, d, sets=sets.select("rep", "size"), members=members)


def estimated_graph(sigs: DataFrame, d: int, floor: float = FLOOR) -> DataFrame:
    return CollapsedGraph(sigs, d, floor).edges()


def minhash_graph(balls: DataFrame, d: int = 256, seed: int = 42) -> DataFrame:
    return CollapsedGraph.of(balls, d, seed).edges()


class SignatureAccumulator:
    """Folds batches of balls into one signature table."""

    def __init__(self, d: int = 256, seed: int = 42):
        self.d, self.seed, self.sigs = d, seed, None

    def add(self, balls: DataFrame) -> None:
        new = signatures(balls, self.d, self.seed)
        self.sigs = new if self.sigs is None else merge_signatures([self.sigs, new])

    def graph(self) -> DataFrame:
        return estimated_graph(self.sigs, self.d)


def set_graph(balls: DataFrame, construction: str = "minhash", d: int = 256, seed: int = 42) -> SetGraph:
    if construction == "exact":
        return ExactGraph(balls)
    if construction == "minhash":
        return CollapsedGraph.of(balls, d, seed)
    raise ValueError(f"unknown construction '{construction}'")


def build_graph(balls: DataFrame, construction: str = "minhash", d: int = 256, seed: int = 42) -> DataFrame:
    return set_graph(balls, construction, d, seed).edges()
