"""Ball Mapper covers: a greedy net of centres per map, and all points within the radius of each.

A map is an embedding with a radius; all maps of a sweep are covered together. Centres are found in row order: a point is
one if no earlier centre is within the radius. That order is sequential, but only among points that no earlier centre
covers, so each round takes the first undecided points of every map (a bounded number), settles them among themselves,
and strikes out what the new centres cover everywhere. Most points fall in the first rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.session import checkpoint

#: Undecided points of a map that one round settles, about.
ROUND_POINTS = 4096
#: Ranges of ids by which a round's points are chosen.
ID_RANGES = 2048
#: Numbers in all centres together up to which they are sent to every task; beyond it, points and centres meet by grid cell.
BROADCAST_NUMBERS = 4_000_000


def map_grid(embeddings: DataFrame, epsilons: list[float]) -> DataFrame:
    """(map_id, eps, node_id, v): embeddings outer, radii inner."""
    if not epsilons or min(epsilons) < 0:
        raise ValueError("radii must be given and not negative")
    radii = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(e)).alias("eps")) for k, e in enumerate(epsilons)])
    out = embeddings.withColumn("r", F.explode(radii))
    return out.select((F.col("emb_id") * len(epsilons) + F.col("r.k")).cast("int").alias("map_id"), F.col("r.eps").alias("eps"), "node_id", "v")


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Summed in the order of the dimensions, point by point."""
    out = np.zeros((len(x), len(c)))
    for k in range(x.shape[1]):
        d = x[:, k, None] - c[None, :, k]
        out += d * d
    return out


def _array_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 1))


def greedy(x: np.ndarray, eps: float) -> np.ndarray:
    """Positions of the greedy centres of points in order."""
    out: list[int] = []
    open_ = np.ones(len(x), bool)
    while open_.any():
        i = int(open_.argmax())
        out.append(i)
        open_ &= squared_distances(x, x[i : i + 1])[:, 0] > eps * eps
        open_[i] = False
    return np.array(out, np.int64)


def centres(maps: DataFrame) -> DataFrame:
    """(map_id, eps, ball_id, center_id, center): balls are numbered in the order of their centres."""
    spark = maps.sparkSession
    top = maps.agg(F.max("node_id")).first()[0]
    schema = "map_id int, eps double, node_id long, v array<double>"
    found = spark.createDataFrame([], schema)
    if top is None:
        return found.select("map_id", "eps", F.lit(0).cast("long").alias("ball_id"), F.col("node_id").alias("center_id"), F.col("v").alias("center"))
    whole = max(1, -(-(top + 1) // ID_RANGES))
    undecided = maps.select("map_id", "eps", "node_id", "v")

    def settle(t: pa.Table) -> pa.Table:
        order = np.argsort(t["node_id"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        return t.take(pa.array(greedy(_array_of(t["v"]), t["eps"][0].as_py())))

    while True:
        # Rows here: ID_RANGES at most. A first range of more points than a round takes is cut into ranges itself.
        step, some = whole, undecided
        while counts := some.groupBy("map_id", F.floor(F.col("node_id") / step).alias("r")).count().groupBy("r").agg(F.max("count").alias("n")).orderBy("r").collect():
            if counts[0]["n"] <= ROUND_POINTS or step == 1:
                break
            first = int(counts[0]["r"])
            some, step = undecided.where((F.col("node_id") >= first * step) & (F.col("node_id") < (first + 1) * step)), max(1, step // ID_RANGES)
        if not counts:
            break
        upto, n = counts[0]["r"], counts[0]["n"]
        for row in counts[1:]:
            if n + row["n"] > ROUND_POINTS:
                break
            upto, n = row["r"], n + row["n"]
        bound = (int(upto) + 1) * step
        new = checkpoint(undecided.where(F.col("node_id") < bound).groupBy("map_id").applyInArrow(settle, schema))
        found = found.unionByName(new)
        rest = undecided.where(F.col("node_id") >= bound)
        if bound > top:
            break
        own = {m: (e, np.array(v)) for m, e, v in ((r["map_id"], r["eps"], r["vs"]) for r in new.groupBy("map_id", "eps").agg(F.collect_list("v").alias("vs")).collect())}
        told = spark.sparkContext.broadcast(own)  # ROUND_POINTS a map at most

        def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("map_id").to_numpy()
                keep = np.ones(len(ids), bool)
                for m in np.unique(ids):
                    if m in told.value:
                        eps, c = told.value[m]
                        own = np.flatnonzero(ids == m)
                        x, left = _array_of(batch.column("v").take(pa.array(own))), np.arange(len(own))
                        for a in range(0, len(c), 512):
                            left = left[(squared_distances(x[left], c[a : a + 512]) > eps * eps).all(axis=1)]
                        keep[own] = False
                        keep[own[left]] = True
                yield batch.filter(pa.array(keep))

        undecided = checkpoint(rest.mapInArrow(strike, schema))
    ball = F.row_number().over(Window.partitionBy("map_id").orderBy("node_id")) - 1
    return checkpoint(found).select("map_id", "eps", ball.cast("long").alias("ball_id"), F.col("node_id").alias("center_id"), F.col("v").alias("center"))


def membership(maps: DataFrame, balls: DataFrame) -> DataFrame:
    """(map_id, ball_id, node_id): every point within the radius of a centre, the bound included."""
    n, width = balls.agg(F.count(F.lit(1)), F.max(F.size("center"))).first()
    if n * (width or 0) <= BROADCAST_NUMBERS:
        return _membership_broadcast(maps, balls)
    return membership_by_cells(maps, balls)


def _membership_broadcast(maps: DataFrame, balls: DataFrame) -> DataFrame:
    own: dict[int, list] = {}
    for r in balls.orderBy("map_id", "ball_id").collect():
        own.setdefault(r["map_id"], [r["eps"], [], []])
        own[r["map_id"]][1].append(r["ball_id"])
        own[r["map_id"]][2].append(r["center"])
    told = maps.sparkSession.sparkContext.broadcast({m: (e, np.array(b), np.array(c)) for m, (e, b, c) in own.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes = batch.column("map_id").to_numpy(), batch.column("node_id").to_numpy()
            for m in np.unique(ids):
                eps, b, c = told.value[m]
                own = np.flatnonzero(ids == m)
                for a in range(0, len(own), 4096):
                    part = own[a : a + 4096]
                    x = _array_of(batch.column("v").take(pa.array(part)))
                    for k in range(0, len(c), 512):
                        i, j = np.nonzero(squared_distances(x, c[k : k + 512]) <= eps * eps)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), m, np.int32)), pa.array(b[k + j]), pa.array(nodes[part][i])], names=["map_id", "ball_id", "node_id"])

    return maps.select("map_id", "node_id", "v").mapInArrow(run, "map_id int, ball_id long, node_id long")


def membership_by_cells(maps: DataFrame, balls: DataFrame, leading: int = 3) -> DataFrame:
    """The same by an equi-join: points within a radius are in neighbouring cells of that width in every dimension, so
    each centre is sent to the cells around its own in the first dimensions and the distance decides."""
    width = maps.select(F.size("v")).limit(1).collect()
    dims = min(leading, width[0][0]) if width else 1
    side = F.greatest(F.col("eps"), F.lit(1e-12))
    cell = lambda v, k: F.floor(F.get(v, F.lit(k)) / side).cast("long")
    p = maps.select("map_id", "node_id", "v", *[cell(F.col("v"), k).alias(f"g{k}") for k in range(dims)])
    c = balls.select("map_id", "ball_id", "eps", "center", *[cell(F.col("center"), k).alias(f"g{k}") for k in range(dims)])
    for k in range(dims):
        c = c.withColumn(f"g{k}", F.explode(F.array(*[F.col(f"g{k}") + d for d in (-1, 0, 1)])))
    d2 = F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
    return p.join(c, ["map_id", *[f"g{k}" for k in range(dims)]]).where(d2 <= F.col("eps") * F.col("eps")).select("map_id", "ball_id", "node_id")


def ball_edges(members: DataFrame) -> DataFrame:
    """(map_id, a, b): balls a < b of a map that share a point."""
    left, right = members.select("map_id", "node_id", F.col("ball_id").alias("a")), members.select("map_id", "node_id", F.col("ball_id").alias("b"))
    return left.join(right, ["map_id", "node_id"]).where("a < b").select("map_id", "a", "b").distinct()


def label_points(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, label): the first ball of each point in a map's members, -1 for none."""
    first = members.groupBy("node_id").agg(F.min("ball_id").alias("b"))
    return nodes.select("node_id").join(first, "node_id", "left").select("node_id", F.coalesce("b", F.lit(-1)).alias("label"))


def unclustered(nodes: DataFrame, members: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(members, "node_id", "left_anti")


def membership_matrix(members: DataFrame, balls: list[int]) -> DataFrame:
    """A 0/1 column per ball, for one map's members."""
    return members.groupBy("node_id").agg(*[F.max((F.col("ball_id") == b).cast("tinyint")).alias(f"ball_{b}") for b in balls])


def ball_summary(members: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Per ball of a map: size, and mean and sample deviation of numeric columns."""
    stats = [x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    return members.join(table.select("node_id", *columns), "node_id").groupBy("map_id", "ball_id").agg(F.count(F.lit(1)).alias("size"), *stats)


def map_sizes(balls: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, eps, n_nodes, n_edges) per map."""
    n = balls.groupBy("map_id").agg(F.first("eps").alias("eps"), F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "map_id", "left").select("map_id", "eps", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def representatives(sizes: DataFrame, n_reps: int = 4, seed: int = 42) -> list[int]:
    """Maps nearest to the centres of k-means over z-scored sizes and radii; all maps if there are no more."""
    rows = sizes.orderBy("map_id").collect()  # one row a map
    if len(rows) <= n_reps:
        return [r["map_id"] for r in rows]
    x = np.array([[r["n_nodes"], r["n_edges"], r["eps"]] for r in rows], float)
    deviation = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(deviation < 1e-10, 1, deviation)
    best, best_cost, rng = None, np.inf, np.random.default_rng(seed)
    for _ in range(10):
        c = z[rng.choice(len(z), n_reps, replace=False)]
        for _ in range(100):
            own = squared_distances(z, c).argmin(axis=1)
            new = np.array([z[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(n_reps)])
            if np.allclose(new, c):
                break
            c = new
        cost = squared_distances(z, c).min(axis=1).sum()
        if cost < best_cost:
            best, best_cost = c, cost
    return sorted({rows[k]["map_id"] for k in squared_distances(z, best).argmin(axis=0)})
