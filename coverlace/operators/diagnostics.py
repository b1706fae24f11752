"""What a similarity graph looks like: density, degrees, percentiles, hubs, health, and advice."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.session import checkpoint
from coverlace.sources.tables import node_degrees


def weight_percentiles(edges: DataFrame, n: int, shares: tuple[float, ...] = (0.25, 0.5, 0.95)) -> dict[str, float]:
    """Linear-interpolated percentiles over all n(n-1)/2 pairs, most of which have no edge and weigh zero.

    Only the order statistics that fall among the edges are looked up.
    """
    return counted_percentiles(edges.groupBy("w").agg(F.count(F.lit(1)).alias("k")), n, shares)  # weights are ratios of small counts


def counted_percentiles(sizes: DataFrame, n: int, shares: tuple[float, ...] = (0.25, 0.5, 0.95)) -> dict[str, float]:
    """The same from how many edges have each weight (w, k)."""
    pairs = n * (n - 1) // 2
    sizes = checkpoint(sizes)
    m = int(sizes.agg(F.sum("k")).first()[0] or 0)
    zeros = pairs - m
    wanted = sorted({k for s in shares for k in (math.floor(s * (pairs - 1)), math.ceil(s * (pairs - 1))) if k >= zeros}) if pairs else []
    value: dict[int, float] = {}
    if wanted:
        upto = sizes.withColumn("upto", F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("w")))
        for k in wanted:
            value[k] = upto.where(F.col("upto") > k - zeros).agg(F.min("w")).first()[0]
    out = {}
    for s in shares:
        at = s * (pairs - 1) if pairs else 0
        lo, hi = value.get(math.floor(at), 0.0), value.get(math.ceil(at), 0.0)
        out[f"p{round(100 * s)}"] = lo + (hi - lo) * (at - math.floor(at))
    return out


def graph_metrics(nodes: DataFrame, edges: DataFrame, n: int, sizes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree, component counts and shares."""
    return counted_metrics(edges.groupBy("w").agg(F.count(F.lit(1)).alias("k")), n, sizes)


def counted_metrics(weights: DataFrame, n: int, sizes: DataFrame) -> DataFrame:
    """The same from how many edges have each weight (w, k)."""
    m = weights.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_edges"))
    c = sizes.agg(F.count(F.lit(1)).alias("component_count"), F.max("size").alias("giant"), F.count_if(F.col("size") == 1).alias("singletons"))
    pairs = float(n * (n - 1) / 2) or 1.0
    return m.crossJoin(F.broadcast(c)).select(  # one row each
        F.lit(n).cast("long").alias("n_nodes"), "n_edges", (F.col("n_edges") / pairs).alias("density"), (2 * F.col("n_edges") / F.lit(float(max(n, 1)))).alias("avg_degree"),
        "component_count", (F.col("giant") / F.lit(float(n))).alias("giant_fraction"), (F.col("singletons") / F.lit(float(n))).alias("singleton_fraction"),
    )


def hubs(nodes: DataFrame, edges: DataFrame, labels: DataFrame, top: int = 3) -> DataFrame:
    """(label, rank, node_id, degree, val): the nodes of most weight in each component."""
    rows = node_degrees(nodes, edges).join(labels, "node_id").where("degree > 0")
    order = Window.partitionBy("label").orderBy(F.desc("val"), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("label", "rank", "node_id", "degree", "val")


def singletons_at(nodes: DataFrame, edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, singletons): nodes whose heaviest edge is not above the threshold."""
    ends = edges.select(F.col("i").alias("node_id"), "w").unionByName(edges.select(F.col("j").alias("node_id"), "w")).groupBy("node_id").agg(F.max("w").alias("top"))
    return tops_at(nodes, ends, thresholds)


def tops_at(nodes: DataFrame, ends: DataFrame, thresholds: list[float]) -> DataFrame:
    """The same from the weight ``top`` of the heaviest edge of nodes that have any."""
    top = nodes.select("node_id").join(ends, "node_id", "left")
    row = top.agg(*[F.count_if(F.coalesce("top", F.lit(-1.0)) <= t).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("singletons")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")


def grid_adequacy(maps: int) -> str:
    return "under_sampled" if maps < 15 else "thin_grid" if maps < 40 else "ok"


def advisories(n_edges: int, density: float, singletons: float, giant: float) -> list[str]:
    found = [("EMPTY_GRAPH", n_edges == 0), ("HAIRBALL", density > 0.8), ("HIGH_SINGLETONS", singletons > 0.8), ("DOMINANT_COMPONENT", giant > 0.95)]
    return [code for code, hit in found if hit]


def sweep_health(density: float, singletons: float, components: int, n: int) -> str:
    return "hairball" if density > 0.8 else "fragmented" if singletons > 0.25 or components > max(3, 0.1 * n) else "connected"


def history_health(n_edges: int, density: float, singletons: float, giant: float) -> str:
    rules = [("empty", n_edges == 0), ("hairball", density > 0.8), ("fragmented", singletons > 0.25), ("sparse", density < 0.05), ("giant_dominant", giant > 0.95)]
    return next((name for name, hit in rules if hit), "connected")


def finalization_gate(giant: float, sweeps: int, density: float, maps: int) -> str:
    """Whether a graph with one dominant component has been looked at closely enough."""
    doubts = [sweeps < 3, density > 0.35, maps < 40]
    if giant <= 0.95 or not any(doubts):
        return "ready"
    return "blocked" if sum(doubts) >= 2 else "caution"


def sparsifier_estimate(n: int, edges: int, epsilon: float) -> dict:
    sketch = math.ceil(24 * math.log(max(n, 2)) / epsilon**2)
    return {"sketch_dim": sketch, "sample_count": math.ceil(9 * n * math.log(max(n, 2)) / epsilon**2), "seconds": sketch * edges / 4.5e6}


def minhash_error(d: int, delta: float = 0.05) -> float:
    return math.sqrt(math.log(2 / delta) / (2 * d))


def minhash_rows(error: float, delta: float = 0.05) -> int:
    return math.ceil(math.log(2 / delta) / (2 * error**2))


def minhash_advice(n: int, d: int, weight: float = 0.5, delta: float = 0.05) -> dict:
    deviation = math.sqrt(weight * (1 - weight) / d)
    return {"error": minhash_error(d, delta), "standard_error": deviation, "interval": (max(0.0, weight - 1.96 * deviation), min(1.0, weight + 1.96 * deviation)), "memory_bytes": 4 * d * n, "large": n >= 500_000}


def size_buckets(sizes: DataFrame) -> DataFrame:
    """(bucket, components): sizes 1, 2-5, 6-20 and over 20."""
    bucket = F.when(F.col("size") == 1, "1").when(F.col("size") <= 5, "2-5").when(F.col("size") <= 20, "6-20").otherwise(">20")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("components"))


def fragmentation(sizes: DataFrame, n: int) -> DataFrame:
    """One row: singletons, small, nontrivial and significant components."""
    nontrivial, significant = max(10, math.ceil(0.01 * n)), max(25, math.ceil(0.03 * n))
    s = F.col("size")
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(s == 1).alias("singletons"), F.count_if((s > 1) & (s < nontrivial)).alias("small"), F.count_if(s >= nontrivial).alias("nontrivial"), F.count_if(s >= significant).alias("significant"))


def compare_runs(before: dict, after: dict) -> list[dict]:
    """One row per figure of two runs, with its change where it is a number."""
    rows = []
    for key in sorted(before.keys() | after.keys()):
        a, b = before.get(key), after.get(key)
        numeric = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
        rows.append({"field": key, "before": a, "after": b, "change": b - a if numeric else None, "same": a == b})
    return rows


def fragmentation_trend(previous: dict, now: dict, n: int) -> str:
    """What the last sweep did, from singleton fraction, largest non-giant and nontrivial mass of two runs."""
    if now["singleton_fraction"] - previous["singleton_fraction"] > 0.05:
        return "over_fragmentation"
    gain = now["nontrivial_mass"] - previous["nontrivial_mass"]
    if now["largest_non_giant"] >= max(25, math.ceil(0.03 * n)) / n or gain >= 0.03:
        return "meaningful_resolution"
    return "ice_chipping" if now["component_count"] > previous["component_count"] and gain < 0.02 else "stable"


def articulation_points(nodes: DataFrame, edges: DataFrame, max_nodes: int = 1000, max_edges: int = 25_000) -> list[int] | None:
    """Nodes whose removal splits their component, for small graphs; None beyond the bounds."""
    if nodes.limit(max_nodes + 1).count() > max_nodes or edges.limit(max_edges + 1).count() > max_edges:
        return None
    near: dict[int, list[int]] = {}
    for r in edges.select("i", "j").collect():
        near.setdefault(r.i, []).append(r.j)
        near.setdefault(r.j, []).append(r.i)
    depth: dict[int, int] = {}
    low: dict[int, int] = {}
    cut: set[int] = set()
    for root in sorted(near):
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            for u in rest:
                if u not in depth:
                    depth[u] = low[u] = depth[v] + 1
                    stack.append((u, v, iter(near[u])))
                    break
                if u != parent:
                    low[v] = min(low[v], depth[u])
            else:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[v])
                    if parent == root:
                        children += 1
                    elif low[v] >= depth[parent]:
                        cut.add(parent)
        if children > 1:
            cut.add(root)
    return sorted(cut)


#: What a skeleton shows: numbers alone, with a summary, with its nodes, with its edges, or all.
SKELETONS = ("summary", "nodes", "full_nodes", "edges", "full")


def skeleton(nodes: DataFrame, edges: DataFrame, labels: DataFrame, threshold: float, detail: str = "summary", max_nodes: int = 1000, max_edges: int = 5000) -> dict:
    """A bounded view of the graph above ``threshold``: counts, sizes, and what ``detail`` adds; what is left out is told."""
    if detail not in SKELETONS:
        raise ValueError(f"detail is one of {', '.join(SKELETONS)}")
    kept = edges.where(F.col("w") > threshold)
    n, m = nodes.count(), kept.count()
    counts = {r["size"]: r["count"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).groupBy("size").count().collect()}  # at most sqrt(2 n) sizes
    top = [s for s in sorted(counts, reverse=True) for _ in range(min(counts[s], 20))][:20]
    components = sum(counts.values())
    buckets = {"1": (1, 1), "2-5": (2, 5), "6-20": (6, 20), ">20": (21, math.inf)}
    summary = {"total": components, "preview": top, "omitted": max(components - len(top), 0), "largest": top[:5], "singleton_count": counts.get(1, 0), "size_buckets": {k: sum(c for s, c in counts.items() if a <= s <= b) for k, (a, b) in buckets.items()}}
    own = [r["node_id"] for r in nodes.select("node_id").orderBy("node_id").limit(max_nodes).collect()] if detail in ("full_nodes", "full") else []
    links = [tuple(r) for r in kept.select("i", "j", "w").orderBy("i", "j").limit(max_edges).collect()] if detail in ("edges", "full") else []
    out = {
        "detail": detail, "node_count": n, "edge_count": m, "resolved_construction_threshold": threshold, "component_count": components, "component_sizes_summary": summary,
        "nodes_returned": len(own), "nodes_omitted": n - len(own), "edges_returned": len(links), "edges_omitted": m - len(links),
    }
    if detail == "nodes":
        out["topological_summary"] = {"hubs": [tuple(r) for r in node_degrees(nodes, kept).orderBy(F.desc("val"), "node_id").limit(10).collect()], "articulation_points": articulation_points(nodes, kept)}
    return out | ({"nodes": own} if own else {}) | ({"edges": links} if links else {})
