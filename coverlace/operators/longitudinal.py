"""What graphs over time look like: trajectories through thresholds, aggregations side by side, archetypes, neighbours."""

from __future__ import annotations

import copy

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.operators import diagnostics, panel, stability
from coverlace.plans.config import SweepConfig

#: Fixed thresholds of the ladder, and the share of pairs that an aggregation's cut leaves out.
LADDER, CUT_SHARE = (0.0, 0.1, 0.25, 0.5, 0.75), 0.9
#: Bytes that a dense array of entities, entities and times may take, and how many of them are held at once.
TENSOR_LIMIT, TENSORS = 2 << 30, 3
REPRESENTATIONS = ("trajectory", "temporal", "both")


# Before a run --------------------------------------------------------------------------------------------------------


def adapted_config(config: SweepConfig, n_features: int, knn_p5: float, knn_p95: float) -> tuple[SweepConfig, dict]:
    """A copy whose dimensions a panel of ``n_features`` has, and whose radii reach its neighbours' distances, with notes.

    Radii are replaced only where none lies within ``knn_p5`` and ``knn_p95``: such a cover would be one ball.
    """
    if n_features < 2:
        raise panel.PanelError("PANEL_TOO_FEW_FEATURES", f"{n_features} features, at least 2 are needed")
    out, notes = copy.deepcopy(config), {"panel_feature_count": n_features, "panel_epsilon_domain": {"knn_p5": round(knn_p5, 4), "knn_p95": round(knn_p95, 4)}}
    out.dimensions = [d for d in config.dimensions if d <= n_features] or [n_features]
    if dropped := [d for d in config.dimensions if d > n_features]:
        notes |= {"dimensions_requested": config.dimensions, "dimensions_applied": out.dimensions, "dimensions_dropped": dropped}
    inside = [e for e in config.epsilons if knn_p5 <= e <= knn_p95]
    notes["epsilons_in_domain"] = len(inside)
    if not inside and knn_p95 > 0:
        out.epsilons = np.round(np.linspace(knn_p5, knn_p95, max(len(config.epsilons), 2)), 6).tolist()
        notes |= {"epsilons_requested": config.epsilons, "epsilons_applied": out.epsilons}
    return out, notes


def costs(report: dict, config: SweepConfig, limit: int = TENSOR_LIMIT) -> dict:
    """What either representation of a panel (``panel.panel_report``) would take; weights over time are sparse here, so the
    dense array's size is told for comparison."""
    maps = len(config.dimensions) * len(config.seeds) * len(config.epsilons)
    size = 8 * report["entities"] ** 2 * report["times"]
    megabytes = lambda x: round(x / (1 << 20), 2)
    return {
        "n_observations": report["rows"], "n_entities": report["entities"], "n_times": report["times"], "temporal_tensor_bytes": size, "temporal_tensor_mb": megabytes(size), "temporal_peak_bytes": TENSORS * size, "temporal_peak_mb": megabytes(TENSORS * size),
        "temporal_tensor_limit_mb": megabytes(limit), "estimated_ball_maps_trajectory": maps, "estimated_ball_maps_temporal": maps * report["times"], "projection_dimensions": config.dimensions, "epsilons": config.epsilons,
    }


def guard_representation(report: dict, representation: str, limit: int = TENSOR_LIMIT) -> None:
    """Refuse what a panel cannot give: time slices need the same entities at all times, and a bounded size."""
    if representation not in REPRESENTATIONS:
        raise panel.PanelError("INVALID_REPRESENTATION", representation)
    if representation == "trajectory":
        return
    if report["rows"] != report["entities"] * report["times"]:
        raise panel.PanelError("RAGGED_PANEL_NOT_SUPPORTED", "entities differ between times")
    if (size := 8 * TENSORS * report["entities"] ** 2 * report["times"]) > limit:
        raise panel.PanelError("TENSOR_TOO_LARGE", f"{size} bytes, {limit} are allowed")


# Trajectories --------------------------------------------------------------------------------------------------------


def quantiles(values: DataFrame, column: str) -> DataFrame:
    """One row: count, p25, p50, p95 and max."""
    c = F.col(column).cast("double")
    q = F.percentile(c, [0.25, 0.5, 0.95])
    return values.agg(F.count(c).alias("count"), *[F.get(q, F.lit(k)).alias(name) for k, name in enumerate(("p25", "p50", "p95"))], F.max(c).alias("max"))


def trajectory_diagnosis(obs: DataFrame, edges: DataFrame, incidence: DataFrame | None = None) -> DataFrame:
    """One row: observations, entities, times, edges, those across times and their share, quantiles of the weights, and,
    where ``incidence`` (map_id, ball_id, obs_id) is given, balls and the balls of an observation."""
    panel_of = obs.agg(F.count(F.lit(1)).alias("n_observations"), F.count_distinct("entity").alias("n_entities"), F.count_distinct("t").alias("n_times"))
    across = panel.cross_time(edges, obs, float("-inf")).agg(F.count(F.lit(1)).alias("cross_time_edges"))
    weights = quantiles(edges, "w").select(F.col("count").alias("n_edges"), *[F.col(c).alias(f"weight_{c}") for c in ("p25", "p50", "p95", "max")])
    out = panel_of.crossJoin(weights).crossJoin(across)  # one row each
    out = out.withColumn("cross_time_fraction", F.when(F.col("n_edges") > 0, F.round(F.col("cross_time_edges") / F.col("n_edges"), 4)).otherwise(0.0))
    if incidence is None:
        return out
    balls = incidence.agg(F.count_distinct("map_id", "ball_id").alias("n_balls"))
    each = quantiles(incidence.groupBy("obs_id").agg(F.count(F.lit(1)).alias("k")), "k").select(*[F.col(c).alias(f"memberships_{c}") for c in ("p25", "p50", "p95", "max")])
    return out.crossJoin(balls).crossJoin(each)  # one row each


def threshold_ladder(obs: DataFrame, edges: DataFrame, thresholds: tuple[float, ...] = LADDER) -> DataFrame:
    """(threshold, observation_clusters, distinct_trajectories, largest_trajectory_group): how the reading of trajectories
    moves with the threshold; the forest is found once."""
    forest, nodes, out = stability.spanning_forest(edges), obs.select(F.col("obs_id").alias("node_id")), None
    for t in thresholds:
        labels = stability.component_labels(nodes, forest, t, forest=forest)
        states = obs.join(labels, F.col("obs_id") == F.col("node_id")).select("entity", "t", F.col("label").alias("state"))
        # Entities that are seen at different times differ even where their states are the same.
        seqs = states.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("t", "state"))).alias("s"))
        groups = seqs.groupBy("s").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("distinct_trajectories"), F.max("k").alias("largest_trajectory_group"))
        row = states.agg(F.count_distinct("state").alias("observation_clusters")).crossJoin(groups).select(F.lit(float(t)).alias("threshold"), "observation_clusters", "distinct_trajectories", "largest_trajectory_group")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def archetype_report(states: DataFrame, most: int = 10, most_entities: int = 5) -> DataFrame:
    """(sequence, n_entities, fraction, transitions, entities, entities_omitted): the commonest sequences of (entity, t,
    state), ties by the sequence, each with its first entities. Only ``most_entities`` of an archetype are ever held."""
    seqs = panel.sequences(states)
    n = F.size("seq")
    moves = F.when(n > 1, F.size(F.filter(F.zip_with(F.slice("seq", 1, n - 1), F.slice("seq", 2, n - 1), lambda a, b: a != b), lambda x: x))).otherwise(0)
    rows = seqs.select("entity", F.array_join(F.col("seq").cast("array<string>"), ">").alias("sequence"), moves.alias("transitions"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    kinds = rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_entities"), F.first("transitions").alias("transitions")).orderBy(F.desc("n_entities"), "sequence").limit(most)
    first = rows.join(F.broadcast(kinds.select("sequence")), "sequence")  # ``most`` rows
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("sequence").orderBy("entity"))).where(F.col("nth") <= most_entities)
    first = first.groupBy("sequence").agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    out = kinds.join(first, "sequence").crossJoin(F.broadcast(total))  # one row
    return out.select("sequence", "n_entities", F.round(F.col("n_entities") / F.col("total"), 4).alias("fraction"), "transitions", "entities", (F.col("n_entities") - F.size("entities")).alias("entities_omitted"))


def cross_time_neighbours(edges: DataFrame, obs: DataFrame, threshold: float = 0.0, most: int = 10, direction: str = "any", obs_ids: list[int] | None = None) -> DataFrame:
    """(obs_id, rank, neighbour, entity, t, delta_t, weight, degree): for each observation, or those named, the heaviest
    neighbours at other times, ties by id; degree counts them all."""
    keep = {"any": F.lit(True), "forward": F.col("delta_t") > 0, "backward": F.col("delta_t") < 0}
    if direction not in keep:
        raise ValueError(f"unknown direction '{direction}'")
    rows = panel.cross_time(edges, obs, threshold)
    one = rows.select(F.col("i").alias("obs_id"), F.col("j").alias("neighbour"), F.col("entity_j").alias("entity"), F.col("t_j").alias("t"), (F.col("t_j") - F.col("t_i")).alias("delta_t"), F.col("w").alias("weight"))
    other = rows.select(F.col("j").alias("obs_id"), F.col("i").alias("neighbour"), F.col("entity_i").alias("entity"), F.col("t_i").alias("t"), (F.col("t_i") - F.col("t_j")).alias("delta_t"), F.col("w").alias("weight"))
    both = one.unionByName(other).where(keep[direction])
    if obs_ids is not None:
        both = both.where(F.col("obs_id").isin(obs_ids))
    degree = both.groupBy("obs_id").agg(F.count(F.lit(1)).alias("degree"))
    rank = F.row_number().over(Window.partitionBy("obs_id").orderBy(F.desc("weight"), "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).join(degree, "obs_id").select("obs_id", "rank", "neighbour", "entity", "t", "delta_t", "weight", "degree")


# Graphs over time ----------------------------------------------------------------------------------------------------


def temporal_diagnosis(tedges: DataFrame, steps: int, entities: DataFrame, n: int, components: bool = True) -> list[dict]:
    """One row an aggregation, each cut at its own ninth decile of magnitudes over all pairs, which differ in range:
    quantiles, the cut, edges at or above it (all edges where it is zero), components there, and for the trend the pairs
    that come together and that part."""
    rows = []
    for name, of in panel.AGGREGATIONS.items():
        w = of(tedges, steps).where("w != 0").select("i", "j", "w", F.abs("w").alias("m"))
        size = w.select("i", "j", F.col("m").alias("w"))
        shares = (0.25, 0.5, 0.95, CUT_SHARE)
        q = diagnostics.weight_percentiles(size, n, shares)
        cut = q[f"p{round(100 * CUT_SHARE)}"]
        kept = size.where(F.col("w") >= cut) if cut > 0 else size
        row = w.agg(F.max("m").alias("top"), F.count_if(F.col("w") >= cut).alias("up"), F.count_if(F.col("w") <= -cut).alias("down"), F.count_if(F.col("m") >= cut).alias("kept")).first()
        out = {"aggregation": name, "count": n * (n - 1) // 2, **{k: round(q[k], 6) for k in ("p25", "p50", "p95")}, "max": round(row["top"] or 0.0, 6), "self_scaled_cut": round(cut, 6), "edges_at_cut": row["kept"]}
        if components:
            labels = stability.component_labels(entities, kept.withColumn("w", F.lit(1.0)), 0.0)
            out["components_at_cut"] = labels.agg(F.count_distinct("label")).first()[0]
        trend = name == "trend" and cut > 0
        rows.append(out | {"converging_pairs": row["up"] if trend else 0, "diverging_pairs": row["down"] if trend else 0})
    return rows
