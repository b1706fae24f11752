"""Which thresholds are worth a look: the partition's shape at each, steady stretches, steps between partitions, options.

All partitions of a graph follow from its maximum spanning forest: edges are taken from the heaviest down, and whenever a
wanted threshold is passed the sizes are noted. A forest of up to ``stability.DRIVER_EDGES`` edges is walked once on the
driver, where only sizes are kept; beyond that each threshold is a labelling over DataFrames.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.operators import stability
from coverlace.session import checkpoint

#: Sizes that a partition's shape is read from; sizes shown for a plateau.
TOP, TOP_SHOWN, TOP_CANDIDATE = 10, 8, 5
#: A drop by this factor between neighbouring sizes starts the dust; components up to this share of the nodes are small.
CLIFF, SMALL = 3.0, 0.01


@dataclass
class Sizes:
    """A partition of ``n`` nodes: how many components have each size. There are at most sqrt(2 n) different sizes."""

    n: int
    counts: dict[int, int]

    @property
    def components(self) -> int:
        return sum(self.counts.values())

    @property
    def singletons(self) -> int:
        return self.counts.get(1, 0)

    def small(self) -> tuple[int, int]:
        """Count and mass of the small components."""
        own = [(s, k) for s, k in self.counts.items() if s <= small_limit(self.n)]
        return sum(k for _, k in own), sum(s * k for s, k in own)

    def top(self, most: int) -> list[int]:
        """The greatest sizes, descending."""
        out: list[int] = []
        for s in sorted(self.counts, reverse=True):
            out += [s] * min(self.counts[s], most - len(out))
            if len(out) == most:
                break
        return out


@dataclass
class Merge:
    """What comes together in the largest merge of a step: all of it, what joins the largest part, and the second part."""

    mass: int
    absorbed: int
    second: int


def small_limit(n: int) -> int:
    return max(1, int(n * SMALL))


class Partitions:
    """The partitions of ``n`` nodes by the edges above each threshold, from the graph's maximum spanning forest."""

    def __init__(self, nodes: DataFrame, forest: DataFrame, n: int):
        self.nodes, self.forest, self.n = nodes, forest, n
        self.known: dict[float, Sizes] = {}
        self.edges = None
        if forest.limit(stability.DRIVER_EDGES + 1).count() <= stability.DRIVER_EDGES:
            t = forest.select("i", "j", "w").toPandas()  # bounded by the line above
            order = np.argsort(-t["w"].to_numpy(), kind="stable")
            self.edges = [t[c].to_numpy()[order].tolist() for c in ("i", "j", "w")]

    def sizes(self, *thresholds: float) -> list[Sizes]:
        if new := sorted(set(thresholds) - self.known.keys(), reverse=True):
            self.known |= dict(zip(new, self._walk(new)[0] if self.edges else map(self._counted, new)))
        return [self.known[t] for t in thresholds]

    def merges(self, steps: list[tuple[float, float]]) -> list[Merge | None]:
        """The largest merge between each pair of a threshold and a lower one; no other pair may lie between them."""
        if not self.edges:
            return [self._merged(high, low) for high, low in steps]
        ends = sorted({t for pair in steps for t in pair}, reverse=True)
        found = dict(zip(ends, self._walk(ends)[1]))
        return [found[low] for _, low in steps]

    def _walk(self, thresholds: list[float]) -> tuple[list[Sizes], list[Merge | None]]:
        parent: dict[int, int] = {}
        size: dict[int, int] = {}
        count = Counter({1: self.n})
        parts: dict[int, list[int]] = {}  # since the last threshold: the sizes that came together in a root
        out, merges, at = [], [], 0
        a, b, w = self.edges

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for t in thresholds:
            parts.clear()
            while at < len(w) and w[at] > t:
                x, y = find(a[at]), find(b[at])
                at += 1
                if x == y:
                    continue
                p, q = size.get(x, 1), size.get(y, 1)
                if p < q:
                    x, y, p, q = y, x, q, p
                one, other = parts.pop(x, [p]), parts.pop(y, [q])
                one, other = (one, other) if len(one) >= len(other) else (other, one)
                one.extend(other)
                parts[x], parent[y], size[x] = one, x, p + q
                count.subtract((p, q))
                count[p + q] += 1
            out.append(Sizes(self.n, dict(+count)))
            found = [Merge(sum(p), sum(p) - max(p), sorted(p)[-2]) for p in parts.values() if len(p) > 1]
            merges.append(max(found, key=lambda m: (m.absorbed, m.mass), default=None))
        return out, merges

    def _labels(self, threshold: float) -> DataFrame:
        return checkpoint(stability.component_labels(self.nodes, self.forest, threshold, forest=self.forest))

    def _counted(self, threshold: float) -> Sizes:
        rows = stability.component_sizes(self._labels(threshold)).groupBy("size").count().collect()
        return Sizes(self.n, {r["size"]: r["count"] for r in rows})

    def _merged(self, high: float, low: float) -> Merge | None:
        both = self._labels(high).withColumnRenamed("label", "before").join(self._labels(low), "node_id")
        parts = both.groupBy("label", "before").agg(F.count(F.lit(1)).alias("size"))
        nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("size"), "before"))
        own = parts.withColumn("nth", nth).groupBy("label").agg(F.sum("size").alias("mass"), (F.sum("size") - F.max("size")).alias("absorbed"), F.max(F.when(F.col("nth") == 2, F.col("size"))).alias("second"))
        row = own.where("second IS NOT NULL").orderBy(F.desc("absorbed"), F.desc("mass")).limit(1).collect()
        return Merge(row[0]["mass"], row[0]["absorbed"], row[0]["second"]) if row else None


# Shapes --------------------------------------------------------------------------------------------------------------


def modes(counts: dict[int, int]) -> dict[int, int]:
    """The sizes above the lowest cliff, descending, without singletons: what is no dust."""
    ordered = sorted(counts, reverse=True)
    cliffs = [k + 1 for k, (a, b) in enumerate(zip(ordered, ordered[1:])) if a >= CLIFF * b]
    return {s: counts[s] for s in ordered[: cliffs[-1] if cliffs else None] if s > 1}


def mass_of(counts: dict[int, int]) -> int:
    return sum(s * k for s, k in counts.items())


def entropy(counts: dict[int, int]) -> float:
    """Entropy of the shares, by the largest possible."""
    total, components = mass_of(counts), sum(counts.values())
    if components < 2:
        return 0.0
    return -sum(k * s / total * math.log(s / total) for s, k in counts.items()) / math.log(components)


def balance(sizes: list[int]) -> float:
    """One where the first two sizes are equal; 0 where there is one."""
    return 1 - (sizes[0] - sizes[1]) / (sizes[0] + sizes[1]) if len(sizes) > 1 else 0.0


def share(part: float, n: int) -> float:
    return round(part / n, 4) if n else 0.0


def mass(s: Sizes, top: int = TOP_SHOWN) -> dict:
    shown, (small, small_mass) = s.top(top), s.small()
    return {
        "n_nodes": s.n, "component_count": s.components, "top_component_sizes": shown, "top_component_sizes_omitted": s.components - len(shown), "largest_component_fraction": share(shown[0] if shown else 0, s.n),
        "singleton_count": s.singletons, "singleton_fraction": share(s.singletons, s.n), "small_component_count": small, "small_component_mass_fraction": share(small_mass, s.n),
    }


def shape(s: Sizes, top: int | None = TOP) -> dict:
    """How many components are no dust, how much they hold, and how even they are, from the ``top`` greatest (or all)."""
    counts = s.counts if top is None else dict(Counter(s.top(top)))
    real = modes(counts)
    held, first = mass_of(real), Sizes(s.n, real).top(2)
    return {
        "useful_component_size_floor": stability.useful_size(s.n), "nontrivial_component_count": sum(real.values()), "nontrivial_mass_fraction": share(held, s.n),
        "multi_component_coverage": share(held - first[0] if first else 0, s.n), "component_size_entropy": round(entropy(counts), 4), "top_two_balance": round(balance(first), 4),
    }


#: Fixed texts of a partition's hint, and when each holds; the first one that does is taken.
HINTS = [
    ("mostly connected graph", lambda p: p["component_count"] <= 1),
    ("mostly connected graph with a small tail", lambda p: p["largest_component_fraction"] >= 0.95),
    ("singleton-heavy fragmentation", lambda p: p["singleton_fraction"] >= 0.2),
    ("giant component with small-tail fragmentation", lambda p: (p["largest_component_fraction"] >= 0.8) & (p["small_component_mass_fraction"] >= 0.05)),
    ("stable nontrivial multi-component structure", lambda p: (p["largest_component_fraction"] <= 0.8) & (p["singleton_fraction"] <= 0.05)),
    ("mixed component-size structure", lambda p: True),
]


def second_ratio(s: Sizes) -> float:
    first = s.top(2)
    return round(first[1] / first[0], 4) if len(first) > 1 else 0.0


def hint(profile: dict) -> str:
    return next(text for text, holds in HINTS if holds(profile))


def morphology(parts: Partitions, *thresholds: float) -> list[dict]:
    """One row a threshold: the partition's masses, its shape and its hint."""
    rows = []
    for t, s in zip(thresholds, parts.sizes(*thresholds)):
        m, f = mass(s, TOP), shape(s, TOP)
        rows.append({
            "threshold": t, "component_count": s.components, "top_component_sizes": m["top_component_sizes"], "top_component_sizes_omitted": m["top_component_sizes_omitted"], "giant_fraction": m["largest_component_fraction"],
            "second_largest_ratio": second_ratio(s), "singleton_count": s.singletons, "singleton_fraction": m["singleton_fraction"], "small_component_mass_fraction": m["small_component_mass_fraction"],
            **{k: f[k] for k in ("nontrivial_component_count", "nontrivial_mass_fraction", "multi_component_coverage", "component_size_entropy")}, "interpretation_hint": hint(m),
        })
    return rows


# Candidates ----------------------------------------------------------------------------------------------------------

POLICIES = ("balanced", "report_ready", "detail_seeking", "outlier_mining")
#: Fixed tiers of a steady stretch and of a step, and when each holds (singletons s, largest g, modes k, their mass m, what
#: the lesser ones cover c, balance b); the first one that does is taken.
PLATEAU_TIERS = [
    ("outlier_frontier", lambda x: x["s"] >= 0.35),
    ("giant_component_with_dust", lambda x: x["g"] >= 0.95),
    ("report_ready", lambda x: x["k"] >= 2 and x["s"] <= 0.05 and x["m"] >= 0.8),
    ("balanced", lambda x: x["k"] >= 2 and x["s"] <= 0.2 and x["m"] >= 0.55),
    ("exploratory", lambda x: x["k"] >= 2),
    ("weak_candidate", lambda x: True),
]
STEP_TIERS = [
    ("outlier_frontier", lambda x: x["s"] >= 0.35),
    ("exploratory", lambda x: x["k"] >= 2 and x["c"] >= 0.2 and x["b"] >= 0.35),
    ("detail_lens", lambda x: x["k"] >= 2 and x["c"] >= 0.05),
    ("weak_candidate", lambda x: True),
]
#: Fixed weights: persistence p, balance b, mass m, entropy e, singletons s, small mass d, cover c, absorbed mass a.
PLATEAU_WEIGHTS = {
    "report_ready": {"p": 0.35, "b": 0.25, "m": 0.3, "e": 0.1, "s": -0.55, "d": -0.25},
    "detail_seeking": {"p": 0.25, "b": 0.3, "m": 0.25, "e": 0.2, "s": -0.2, "d": -0.1},
    "outlier_mining": {"p": 0.15, "b": 0.1, "m": 0.2, "e": 0.35, "s": 0.2, "d": -0.05},
    "balanced": {"p": 0.3, "b": 0.25, "m": 0.3, "e": 0.15, "s": -0.35, "d": -0.15},
}
_STEADY = {"c": 0.35, "b": 0.25, "a": 0.25, "e": 0.15, "s": -0.35}
STEP_WEIGHTS = {"outlier_mining": {"e": 0.3, "a": 0.25, "c": 0.25, "s": 0.2, "d": -0.05}, "detail_seeking": {"c": 0.3, "b": 0.25, "a": 0.25, "e": 0.2, "s": -0.12}, "report_ready": _STEADY, "balanced": _STEADY}
#: What a tier is good for, and what not.
USES = {
    "report_ready": (["balanced", "report_ready"], ["outlier_mining"]),
    "balanced": (["balanced", "detail_seeking"], []),
    "exploratory": (["detail_seeking"], ["report_ready"]),
    "detail_lens": (["detail_seeking"], ["report_ready"]),
    "outlier_frontier": (["outlier_mining"], ["report_ready"]),
    "giant_component_with_dust": (["detail_seeking"], ["report_ready"]),
    "weak_candidate": (["detail_seeking"], ["report_ready"]),
}


def _figures(s: Sizes, **more: float) -> dict[str, float]:
    """A partition's figures under the letters of the tables above."""
    m, f = mass(s, TOP_CANDIDATE), shape(s, TOP_CANDIDATE)
    return {"s": m["singleton_fraction"], "g": m["largest_component_fraction"], "d": m["small_component_mass_fraction"], "k": f["nontrivial_component_count"], "m": f["nontrivial_mass_fraction"], "c": f["multi_component_coverage"], "e": f["component_size_entropy"], "b": f["top_two_balance"], **more}


def _tier(rules: list, x: dict) -> str:
    return next(name for name, holds in rules if holds(x))


def _rank(weights: dict[str, float], x: dict) -> float:
    return round(max(sum(w * x[k] for k, w in weights.items()), 0.0), 4)


def active_range(curve: list[tuple[float, int]]) -> float:
    """From the least to the greatest threshold with more than one component and fewer than the most."""
    most = max((c for _, c in curve), default=0)
    inside = [t for t, c in curve if 1 < c < most]
    return max(inside) - min(inside) if inside else 0.0


def plateau_candidates(parts: Partitions, plateaus: list[dict], policy: str = "balanced", most: int = 3, active: float = 0.0) -> list[dict]:
    """Steady stretches (start, end, components, length, midpoint) by how well they serve a policy, the first ``most``."""
    _known(policy)
    rows = []
    for p, s in zip(plateaus, parts.sizes(*[p["midpoint"] for p in plateaus])):
        x = _figures(s, p=min(max(p["length"] / (0.25 * active if active > 1e-9 else 0.05), 0.0), 1.0))
        tier = _tier(PLATEAU_TIERS, x)
        good, bad = USES[tier]
        rows.append({
            "candidate_kind": "stable_plateau", "threshold": p["midpoint"], "plateau_start": p["start"], "plateau_end": p["end"], "persistence_width": round(p["length"], 4), "component_count": p["components"],
            "largest_component_fraction": x["g"], "singleton_fraction": x["s"], "interpretability_tier": tier, "rank": _rank(PLATEAU_WEIGHTS[policy], x), "mass_shape": shape(s, TOP_CANDIDATE), "best_for": good, "avoid_for": bad,
        })
    return sorted(rows, key=lambda r: -r["rank"])[:most]


def _known(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy '{policy}'")


def steps(curve: list[tuple[float, int]], most: int = 16) -> list[int]:
    """Places of ``curve`` (threshold descending, components) where the count changes; of more than ``most``, half by the
    change and half by the width."""
    found = [(k, abs(curve[k][1] - curve[k - 1][1]), abs(curve[k][0] - curve[k - 1][0])) for k in range(1, len(curve)) if curve[k][1] != curve[k - 1][1]]
    if len(found) > most:
        by_change = sorted(found, key=lambda x: (x[1], x[2]), reverse=True)[: most // 2]
        by_width = sorted(found, key=lambda x: (x[2], x[1]), reverse=True)[: most // 2]
        found = [*by_change, *by_width]
    return sorted({k for k, *_ in found})


def breakpoints(parts: Partitions, curve: list[tuple[float, int]], most: int = 5, tried: int = 16) -> list[dict]:
    """Steps between neighbouring partitions, those that bring large components together first, then by what joins; small
    absorptions only where there is nothing else."""
    n, places = parts.n, steps(curve, tried)
    rows = []
    for k, merge in zip(places, parts.merges([(curve[k - 1][0], curve[k][0]) for k in places])):
        if merge is None or not n:
            continue
        large = merge.absorbed / n >= 0.05 and merge.second / n >= 0.05
        event = "large_component_transition" if large else "small_component_absorption" if curve[k][1] < curve[k - 1][1] and merge.second / n < 0.01 else "mixed_component_transition"
        before, after = parts.sizes(curve[k - 1][0], curve[k][0])
        rows.append({
            "threshold": curve[k][0], "event": event, "component_count_before": curve[k - 1][1], "component_count_after": curve[k][1], "before_top_component_sizes": before.top(5), "after_top_component_sizes": after.top(5),
            "absorbed_mass_fraction": share(merge.absorbed, n), "resulting_component_fraction": share(merge.mass, n),
        })
    order = ("large_component_transition", "mixed_component_transition", "small_component_absorption")
    rows.sort(key=lambda r: (order.index(r["event"]), -r["absorbed_mass_fraction"]))
    return ([r for r in rows if r["event"] != order[-1]] or rows)[:most]


def transition_candidates(parts: Partitions, curve: list[tuple[float, int]], policy: str = "balanced", most: int = 3) -> list[dict]:
    """Thresholds beside a step, by how well they serve a policy."""
    _known(policy)
    rows = []
    for event in breakpoints(parts, curve, max(3 * most, 6), 32):
        if event["event"] == "small_component_absorption" and policy != "outlier_mining":
            continue
        (s,) = parts.sizes(event["threshold"])
        x = _figures(s, a=event["absorbed_mass_fraction"])
        tier = _tier(STEP_TIERS, x)
        good, bad = USES[tier]
        if policy == "outlier_mining":
            good = sorted({*good, policy})
        kept = ("threshold", "event", "component_count_before", "component_count_after", "absorbed_mass_fraction", "resulting_component_fraction")
        rows.append({
            "candidate_kind": "transition_adjacent", "side": "stricter_before_merge", **{k: event[k] for k in kept}, "component_count": event["component_count_after"], "top_component_sizes": s.top(TOP_CANDIDATE),
            "largest_component_fraction": x["g"], "singleton_fraction": x["s"], "interpretability_tier": tier, "rank": _rank(STEP_WEIGHTS[policy], x), "mass_shape": shape(s, TOP_CANDIDATE), "best_for": good, "avoid_for": bad,
        })
    return sorted(rows, key=lambda r: -r["rank"])[:most]


def _alike(a: dict, b: dict) -> bool:
    """Whether two candidates say the same: close thresholds, two giants, or one tier with like sizes and counts."""
    if abs(a["threshold"] - b["threshold"]) < 0.03:
        return True
    g, h = a["largest_component_fraction"], b["largest_component_fraction"]
    if min(g, h) >= 0.9:
        return True
    apart, most = abs(a["component_count"] - b["component_count"]), max(a["component_count"], b["component_count"], 1)
    return a["interpretability_tier"] == b["interpretability_tier"] and abs(g - h) < 0.05 and (apart <= 2 or apart / most < 0.15)


def distinct(candidates: list[dict]) -> list[dict]:
    """Candidates that say something that none before them says."""
    kept: list[dict] = []
    for c in candidates:
        if not any(_alike(c, k) for k in kept):
            kept.append(c)
    return kept


#: Per policy, how many steady stretches and steps are looked at, at most (None: as many as asked for).
CAPS = {"report_ready": (3, 1), "detail_seeking": (1, None), "outlier_mining": (1, None), "balanced": (2, 4)}
WEAK = ("giant_component_with_dust", "weak_candidate")


def options(parts: Partitions, plateaus: list[dict], curve: list[tuple[float, int]], policy: str = "balanced", most: int = 5) -> dict:
    """Thresholds to choose from under a policy, and both families that they come from."""
    _known(policy)
    stable_cap, step_cap = (most if c is None else min(c, most) for c in CAPS[policy])
    stable = distinct(plateau_candidates(parts, plateaus, policy, stable_cap, active_range(curve)))
    near = distinct(transition_candidates(parts, curve, policy, step_cap))
    fit = lambda rows: [r for r in rows if policy == "outlier_mining" or r["singleton_fraction"] < 0.95]
    useful = [r for r in fit(stable) if r["interpretability_tier"] not in WEAK]
    chosen, strategy = {
        "detail_seeking": (fit(near) + useful, "transition_adjacent"),
        "outlier_mining": (near + stable[:1], "transition_adjacent"),
        "report_ready": ([r for r in fit(stable) if r["interpretability_tier"] in ("report_ready", "balanced")], "stable_plateau"),
        "balanced": (useful or fit(near)[:2] or fit(stable)[:1], "stable_plateau" if useful else "transition_adjacent"),
    }[policy]
    first = stable[0]["interpretability_tier"] if stable else None
    readout = "none" if first is None else "giant" if first == WEAK[0] else "ready" if first in ("report_ready", "balanced") else "exploratory"
    return {
        "policy": policy, "selection_strategy": strategy, "readout": READOUTS[readout], "stable_plateau_candidates": stable, "transition_adjacent_candidates": near,
        "stable_plateau_candidates_omitted": max(len(plateaus) - len(stable), 0), "candidates": distinct(chosen)[:most],
    }


READOUTS = {
    "none": "No steady threshold was found: run a sweep first.",
    "giant": "The steadiest threshold leaves nearly all rows in one component: use the alternatives to look closer, do not name groups from it.",
    "ready": "Steady thresholds have several real components: name groups from them and check their features.",
    "exploratory": "Steady thresholds are for exploring: use them for details or outliers, not for final groups.",
}


# The curve -----------------------------------------------------------------------------------------------------------


def curve_points(curve: DataFrame) -> list[tuple[float, int]]:
    """(threshold, components) where the count changes, from the highest threshold down; at most one a bin."""
    return [(r["threshold"], r["components"]) for r in stability.change_points(curve).orderBy(F.desc("threshold")).collect()]


def curve_report(nodes: DataFrame, edges: DataFrame, n: int, current: float, policy: str = "balanced", detail: str = "summary", bins: int = stability.BINS) -> dict:
    """All that is said about the thresholds of a graph that was cut at ``current``: summary holds a few rows of each kind,
    full holds the curve and every candidate."""
    if detail not in ("summary", "full"):
        raise ValueError("detail is summary or full")
    full = detail == "full"
    forest = stability.spanning_forest(edges)
    curve = stability.component_curve(forest, n, bins)
    found = [r.asDict() for r in stability.plateaus(curve).limit(20 if full else 10).collect()]
    points, parts = curve_points(curve), Partitions(nodes, forest, n)
    best = stability.optimal_threshold(stability.plateaus(curve), n)
    events = breakpoints(parts, points)
    picked = options(parts, found, points, policy, 12 if full else 7)
    shown = points if full else [points[k] for k in sorted(set(np.linspace(0, len(points) - 1, num=min(10, len(points))).astype(int).tolist()))] if points else []
    candidates = picked["candidates"] if full else picked["candidates"][:3]
    forms = morphology(parts, current, best, *[t for t, _ in shown], *[c["threshold"] for c in candidates])
    out = {
        "detail": detail, "current_threshold": current, "longest_plateau_threshold": best, "matches_current_threshold": math.isclose(current, best, rel_tol=1e-5, abs_tol=1e-8), "current_morphology": forms[0], "longest_plateau_morphology": forms[1],
        "policy": policy, "selection_strategy": picked["selection_strategy"], "readout": picked["readout"], "threshold_candidates": [c | {"morphology": m} for c, m in zip(candidates, forms[2 + len(shown) :])], "threshold_candidates_omitted": len(picked["candidates"]) - len(candidates),
        "threshold_profiles": forms[2 : 2 + len(shown)], "threshold_profiles_omitted": len(points) - len(shown), "unthresholded_component_count": points[-1][1] if points else None,
        "structural_breakpoints": events if full else [e for e in events if e["event"] != "small_component_absorption"], "curve_point_count": len(points),
    }
    if full:
        profiles = [mass(s) for s in parts.sizes(*[p["midpoint"] for p in found[:10]])]
        out |= {"thresholds": [t for t, _ in points], "component_counts": [c for _, c in points], "plateaus": [p | {"mass": m, "hint": hint(m)} for p, m in zip(found, profiles)], "options": {k: v for k, v in picked.items() if k != "candidates"}}
    return out


# What a graph looks like ---------------------------------------------------------------------------------------------


def component_morphology(s: Sizes) -> dict:
    """The masses and shape of one partition, from all of its sizes, with what its dust holds."""
    real, m = modes(s.counts), mass(s, TOP)
    return {
        **{k: m[k] for k in ("component_count", "top_component_sizes", "top_component_sizes_omitted", "largest_component_fraction", "singleton_count", "singleton_fraction")}, **shape(s, None),
        "second_largest_ratio": second_ratio(s), "top_two_balance": round(balance(s.top(2)), 4), "tail_component_count": s.components - sum(real.values()), "tail_mass_fraction": share(mass_of(s.counts) - mass_of(real), s.n),
    }


#: Fixed codes of what may be seen in a graph (figures: edges, density, grid; form as above), each with when it is.
PATTERNS = [
    ("empty_graph", lambda g, f: g["n_edges"] == 0),
    ("multiple_nontrivial_components", lambda g, f: f["nontrivial_component_count"] >= 2),
    ("dominant_component", lambda g, f: f["largest_component_fraction"] >= 0.95),
    ("no_dominant_component", lambda g, f: f["largest_component_fraction"] < 0.95),
    ("singleton_residual_present", lambda g, f: f["singleton_fraction"] >= 0.25),
    ("low_singleton_residual", lambda g, f: f["singleton_fraction"] < 0.25),
    ("high_top_component_balance", lambda g, f: f["top_two_balance"] >= 0.7),
    ("dense_connectivity", lambda g, f: g["density"] > 0.8),
    ("adequate_grid_sample", lambda g, f: g["grid"] == "ok"),
    ("under_sampled", lambda g, f: g["grid"] == "under_sampled"),
    ("thin_grid", lambda g, f: g["grid"] == "thin_grid"),
]
#: Fixed codes of what may be wrong, with their severity.
RISKS = [
    ("empty_graph", "error", lambda g, f: g["n_edges"] == 0),
    ("dense_hairball", "warning", lambda g, f: g["density"] > 0.8 and g["n_edges"] > 0),
    ("singleton_heavy", "warning", lambda g, f: f["singleton_fraction"] > 0.8),
    ("dominant_component", "warning", lambda g, f: f["largest_component_fraction"] > 0.95),
    ("under_sampled", "warning", lambda g, f: g["grid"] == "under_sampled"),
    ("thin_grid", "warning", lambda g, f: g["grid"] == "thin_grid"),
]


def observed_patterns(figures: dict, form: dict) -> list[str]:
    return [code for code, holds in PATTERNS if holds(figures, form)]


def risk_factors(figures: dict, form: dict) -> list[dict]:
    return [{"code": code, "severity": severity} for code, severity, holds in RISKS if holds(figures, form)]
