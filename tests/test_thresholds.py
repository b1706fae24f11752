import random

import pytest

from coverlace.functions import text
from coverlace.operators import clustering, components, diagnostics, longitudinal, panel, stability, thresholds
from coverlace.operators.thresholds import Partitions, Sizes
from coverlace.plans import config, dossier
from coverlace.plans.config import SweepConfig
from coverlace.plans.sweep import Sweep


def graph_of(spark, edges, n):
    nodes = spark.range(n).select("id").withColumnRenamed("id", "node_id")
    return nodes, spark.createDataFrame(edges, "i long, j long, w double")


def groups(n, edges, above):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j, w in edges:
        if w > above:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def random_edges(seed, n, m):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(i, j, rng.randrange(1, 40) / 40) for i, j in sorted(pairs)]


@pytest.mark.parametrize("seed", range(2))
def test_partitions_equal_plain_ones(spark, monkeypatch, seed):
    n, edges = 60, random_edges(seed, 60, 90)
    nodes, table = graph_of(spark, edges, n)
    forest = stability.spanning_forest(table)
    walked = Partitions(nodes, forest, n)
    marks = [0.9, 0.6, 0.3, 0.0]
    steps = list(zip(marks, marks[1:]))

    def plain(high, low):
        before, after = groups(n, edges, high), groups(n, edges, low)
        best = None
        for root in set(after):
            parts = sorted((before.count(b) for b in {before[x] for x in range(n) if after[x] == root}), reverse=True)
            if len(parts) > 1:
                best = max(best or (0, 0, 0), (sum(parts) - parts[0], sum(parts), parts[1]))
        return best

    for t, s in zip(marks, walked.sizes(*marks)):
        own = groups(n, edges, t)
        assert sorted(s.top(n), reverse=True) == sorted((own.count(r) for r in set(own)), reverse=True)
        assert s.components == len(set(own))
    got = [m and (m.absorbed, m.mass) for m in walked.merges(steps)]
    assert got == [p and p[:2] for p in (plain(*x) for x in steps)]
    monkeypatch.setattr(stability, "DRIVER_EDGES", 3)
    spread = Partitions(nodes, forest, n)
    assert spread.edges is None
    assert [s.counts for s in spread.sizes(*marks)] == [s.counts for s in walked.sizes(*marks)]
    assert [m and (m.absorbed, m.mass) for m in spread.merges(steps)] == got


def test_shapes():
    assert thresholds.modes({50: 1, 40: 1, 4: 1, 2: 1, 1: 3}) == {50: 1, 40: 1}
    assert thresholds.modes({5: 1, 4: 1, 3: 1, 1: 2}) == {5: 1, 4: 1, 3: 1}
    assert thresholds.modes({1: 9}) == {} and thresholds.modes({}) == {}
    s = Sizes(100, {50: 1, 30: 1, 1: 20})
    m, f = thresholds.mass(s), thresholds.shape(s)
    assert (m["component_count"], m["singleton_fraction"], m["small_component_mass_fraction"], m["top_component_sizes_omitted"]) == (22, 0.2, 0.2, 14)
    assert (f["nontrivial_component_count"], f["nontrivial_mass_fraction"], f["multi_component_coverage"], f["top_two_balance"]) == (2, 0.8, 0.3, 0.75)
    assert thresholds.hint(m) == "singleton-heavy fragmentation"
    assert thresholds.hint(thresholds.mass(Sizes(100, {100: 1}))) == "mostly connected graph"
    assert thresholds.hint(thresholds.mass(Sizes(100, {50: 2}))) == "stable nontrivial multi-component structure"
    form = thresholds.component_morphology(s)
    assert (form["tail_component_count"], form["tail_mass_fraction"], form["second_largest_ratio"]) == (20, 0.2, 0.6)
    figures = {"n_edges": 9, "density": 0.9, "grid": "thin_grid"}
    assert thresholds.observed_patterns(figures, form) == ["multiple_nontrivial_components", "no_dominant_component", "low_singleton_residual", "high_top_component_balance", "dense_connectivity", "thin_grid"]
    assert [r["code"] for r in thresholds.risk_factors(figures, form)] == ["dense_hairball", "thin_grid"]
    assert thresholds.shape(Sizes(0, {}))["component_size_entropy"] == 0.0


def test_steps_are_chosen_by_change_and_width():
    curve = [(1 - k / 40, c) for k, c in enumerate([40, 39, 38, 20, 19, 19, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1])]
    assert thresholds.steps(curve, 100) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert {3, 6} <= set(thresholds.steps(curve, 4)) and len(thresholds.steps(curve, 4)) <= 4
    assert thresholds.active_range([(0.9, 5), (0.5, 3), (0.2, 2), (0.1, 1)]) == pytest.approx(0.3)
    assert thresholds.active_range([]) == 0.0


def blocks_graph(spark):
    # Two groups of 20 joined weakly, and five nodes alone.
    edges = [(i, j, 0.9) for g in (0, 20) for i in range(g, g + 20) for j in (i + 1,) if j < g + 20] + [(5, 25, 0.2)]
    return (*graph_of(spark, edges, 45), 45)


@pytest.mark.parametrize("policy", thresholds.POLICIES)
def test_options(spark, policy):
    nodes, edges, n = blocks_graph(spark)
    forest = stability.spanning_forest(edges)
    curve = stability.component_curve(forest, n)
    found = [r.asDict() for r in stability.plateaus(curve).limit(10).collect()]
    got = thresholds.options(Partitions(nodes, forest, n), found, thresholds.curve_points(curve), policy)
    kept = got["candidates"]
    assert kept == thresholds.distinct(kept)
    stable = got["stable_plateau_candidates"][0]
    assert (stable["component_count"], stable["interpretability_tier"]) == (7, "balanced")
    if policy in ("balanced", "report_ready"):
        assert got["selection_strategy"] == "stable_plateau" and kept[0]["threshold"] == stable["threshold"]
    else:
        assert got["selection_strategy"] == "transition_adjacent" and any(c["candidate_kind"] == "transition_adjacent" for c in kept)
    with pytest.raises(ValueError):
        thresholds.options(Partitions(nodes, forest, n), found, [], "other")


def test_candidates_that_say_the_same_are_one():
    one = {"threshold": 0.5, "largest_component_fraction": 0.5, "component_count": 10, "interpretability_tier": "balanced"}
    assert len(thresholds.distinct([one, one | {"threshold": 0.52, "largest_component_fraction": 0.1}])) == 1
    assert len(thresholds.distinct([one, one | {"threshold": 0.7, "component_count": 12}])) == 1
    assert len(thresholds.distinct([one, one | {"threshold": 0.7, "component_count": 20}])) == 2
    assert len(thresholds.distinct([one | {"largest_component_fraction": 0.9}, one | {"threshold": 0.9, "largest_component_fraction": 0.99, "interpretability_tier": "x"}])) == 1


def test_curve_report(spark):
    nodes, edges, n = blocks_graph(spark)
    short, full = (thresholds.curve_report(nodes, edges, n, 0.5, detail=d) for d in ("summary", "full"))
    assert short["longest_plateau_threshold"] == full["longest_plateau_threshold"] == pytest.approx(0.5469, abs=0.01)
    assert short["current_morphology"]["component_count"] == 7 and short["unthresholded_component_count"] == 6
    assert full["threshold_profiles_omitted"] == 0 and len(full["thresholds"]) == full["curve_point_count"]
    assert [e["event"] for e in full["structural_breakpoints"]][0] == "large_component_transition"
    with pytest.raises(ValueError):
        thresholds.curve_report(nodes, edges, n, 0.5, detail="other")


def test_hubs_are_dealt_out(spark, monkeypatch):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 560)] + [(399, 500)]
    table = spark.createDataFrame(edges, "a long, b long")
    expected = {r.node: r.component for r in components.connected_components(table, "a", "b").collect()}
    assert set(expected.values()) == {0}
    monkeypatch.setattr(components, "HUB_EDGES", 16)
    assert {r.node: r.component for r in components.connected_components(table, "a", "b").collect()} == expected


def observations(spark):
    obs = [(e * 3 + t, f"e{e}", t) for e in range(4) for t in range(3)]
    # e0 and e1 stay together, e2 joins them at the end, e3 stays alone.
    edges = [(0, 1, 0.8), (1, 2, 0.8), (0, 3, 0.9), (3, 4, 0.8), (4, 5, 0.8), (5, 8, 0.6), (6, 7, 0.9), (9, 10, 0.9), (10, 11, 0.9)]
    return spark.createDataFrame(obs, "obs_id long, entity string, t int"), spark.createDataFrame(edges, "i long, j long, w double")


def test_trajectories(spark):
    obs, edges = observations(spark)
    ladder = {r.threshold: r for r in longitudinal.threshold_ladder(obs, edges, (0.0, 0.7)).collect()}
    assert (ladder[0.0].observation_clusters, ladder[0.0].distinct_trajectories, ladder[0.0].largest_trajectory_group) == (3, 3, 2)
    assert (ladder[0.7].observation_clusters, ladder[0.7].distinct_trajectories) == (4, 3)
    row = longitudinal.trajectory_diagnosis(obs, edges, spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 1, 1)], "map_id int, ball_id long, obs_id long")).first()
    assert (row.n_observations, row.n_entities, row.n_times, row.n_edges, row.cross_time_edges, row.n_balls, row.memberships_max) == (12, 4, 3, 9, 7, 2, 2.0)
    near = longitudinal.cross_time_neighbours(edges, obs, 0.0, 1, "forward").collect()
    assert {(r.obs_id, r.neighbour, r.delta_t, r.degree) for r in near} == {(0, 1, 1, 1), (1, 2, 1, 1), (3, 4, 1, 1), (4, 5, 1, 1), (6, 7, 1, 1), (9, 10, 1, 1), (10, 11, 1, 1)}
    assert [r.neighbour for r in longitudinal.cross_time_neighbours(edges, obs, 0.0, 5, obs_ids=[1]).orderBy("rank").collect()] == [0, 2]
    with pytest.raises(ValueError):
        longitudinal.cross_time_neighbours(edges, obs, direction="sideways")


def test_archetypes(spark):
    states = spark.createDataFrame([(e, t, s) for e, seq in (("a", "xyx"), ("b", "xyx"), ("c", "xx"), ("d", "z")) for t, s in enumerate(seq)], "entity string, t int, state string")
    got = longitudinal.archetype_report(states, 2, 1).collect()
    got = sorted(got, key=lambda r: -r.n_entities)
    assert [(r.sequence, r.n_entities, r.fraction, r.transitions, r.entities, r.entities_omitted) for r in got] == [("x>y>x", 2, 0.5, 2, ["a"], 1), ("x>x", 1, 0.25, 0, ["c"], 0)]


def test_temporal_diagnosis(spark):
    tedges = spark.createDataFrame([(0, 0, 1, 0.2), (1, 0, 1, 0.8), (0, 1, 2, 0.9), (1, 1, 2, 0.1), (0, 2, 3, 0.5), (1, 2, 3, 0.5)], "t long, i long, j long, w double")
    rows = {r["aggregation"]: r for r in longitudinal.temporal_diagnosis(tedges, 2, spark.range(4).withColumnRenamed("id", "node_id"), 4)}
    assert set(rows) == set(panel.AGGREGATIONS) and all(r["count"] == 6 for r in rows.values())
    assert (rows["mean"]["max"], rows["mean"]["edges_at_cut"], rows["mean"]["components_at_cut"]) == (0.5, 3, 1)
    assert rows["persistence"]["self_scaled_cut"] == 1.0 and rows["persistence"]["edges_at_cut"] == 3
    assert rows["trend"]["self_scaled_cut"] == pytest.approx(0.7) and (rows["trend"]["converging_pairs"], rows["trend"]["diverging_pairs"], rows["trend"]["components_at_cut"]) == (0, 1, 3)


def test_before_a_longitudinal_run():
    c = SweepConfig(dimensions=[2, 5, 9], epsilons=[5.0, 6.0])
    got, notes = longitudinal.adapted_config(c, 5, 0.5, 1.5)
    assert (got.dimensions, got.epsilons, notes["dimensions_dropped"], c.dimensions) == ([2, 5], [0.5, 1.5], [9], [2, 5, 9])
    assert longitudinal.adapted_config(SweepConfig(epsilons=[1.0, 9.0]), 5, 0.5, 1.5)[0].epsilons == [1.0, 9.0]
    assert longitudinal.adapted_config(SweepConfig(dimensions=[9]), 3, 0.5, 1.5)[0].dimensions == [3]
    report = {"rows": 20, "entities": 10, "times": 2, "dropped": 0}
    assert longitudinal.costs(report, c)["estimated_ball_maps_temporal"] == 12 and longitudinal.costs(report, c)["temporal_peak_bytes"] == 4800
    longitudinal.guard_representation(report, "both")
    for bad, kind, code, limit in ((report, "other", "INVALID_REPRESENTATION", 1 << 30), (report | {"rows": 19}, "temporal", "RAGGED_PANEL_NOT_SUPPORTED", 1 << 30), (report, "both", "TENSOR_TOO_LARGE", 100)):
        with pytest.raises(panel.PanelError) as e:
            longitudinal.guard_representation(bad, kind, limit)
        assert e.value.code == code
    with pytest.raises(panel.PanelError):
        longitudinal.adapted_config(c, 1, 0.5, 1.5)


def test_dossier(spark):
    rng = random.Random(3)
    rows = [(k, float(k // 20) * 5 + rng.random(), rng.random(), "u" if k < 20 else "v") for k in range(40)]
    table = spark.createDataFrame(rows, "node_id long, a double, b double, c string")
    edges = spark.createDataFrame([(g, j, 0.9) for g in (0, 20) for j in range(g + 1, g + 20)] + [(3, 23, 0.1)], "i long, j long, w double")
    labels = spark.createDataFrame([(k, k // 20) for k in range(40)], "node_id long, label long")
    got = {r.label: r for r in dossier.dossier(table, ["a", "b"], ["c"], labels.select("node_id"), edges, labels, "full").collect()}
    assert got[0].size == 20 and got[0].share == 0.5 and got[0].neighbours[0].neighbour == 1
    assert got[0].central[0].node_id == 0 and got[1].central[0].node_id == 20 and len(got[0].central) == 3
    assert got[0].numeric[0].col == "a" and got[0].numeric[0].direction == "down"
    assert got[1].categorical[0].value == "v"
    with pytest.raises(ValueError):
        dossier.dossier(table, ["a"], [], labels.select("node_id"), edges, labels, "other")


def test_skeleton(spark):
    nodes, edges, n = blocks_graph(spark)
    labels = stability.component_labels(nodes, edges, 0.5)
    got = diagnostics.skeleton(nodes, edges, labels, 0.5, "full", max_nodes=10, max_edges=7)
    assert (got["node_count"], got["edge_count"], got["nodes_omitted"], got["edges_omitted"], got["component_count"]) == (45, 38, 35, 31, 7)
    assert got["component_sizes_summary"] == text.sizes_in_short([20, 20, 1, 1, 1, 1, 1])
    assert 5 in diagnostics.skeleton(nodes, edges, labels, 0.5, "nodes")["topological_summary"]["articulation_points"]
    assert "nodes" not in diagnostics.skeleton(nodes, edges, labels, 0.5)


def test_layout_and_sparsifier_bounds(spark, monkeypatch):
    nodes, edges, _ = blocks_graph(spark)
    ids = list(range(40))
    v = {r.node_id: r.v for r in clustering.spectral_layout(ids, edges).collect()}
    assert len({v[k][0] > 0 for k in range(20)}) == 1 and all((v[k][0] > 0) != (v[0][0] > 0) for k in range(20, 40))
    assert max(abs(x) for p in v.values() for x in p) == pytest.approx(1)
    monkeypatch.setattr(clustering, "DENSE_NODES", 10)
    with pytest.raises(clustering.NoCut):
        clustering.spectral_sparsify(ids, edges, 1.0)


def test_short_forms():
    assert text.bounded(range(25), 3) == {"total": 25, "preview": [0, 1, 2], "omitted": 22}
    assert text.sizes_in_short([1, 30, 4, 1])["size_buckets"] == {"1": 2, "2-5": 1, "6-20": 0, ">20": 1}
    assert text.sparkline([0, 1, 4, 8]) == "  ▄█" and text.sparkline([]) == "" and text.sparkline([0, 0]) == "  "
    assert text.bar(0.5, 1.0, 4) == "██░░" and text.bar(3, 0, 2) == "░░" and text.bar(9, 3, 3) == "███"


def test_first_grid():
    assert [config.initial_dimensions(n) for n in (1, 4, 5, 12, 13, 100)] == [[2], [4], [5], [5], [11], [19]]
    assert config.initial_dimensions(30, {2: 0.4, 3: 0.55, 5: 0.72, 10: 0.88, 15: 0.93, 20: 0.97}) == [3, 5, 10, 15]
    assert config.initial_dimensions(30, {2: 0.95}) == [2]
    assert config.initial_dimensions(30, {2: 0.6, 3: 0.8, 4: 0.95}) == [3, 4]
    assert config.initial_dimensions(30, {8: 0.95}) == [4, 6, 8]
    first = config.initial_config(5, None, {"p25": 1.0, "p75": 2.0})
    assert first["sweep"]["projection"]["method"] == "jl" and first["sweep"]["ball_mapper"]["epsilon"]["range"] == {"min": 0.75, "max": 2.7, "steps": 24}
    zero = config.initial_config(5, None, {"p25": 0.0, "p75": 0.0, "mean": 2.0})
    assert zero["sweep"]["ball_mapper"]["epsilon"]["range"]["min"] == 1.6 and config.validate(zero) == []
    keys = config.parse({"cosmic_graph": {"sparsify_sketch_dim": 7, "sparsify_sample_count": 9, "sparsify_pcg_tol": 0.1, "sparsify_max_iter": 3}})
    assert (keys.sparsify_sketch_dim, keys.sparsify_sample_count, keys.sparsify_pcg_tol, keys.sparsify_max_iter) == (7, 9, 0.1, 3)
    assert config.validate({"cosmic_graph": {"neighborhood": "edge"}})


def test_embeddings_are_taken_over(spark):
    rng = random.Random(1)
    table = spark.createDataFrame([(k, rng.random() + 3 * (k % 3), rng.random()) for k in range(60)], "node_id long, a double, b double")
    plan = {"sweep": {"projection": {"dimensions": [2], "seed": [1]}, "ball_mapper": {"epsilon": [0.5]}}, "cosmic_graph": {"construction": "exact"}}
    first = Sweep(plan).fit(table)
    wider = Sweep(plan | {"sweep": plan["sweep"] | {"ball_mapper": {"epsilon": [0.7]}}}).fit(table, previous=first)
    assert wider.embeddings is first.embeddings
    other = Sweep(plan).fit(table.withColumn("a", table.a * 2), previous=first)
    assert other.embeddings is not first.embeddings
    assert len(first.clean_embedding_at_center()) == 2
    assert first.threshold_report()["current_morphology"]["component_count"] == first.components().select("label").distinct().count()
