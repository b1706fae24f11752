"""Operators against plain versions and known values, and their error messages."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlace.functions import special
from coverlace.operators import clustering, cover, diagnostics, graph, panel, preprocess, profile, project, stability, stats
from coverlace.operators.components import connected_components
from coverlace.operators.preprocess import Impute, OneHot, Preprocessing
from coverlace.plans import config
from coverlace.plans.sweep import Sweep
from coverlace.sources import tables


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, w double")


def nodes_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "node_id")


TWO_PAIRS = [(0, 1, 0.9), (2, 3, 0.8), (1, 2, 0.1)]


def test_two_pair_graph_counts(spark):
    curve = {r.bin: r.components for r in stability.component_curve(stability.spanning_forest(edges_of(spark, TWO_PAIRS)), 4).collect()}
    assert [curve[b] for b in (255, 225, 200, 100, 10)] == [4, 3, 2, 2, 1]
    tau = stability.optimal_threshold(stability.plateaus(stability.component_curve(stability.spanning_forest(edges_of(spark, TWO_PAIRS)), 4)), 4)
    assert 0.1 < tau < 0.8


def test_forest_by_rounds_equals_driver(spark):
    rng = random.Random(1)
    rows = [(i, j, rng.randrange(1, 20) / 20) for i, j in itertools.combinations(range(25), 2) if rng.random() < 0.2]
    e = edges_of(spark, rows).repartition(3)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(stability._boruvka(e)) == key(stability.spanning_forest(e))


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(31)) and got[41] == 40 and 50 not in got


@pytest.mark.parametrize("eps", [0.3, 0.8, 10.0])
def test_cover_in_rounds_equals_scan(spark, monkeypatch, eps):
    x = np.random.default_rng(0).standard_normal((60, 2))
    monkeypatch.setattr(cover, "ROUND_POINTS", 7)
    monkeypatch.setattr(cover, "ID_RANGES", 60)
    maps = spark.createDataFrame([(0, eps, i, v.tolist()) for i, v in enumerate(x)], "map_id int, eps double, node_id long, v array<double>").repartition(3)
    balls = cover.centres(maps)
    expected = cover.greedy(x, eps).tolist()
    assert [r.center_id for r in balls.orderBy("ball_id").collect()] == expected
    members = sorted((r.ball_id, r.node_id) for r in cover.membership(maps, balls).collect())
    assert members == sorted((b, int(i)) for b, c in enumerate(expected) for i in np.flatnonzero(cover.squared_distances(x, x[[c]])[:, 0] <= eps * eps))
    assert members == sorted((r.ball_id, r.node_id) for r in cover.membership_by_cells(maps, balls).collect())


def test_minhash_estimates_the_overlap(spark):
    rng = random.Random(5)
    balls = [(str(b), n) for n in range(30) for b in {rng.randrange(40) + 40 * (n // 15) for _ in range(25)}]
    df = spark.createDataFrame(balls, "ball string, node_id long")
    exact = {(r.i, r.j): r.w for r in graph.exact_graph(df).collect()}
    found = {(r.i, r.j): r.w for r in graph.minhash_graph(df, 256).collect()}
    strong = [k for k, w in exact.items() if w >= 0.3]
    assert sum(k in found for k in strong) >= 0.98 * len(strong)
    errors = [abs(found[k] - exact[k]) for k in strong if k in found]
    assert np.mean(errors) < 0.04 and max(errors) < 0.15
    acc = graph.SignatureAccumulator(64)
    acc.add(df.where("node_id % 2 = 0"))
    acc.add(df.where("node_id % 2 = 1"))
    assert sorted(map(tuple, acc.sigs.collect())) == sorted(map(tuple, graph.signatures(df, 64).collect()))
    assert graph.choose_bands(256) == (2, 128)
    with pytest.raises(ValueError):
        graph.signatures(df, 0)


def test_minhash_keeps_all_pairs_of_large_buckets(spark):
    # 300 nodes of one set of balls, 300 of different sets that share a ball whose hash is the least in some rows, and pairs.
    balls = [(f"same{b}", n) for n in range(300) for b in range(3)] + [(b, n) for n in range(300, 600) for b in ("shared", f"own{n}")]
    balls += [(f"pair{n // 2}", n) for n in range(600, 1200)]
    sigs = graph.signatures(spark.createDataFrame(balls, "ball string, node_id long"), 16)
    rows = {}
    for x in sigs.collect():
        rows.setdefault(x.node_id, {})[x.r] = x.h
    r, _ = graph.choose_bands(16)
    buckets = {}
    for n, h in rows.items():
        for band in range(16 // r):
            buckets.setdefault((band, *(h[k] for k in range(band * r, band * r + r))), []).append(n)
    expected = {(i, j) for b in buckets.values() for i in b for j in b if i < j}
    got = [tuple(x) for x in graph.candidates(sigs, 16).collect()]
    assert len(got) == len(expected) and set(got) == expected
    edges = {(x.i, x.j): x.w for x in graph.estimated_graph(sigs, 16).collect()}
    assert edges == {(i, j): w for i, j in expected if (w := sum(rows[i][k] == rows[j][k] for k in range(16)) / 16) > graph.FLOOR}


def test_preprocessing_messages(spark):
    df = spark.createDataFrame([(0, 1.0, "a", None, "1"), (1, float("nan"), None, None, "x"), (2, 3.0, "b", None, "y")], "node_id long, n double, s string, e double, t string")
    run = lambda **k: preprocess.preprocess(df, Preprocessing(**k))
    with pytest.raises(ValueError, match="is all-missing"):
        run(impute={"e": Impute("fill_mean")})
    with pytest.raises(ValueError, match="Column 't' is configured for numeric imputation"):
        run(drop=["e"], impute={"t": Impute("fill_mean")})
    with pytest.raises(ValueError, match="NaN values remain after imputation"):
        run(drop=["e", "s", "t"])
    with pytest.raises(ValueError, match="exceeding max_categories"):
        run(drop=["e"], encode={"t": OneHot(2)})
    with pytest.raises(TypeError, match="Non-numeric columns remain"):
        run(drop=["e", "s"], impute={"n": Impute("fill_mean")})
    out, layout = run(drop=["e", "t", "absent"], impute={"n": Impute("fill_mean"), "s": Impute("fill_mode")}, encode={"s": OneHot()})
    assert layout.features == ("n", "n_was_missing", "s_was_missing", "s_a", "s_b")
    assert [tuple(r) for r in out.orderBy("node_id").collect()] == [(0, 1.0, 0.0, 0.0, 1.0, 0.0), (1, 2.0, 1.0, 1.0, 1.0, 0.0), (2, 3.0, 0.0, 0.0, 0.0, 1.0)]
    for message, column in (("Column 'a' is all-missing", "a"), ("Non-numeric columns remain: {'b': 'string'}", "b")):
        assert column in profile.repair(message, {})["preprocessing"]["drop_columns"]


def test_draws_do_not_depend_on_partitions(spark):
    from coverlace.functions.hashing import gaussian

    one = [r[0] for r in spark.range(2000, numPartitions=1).select(gaussian(1, F.col("id"))).collect()]
    many = [r[0] for r in spark.range(2000, numPartitions=7).select(gaussian(1, F.col("id"))).collect()]
    assert one == many and abs(np.mean(one)) < 0.08 and abs(np.std(one) - 1) < 0.06


def test_special_functions_at_known_values():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert special.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-14)
    assert special.fisher_p(8, 2, 1, 5) == pytest.approx(0.03496503496503495, abs=1e-12)
    assert sum(special.u_counts(4, 5)) == math.comb(9, 4)
    assert special.mann_whitney_p(0, 3, 4, 0, False) == pytest.approx(2 / 35)


def test_natural_breaks_and_fdr(spark):
    assert stats.natural_breaks([1, 1.1, 5, 5.2, 9, 9.1]) == [0, 0, 1, 1, 2, 2]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.04, 0.03, None])], "k long, p double")
    assert [round(r.q, 6) for r in stats.fdr(rows, "p", "q").orderBy("k").collect()] == [0.04, 0.053333, 0.053333, 1.0]


def test_panel_errors(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0)], "e string, t int, x double")
    for change, code in ((dict(on_missing="no"), "INVALID_PIVOT_POLICY"), (dict(entity="q"), "PANEL_COLUMN_NOT_FOUND"), ({}, "PANEL_DUPLICATE_OBSERVATIONS")):
        with pytest.raises(panel.PanelError) as e:
            panel.pivot_panel(df, **({"entity": "e", "time": "t"} | change))
        assert e.value.code == code


def test_temporal_aggregations_count_absent_as_zero(spark):
    w = spark.createDataFrame([(0, 0, 1, 1.0), (2, 0, 1, 0.5)], "t int, i long, j long, w double")
    value = lambda name, **k: panel.aggregated(w, 3, name, -1, **k).first().w
    series = np.array([1.0, 0.0, 0.5])
    assert value("mean") == pytest.approx(series.mean()) and value("volatility") == pytest.approx(series.var())
    assert value("trend") == pytest.approx(np.polyfit(range(3), series, 1)[0]) and value("change_point") == 1.0
    assert value("persistence") == pytest.approx(2 / 3) and value("recency", decay=0.5) == pytest.approx((0.25 + 0.5) / 1.75)
    assert panel.dtw("abc", "abbc") == 0 and panel.dtw("abc", "xyz") == 3


def test_clusters(spark):
    rows = [(i, j, 0.9 if i // 5 == j // 5 else 0.1) for i, j in itertools.combinations(range(15), 2)]
    nodes, e = nodes_of(spark, 15), edges_of(spark, rows)
    for labels in (clustering.spectral_clusters(nodes, e, 6), clustering.agglomerative_clusters(nodes, e, 3), clustering.resolve_clusters(nodes, e, 15)):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.label, set()).add(r.node_id // 5)
        assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    with pytest.raises(ValueError):
        clustering.resolve_clusters(nodes, e, 15, "none")
    assert diagnostics.articulation_points(nodes_of(spark, 5), edges_of(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0), (3, 4, 1.0)])) == [2, 3]
    adjacency = stats.cluster_adjacency(e, nodes.select("node_id", F.floor(F.col("node_id") / 5).alias("label"))).collect()
    assert len(adjacency) == 6


def test_pca_and_projection(spark):
    x = np.random.default_rng(2).standard_normal((80, 4)) * [5, 2, 1, 0.1]
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, v array<double>")
    _, loadings, variance = project.pca(pts, 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variance, values[::-1][:3]) and np.allclose(np.abs(loadings), np.abs(vectors[:, ::-1][:, :3]))
    for bad in (0, 5):
        with pytest.raises(ValueError):
            project.pca(pts, bad)
    with pytest.raises(ValueError):
        project.projection_grid(pts, "tsne", [2], [1])


def test_configuration():
    c = config.parse({"sweep": {"projection": {"dimensions": {"values": [2, 3]}}, "ball_mapper": {"epsilon": {"range": {"min": 0.1, "max": 0.5, "steps": 5}}}}})
    assert c.dimensions == [2, 3] and c.epsilons == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5]) and c.method == "jl"
    assert config.validate({"cosmic_graph": {"threshold": 1}}) and config.validate({"x": 1}) and config.validate({"cosmic_graph": {"construction_threshold": 2}}) and not config.validate({})
    out, changes = config.apply_overrides({"run": {"name": "a"}}, {"run.name": "b"}, ["run.data"])
    assert out == {"run": {"name": "b"}} and changes == [{"path": "run.name", "before": "a", "after": "b"}]
    assert config.initial_dimensions(3, None) == [3] and config.initial_dimensions(20, {2: 0.4, 3: 0.55, 5: 0.72, 10: 0.91}) == [3, 5, 10]


def test_sweep_finds_three_groups(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node_id long, a double, b double")
    raw = {"sweep": {"projection": {"dimensions": [2], "seed": [1, 2]}, "ball_mapper": {"epsilon": [0.3, 0.5]}}, "cosmic_graph": {"construction": "exact"}}
    s = Sweep(raw).fit(df)
    sizes = sorted(r["size"] for r in stability.component_sizes(s.components()).collect())
    assert len(sizes) >= 3 and s.n == 120 and 0 < s.threshold < 1
    multi = Sweep(raw).fit_multi([df, df])
    assert {(r.i, r.j): round(r.w, 9) for r in multi.all_edges.collect()} == {(r.i, r.j): round(r.w, 9) for r in s.all_edges.collect()}


def test_uploads_and_records(tmp_path, spark):
    up = tables.Upload(str(tmp_path), "x.csv")
    up.append(b"\xef\xbb\xbfa,b\n1,NA\n")
    up.append("2,3\n")
    handle = up.finish()
    assert tables.handle_is_current(handle)
    rows = tables.read_table(spark, handle["path"]).collect()
    assert [(r.a, r.b) for r in rows] == [(1, None), (2, 3)]
    store = tables.RunStore(str(tmp_path / "runs"))
    store.save("run", "1", {"tau": 0.5})
    assert store.load("run", "1") == {"tau": 0.5} and store.load("run", "2") is None and store.keys("run") == ["1"]


def test_bundle(tmp_path, spark):
    nodes, e = nodes_of(spark, 4), edges_of(spark, TWO_PAIRS)
    labels = stability.component_labels(nodes, e, 0.5)
    m = tables.export_bundle(str(tmp_path), "My Run", nodes, nodes, tables.node_table(nodes, e, labels), e, tables.group_table(labels), 0.5, {"a": 1})
    assert m["counts"]["graph/edges"] == 2 and m["counts"]["graph/cosmic"] == 3 and m["counts"]["graph/groups"] == 2


def test_signature_stream(tmp_path, spark):
    from coverlace.streaming.signatures import SignatureStream

    balls = spark.createDataFrame([(str(k % 5), k) for k in range(40)], "ball string, node_id long")
    balls.repartition(3).write.parquet(str(tmp_path / "in"))
    s = SignatureStream(spark, str(tmp_path / "state"), 16)
    s.start(spark.readStream.schema(balls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, s.current().collect())) == sorted(map(tuple, graph.signatures(balls, 16).collect()))
