"""Graphs of sets of equal nodes against all pairs of nodes."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlace.operators import clustering, diagnostics, graph, stability, stats
from coverlace.sources import tables


def some_balls(spark, nodes=60, balls=6, seed=3):
    rng = random.Random(seed)
    own = {n: {f"b{b}" for b in range(balls) if rng.random() < 0.3} or {"b0"} for n in range(nodes)}
    return own, spark.createDataFrame([(b, n) for n, bs in own.items() for b in bs], "ball string, node_id long").repartition(3)


def all_pairs(own):
    return {(i, j): len(own[i] & own[j]) / len(own[i] | own[j]) for i, j in itertools.combinations(sorted(own), 2) if own[i] & own[j]}


@pytest.mark.parametrize("block", [1024, 3])
def test_exact_graph_of_sets_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    own, balls = some_balls(spark)
    expected, g = all_pairs(own), graph.ExactGraph(balls)
    rows = [tuple(r) for r in g.edges().collect()]
    assert len(rows) == len(expected) and {(i, j): w for i, j, w in rows} == pytest.approx(expected)
    assert {(i, j): c for i, j, c in map(tuple, g.edges(None, "c").collect())} == {(i, j): len(own[i] & own[j]) for i, j in expected}
    assert {(r.i, r.j) for r in g.edges(0.4).collect()} == {k for k, w in expected.items() if w > 0.4}
    weights = list(expected.values())
    assert {round(r.w, 9): r.k for r in g.weights().collect()} == {w: sum(round(x, 9) == w for x in weights) for w in {round(x, 9) for x in weights}}
    nodes = spark.range(62).withColumnRenamed("id", "node_id")
    e = spark.createDataFrame([(i, j, w) for (i, j), w in expected.items()], "i long, j long, w double")
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert key(tables.with_degrees(nodes, g.degrees())) == key(tables.node_degrees(nodes, e))
    for t in (0.0, 0.4, 0.7, 1.0):
        for by_size in (False, True):
            assert key(stability.set_labels(nodes, g, t, by_size)) == key(stability.component_labels(nodes, e, t, by_size))
    curve = lambda f: key(stability.component_curve(f, 62))
    assert curve(stability.set_forest(g)) == curve(stability.spanning_forest(e))
    assert diagnostics.counted_percentiles(g.weights(), 62) == pytest.approx(diagnostics.weight_percentiles(e, 62))
    labels = nodes.select("node_id", (F.col("node_id") % 5).alias("label"))
    assert key(stats.set_adjacency(g, labels)) == key(stats.cluster_adjacency(e, labels))


def test_links_do_not_grow_with_the_nodes(spark):
    # Four sets of balls: their links are as many for 20 nodes as for 4,000, which have eight million pairs.
    of = lambda n: graph.ExactGraph(spark.range(n).select(F.explode(F.array(F.concat(F.lit("a"), F.col("id") % 2), F.concat(F.lit("b"), F.col("id") % 4))).alias("ball"), F.col("id").alias("node_id")))
    few, many = of(20), of(4000)
    assert few.links.count() == many.links.count() == 6
    assert many.weights().agg(F.sum("k")).first()[0] == 4 * 1000 * 999 // 2 + 2 * 1000 * 1000


def equal_sets(spark, monkeypatch, copies=8, most=20):
    """A graph of 12 sets of up to ``copies`` nodes, with more nodes than are taken one by one, and its pairs of nodes."""
    rng = random.Random(4)
    kinds = [("x0", "x1"), ("x1",), ("x1", "x2"), ("x2", "x3"), ("x3",), ("x3", "x4"), ("y0", "y1"), ("y1",), ("y1", "y2"), ("y2", "x4"), ("x0",), ("y0",)]
    own = {n: set(kinds[n % 12]) for n in range(12 * copies) if n < 12 or rng.random() < 0.7}
    monkeypatch.setattr(clustering, "DENSE_NODES", most)
    balls = spark.createDataFrame([(b, n) for n, bs in own.items() for b in bs], "ball string, node_id long")
    expected = all_pairs(own)
    return sorted(own), expected, graph.ExactGraph(balls)


def matrix(ids, pairs):
    at, a = {v: k for k, v in enumerate(ids)}, np.eye(len(ids))
    for (i, j), w in pairs.items():
        a[at[i], at[j]] = a[at[j], at[i]] = w
    return a


def groups(labels):
    out = {}
    for node, label in labels:
        out.setdefault(label, set()).add(node)
    return {frozenset(x) for x in out.values()}


def test_pagerank_of_sets(spark, monkeypatch):
    ids, pairs, g = equal_sets(spark, monkeypatch)
    e = spark.createDataFrame([(i, j, w) for (i, j), w in pairs.items()], "i long, j long, w double")
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    labels = nodes.select("node_id", F.when(F.col("node_id") == 5, 9).otherwise(F.col("node_id") % 2).cast("long").alias("label"))
    key = lambda df: sorted((r.node_id, r.label, round(r.score, 9)) for r in df.collect())
    assert key(clustering.set_pagerank(g, labels, rounds=12)) == key(clustering.pagerank(nodes, e, labels, rounds=12))


def test_average_linkage_of_sets(spark, monkeypatch):
    ids, pairs, g = equal_sets(spark, monkeypatch)
    for k in (3, 5, len(ids) - 9):
        got = {r.node_id: r.label for r in clustering.set_agglomerative_clusters(g, k).collect()}
        assert [got[i] for i in ids] == clustering.linkage_labels(1 - matrix(ids, pairs), k).tolist()


def test_spectral_cut_of_sets(spark, monkeypatch):
    ids, pairs, g = equal_sets(spark, monkeypatch)
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id long")
    got = [(r.node_id, r.label) for r in clustering.set_spectral_clusters(nodes, g, 6).collect()]
    expected = clustering.best_spectral_cut(matrix(ids, pairs), 6)
    assert len(got) == len(ids) and groups(got) == groups(zip(ids, expected.tolist()))


def test_layout_of_sets(spark, monkeypatch):
    ids, pairs, g = equal_sets(spark, monkeypatch)
    a = matrix(ids, pairs) - np.eye(len(ids))
    laplacian = np.diag(a.sum(axis=1)) - a
    got = {r.node_id: r.v for r in clustering.set_layout(g, 5).collect()}
    v = np.array([got[i] for i in ids])
    values = np.linalg.eigvalsh(laplacian)[1:6]
    assert np.abs(v).max() == pytest.approx(1) and np.allclose(v.mean(axis=0), 0) and np.allclose(laplacian @ v, v * values, atol=1e-9)
    assert np.linalg.matrix_rank(v) == 5


def test_sparsifier_of_sets(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    ids, pairs, g = equal_sets(spark, monkeypatch)
    a = matrix(ids, pairs) - np.eye(len(ids))
    inverse = np.linalg.pinv(np.diag(a.sum(axis=1)) - a)
    at = {v: k for k, v in enumerate(ids)}
    share = {(i, j): w * (inverse[at[i], at[i]] + inverse[at[j], at[j]] - 2 * inverse[at[i], at[j]]) for (i, j), w in pairs.items()}
    total, q = sum(share.values()), 40_000
    sets = [(r["rep"], r["size"]) for r in g.sets.orderBy("rep").collect()]
    place, links = {r: k for k, (r, _) in enumerate(sets)}, [tuple(r) for r in g.pairs().orderBy("i", "j").collect()]
    i, j = (np.array([place[x[c]] for x in links]) for c in (0, 1))
    between, inside = clustering.set_resistances(np.array([x for _, x in sets]), i, j, np.array([x[2] for x in links]), 20_000, np.random.default_rng(0))
    assert between.tolist() == pytest.approx([share[a, b] / w for a, b, w in links], rel=0.06)
    own = {r: sorted(x.node_id for x in g.members.where(f"rep = {r}").collect()) for r, _ in sets}
    assert [inside[place[r]] for r in own if len(own[r]) > 1] == pytest.approx([share[x[0], x[1]] for x in own.values() if len(x) > 1])
    got = {(r.i, r.j): r.w for r in clustering.set_sparsify(g, 1.0, sketch_dim=2000, samples=q).collect()}
    assert set(got) <= set(pairs) and sum(got.values()) == pytest.approx(sum(pairs.values()), rel=0.1)
    assert all(abs(got.get(k, 0.0) - w) < 6 * w / (q * share[k] / total / 1.3) ** 0.5 for k, w in pairs.items())


def test_wasserstein_makes_no_row_per_value_and_cluster(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGES", 5)
    rng = random.Random(2)
    rows = [(n, c, float(rng.randrange(12)) if c == "t" else rng.gauss(0, 1)) for n in range(90) for c in ("t", "u")]
    values = spark.createDataFrame(rows, "node_id long, col string, x double").repartition(3)
    labels = spark.range(90).select(F.col("id").alias("node_id"), (F.col("id") % 7).alias("label"))
    monkeypatch.setattr(stats, "following", None)  # rows were made with it for every value and cluster
    got = {(r.label, r.col): r.w1 for r in stats.wasserstein(values, labels).collect()}
    for label, col in itertools.product(range(7), ("t", "u")):
        x = sorted({v for _, c, v in rows if c == col})
        mine, rest = ([v for n, c, v in rows if c == col and (n % 7 == label) == own] for own in (True, False))
        area = sum(abs(sum(v <= a for v in mine) / len(mine) - sum(v <= a for v in rest) / len(rest)) * (b - a) for a, b in zip(x, x[1:]))
        assert got[label, col] == pytest.approx(area)


def test_minhash_of_sets_equals_that_of_nodes(spark):
    own, balls = some_balls(spark)
    g = graph.CollapsedGraph.of(balls, 16)
    key = lambda df: sorted((r.i, r.j, r.w) for r in df.collect())
    assert key(g.edges()) == key(graph.estimated_graph(graph.signatures(balls, 16), 16))
    assert g.sets.count() <= len({frozenset(x) for x in own.values()})
