"""Statistics of clusters against the rest: numeric and categorical evidence, tests, and scores.

Numeric input is long, (node_id, col, x), without missing values; labels are (node_id, label). Running counts over a
column's values are taken in ranges of values, whose totals are added up, so no column needs one task for all its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from coverlace.functions import special
from coverlace.operators.graph import SetGraph
from coverlace.session import checkpoint

#: Ranges of values in which running counts of a column are taken.
RANGES = 64
EPS = 1e-9


def long_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """(node_id, col, x) of numeric columns; null and NaN are left out."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    return table.select("node_id", F.explode(parts).alias("p")).select("node_id", "p.col", "p.x").where("x is not null and not isnan(x)")


def _in_ranges(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with __range, the range of its group's values that its ``order`` value is in."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
    return rows.join(F.broadcast(cuts), by).withColumn("__range", F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < F.col(order)))).drop("__cuts")


def running(rows: DataFrame, by: list[str], order: str, what: str, name: str = "upto") -> DataFrame:
    """``rows`` with the sum of ``what`` over the rows of its group up to and including its own ``order`` value."""
    placed = _in_ranges(rows, by, order)
    totals = placed.groupBy(*by, "__range").agg(F.sum(what).alias("__sum"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.sum(what).over(Window.partitionBy(*by, "__range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__in", inside).join(F.broadcast(before), [*by, "__range"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before", "__range")


def following(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``rows``, whose ``order`` values differ within a group, with the next greater one of the group."""
    placed = _in_ranges(rows, by, order)
    firsts = placed.groupBy(*by, "__range").agg(F.min(order).alias("__first"))
    after = firsts.withColumn("__after", F.lead("__first").over(Window.partitionBy(*by).orderBy("__range"))).drop("__first")  # RANGES rows a group
    inside = F.lead(order).over(Window.partitionBy(*by, "__range").orderBy(order))
    return placed.withColumn("__in", inside).join(F.broadcast(after), [*by, "__range"]).withColumn(name, F.coalesce("__in", "__after")).drop("__in", "__after", "__range")


def value_counts(values: DataFrame) -> DataFrame:
    """(col, x, k, upto): how many rows have a value, and how many have it or less."""
    return running(values.groupBy("col", "x").agg(F.count(F.lit(1)).alias("k")), ["col"], "x", "k")


def average_ranks(values: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(node_id, col, x, rank): ranks from 1, ties averaged."""
    counts = value_counts(values) if counts is None else counts
    return values.join(counts, ["col", "x"]).select("node_id", "col", "x", (F.col("upto") - F.col("k") / 2 + 0.5).alias("rank"))


def tie_terms(counts: DataFrame) -> DataFrame:
    """(col, n, ties, correction): sum of t^3 - t over equal values, and 1 - ties / (n^3 - n)."""
    t = F.col("k").cast("double")
    sums = counts.groupBy("col").agg(F.sum("k").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    return sums.select("col", "n", "ties", F.when(n > 1, 1 - F.col("ties") / (n * n * n - n)).otherwise(1.0).alias("correction"))


def moments(values: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, std and var (sample; 0 for one value), median, mad per group."""
    first = values.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("var"), F.median("x").alias("median"))
    mad = values.join(first.select(*by, "median"), by).groupBy(*by).agg(F.median(F.abs(F.col("x") - F.col("median"))).alias("mad"))
    return first.join(mad, by)


def column_profile(values: DataFrame) -> DataFrame:
    """Per column: n, mean, std0, std1, median, mad, iqr."""
    base = moments(values, ["col"])
    more = values.groupBy("col").agg(F.stddev_pop("x").alias("std0"), F.percentile("x", [0.25, 0.75]).alias("q"))
    return base.join(more, "col").select("col", "n", "mean", "std0", F.col("std").alias("std1"), "var", "median", "mad", (F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("iqr"))


def cluster_moments(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, col, n, mean, std, var, median, mad) of the cluster, and the same of the rest with suffix _rest."""
    own = values.join(labels, "node_id")
    inside = moments(own, ["label", "col"])
    names = labels.select("label").distinct()
    # The rest of every cluster: each value once for each other label, as medians do not combine.
    rest = own.withColumnRenamed("label", "own").crossJoin(F.broadcast(names)).where("own != label")  # at most the clusters shown
    outside = moments(rest, ["label", "col"])
    for c in ("n", "mean", "std", "var", "median", "mad"):
        outside = outside.withColumnRenamed(c, f"{c}_rest")
    return inside.join(outside, ["label", "col"])


def pooled_std(n1: Column, s1: Column, n2: Column, s2: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    return F.when((n1 <= 1) | (n2 <= 1), F.greatest(s1, s2, F.lit(EPS))).otherwise(pooled)


def ks_statistics(values: DataFrame, labels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(label, col, ks): greatest gap between the cluster's and the rest's distribution functions.

    The gap to the rest is N / (N - n) of the gap to all rows, and that is widest at, or just before, a value of the
    cluster, so only the cluster's own values are looked at.
    """
    counts = value_counts(values) if counts is None else counts
    totals = values.groupBy("col").agg(F.count(F.lit(1)).alias("total"))
    own = values.join(labels, "node_id")
    sizes = own.groupBy("label", "col").agg(F.count(F.lit(1)).alias("n"))
    inside = running(own.groupBy("label", "col", "x").agg(F.count(F.lit(1)).alias("own_k")), ["label", "col"], "x", "own_k", "own_upto")
    at = inside.join(counts, ["col", "x"]).join(sizes, ["label", "col"]).join(F.broadcast(totals), "col")
    gap = lambda a, b: F.abs(a / F.col("n") - b / F.col("total"))
    widest = F.greatest(gap(F.col("own_upto"), F.col("upto")), gap(F.col("own_upto") - F.col("own_k"), F.col("upto") - F.col("k")))
    return at.groupBy("label", "col").agg(F.max(widest).alias("gap"), F.first("n").alias("n"), F.first("total").alias("total")).where("total > n").select("label", "col", (F.col("gap") * F.col("total") / (F.col("total") - F.col("n"))).alias("ks"))


def wasserstein(values: DataFrame, labels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(label, col, w1): area between the two distribution functions.

    A range of a column's values is walked once for all clusters, from what each has before it to the first value after it:
    there is a row per value and cluster that has it, and what grows with the clusters is a row per range.
    """
    own = values.join(labels, "node_id").groupBy("col", "x", "label").agg(F.count(F.lit(1)).alias("k"))
    placed = checkpoint(_in_ranges(own, ["col"], "x"))
    ranges = placed.groupBy("col", "__range").agg(F.min("x").alias("first"), F.sum("k").alias("all"))
    along = Window.partitionBy("col").orderBy("__range")  # RANGES rows a column
    ranges = ranges.select("col", "__range", F.lead("first").over(along).alias("after"), (F.sum("all").over(along) - F.col("all")).alias("before_all"))
    inside = placed.groupBy("col", "__range", "label").agg(F.sum("k").alias("k"))
    sizes = inside.groupBy("col", "label").agg(F.sum("k").alias("n"))
    sizes = sizes.join(sizes.groupBy("col").agg(F.sum("n").alias("total")), "col").where("total > n")
    known = ranges.join(sizes, "col").join(inside, ["col", "__range", "label"], "left")
    before = F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("col", "label").orderBy("__range")) - F.coalesce("k", F.lit(0))
    known = known.select(F.col("col").alias("of_col"), F.col("__range").alias("of_range"), F.col("label").alias("of_label"), "n", "total", "after", "before_all", before.alias("before"))
    kind = labels.schema["label"].dataType.simpleString()

    def walk(rows: pa.Table, told: pa.Table) -> pa.Table:
        x, k, label = rows["x"].to_numpy(), rows["k"].to_numpy().astype(float), rows["label"].to_numpy(zero_copy_only=False)
        order = np.argsort(x, kind="stable")
        x, k, label = x[order], k[order], label[order]
        last = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1) if len(x) else np.zeros(0, int)
        areas = []
        for of, n, total, after, before_all, before in zip(*(told[c].to_pylist() for c in ("of_label", "n", "total", "after", "before_all", "before"))):
            step = np.diff(x[last], append=x[-1] if after is None else after)
            a, c = before_all + np.cumsum(k)[last], before + np.cumsum(np.where(label == of, k, 0.0))[last]
            areas.append(float((np.abs(c / n - (a - c) / (total - n)) * step).sum()))
        return pa.table({"label": told["of_label"], "col": told["of_col"], "area": pa.array(areas, pa.float64())})

    out = placed.groupBy("col", "__range").cogroup(known.groupBy("of_col", "of_range")).applyInArrow(walk, f"label {kind}, col string, area double")
    return out.groupBy("label", "col").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("w1"))


def rank_sums(values: DataFrame, labels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(label, col, n, rank_sum, u): u is the cluster's Mann-Whitney count against the rest."""
    r = average_ranks(values, counts).join(labels, "node_id")
    s = r.groupBy("label", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank_sum"))
    return s.withColumn("u", F.col("rank_sum") - F.col("n") * (F.col("n") + 1) / 2)


def kruskal(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(col, groups, h): H over all clusters, tie-corrected; null where all values are equal or one group has them."""
    counts = value_counts(values)
    sums = rank_sums(values, labels, counts)
    n = F.col("n").cast("double")
    h = sums.groupBy("col").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s")).join(tie_terms(counts), "col")
    value = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.col("correction")
    return h.select("col", "groups", F.when((F.col("correction") > 0) & (F.col("groups") > 1), value).alias("h"))


def with_p(rows: DataFrame, name: str, function, columns: list[str]) -> DataFrame:
    """``rows`` with a probability computed from a few columns (a row per cluster and column, never per input row)."""
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [None if any(x is None for x in row) else function(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None or math.isnan(x) else x for x in p], pa.float64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def fdr(rows: DataFrame, p: str, q: str) -> DataFrame:
    """Benjamini-Hochberg step-up over all rows; a missing p counts as 1 and gives 1."""
    rows = rows.withColumn("__p", F.coalesce(F.col(p), F.lit(1.0))).withColumn("__id", F.monotonically_increasing_id())
    counts = rows.agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy(F.lit(0)).orderBy("__p")  # one row per cluster and column
    ranked = rows.crossJoin(F.broadcast(counts)).withColumn("__rank", F.row_number().over(up))
    raw = F.col("__p") * F.col("m") / F.col("__rank")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("__raw", raw).withColumn(q, F.least(F.min("__raw").over(down), F.lit(1.0)))
    return out.withColumn(q, F.when(F.col(p).isNull(), 1.0).otherwise(F.col(q))).drop("__p", "__id", "m", "__rank", "__raw")


def empirical_percentile(rows: DataFrame, metric: str, name: str, ties: list[str]) -> DataFrame:
    """Rank from 0 to 1 over all rows, ties by ``ties``; 0 for all where the metric does not vary."""
    order = Window.partitionBy(F.lit(0)).orderBy(metric, *ties)
    whole = Window.partitionBy(F.lit(0))
    n, lo, hi = F.count(F.lit(1)).over(whole), F.min(metric).over(whole), F.max(metric).over(whole)
    flat = (hi - lo) <= F.lit(1e-8) + 1e-5 * F.abs(lo)
    return rows.withColumn(name, F.when(flat | (n <= 1), 0.0).otherwise((F.row_number().over(order) - 1) / (n - 1)))


def aggregate_score(rows: DataFrame, metrics: list[str], ties: list[str]) -> DataFrame:
    """aggregate_score (geometric mean of the metrics' percentiles) and percentile_score of it."""
    for m in metrics:
        rows = empirical_percentile(rows, m, f"__pct_{m}", ties)
    mean = sum(F.log(F.col(f"__pct_{m}") + 1e-6) for m in metrics) / len(metrics)
    rows = rows.withColumn("aggregate_score", F.greatest(F.exp(mean) - 1e-6, F.lit(0.0))).drop(*[f"__pct_{m}" for m in metrics])
    return empirical_percentile(rows, "aggregate_score", "percentile_score", ties)


def natural_breaks(scores: list[float], k: int = 3) -> list[int]:
    """Class of each score (0 lowest): exact least-squares classes of sorted numbers, by dynamic programming."""
    order = sorted(range(len(scores)), key=scores.__getitem__)
    x = [scores[i] for i in order]
    k = min(k, len(set(x)))
    n = len(x)
    sums, squares = [0.0], [0.0]
    for v in x:
        sums.append(sums[-1] + v)
        squares.append(squares[-1] + v * v)
    cost = lambda a, b: squares[b] - squares[a] - (sums[b] - sums[a]) ** 2 / (b - a)
    best, cut = [[0.0] + [math.inf] * n], []
    for _ in range(k):
        row, at = [math.inf] * (n + 1), [0] * (n + 1)
        for b in range(1, n + 1):
            for a in range(b):
                if best[-1][a] < math.inf and (v := best[-1][a] + cost(a, b)) < row[b] - 1e-15:
                    row[b], at[b] = v, a
        best.append(row)
        cut.append(at)
    out, b = [0] * n, n
    for c in range(k - 1, -1, -1):
        a = cut[c][b]
        for i in range(a, b):
            out[order[i]] = c
        b = a
    return out


def signal_tiers(rows: DataFrame, group: str = "label", score: str = "percentile_score") -> DataFrame:
    """signal_tier: core, supporting or context by the breaks of a cluster's positive scores, noise for the others."""

    def run(t: pa.Table) -> pa.Table:
        values = t[score].to_pylist()
        positive = [i for i, v in enumerate(values) if v is not None and v > 0]
        tier = ["noise"] * len(values)
        if positive:
            classes = natural_breaks([values[i] for i in positive])
            names = {0: ("core",), 1: ("supporting", "core"), 2: ("context", "supporting", "core")}[max(classes)]
            for i, c in zip(positive, classes):
                tier[i] = names[c]
        return t.append_column("signal_tier", pa.array(tier, pa.string()))

    return rows.groupBy(group).applyInArrow(run, StructType([*rows.schema.fields, StructField("signal_tier", StringType())]))


# Evidence tables -----------------------------------------------------------------------------------------------------

NUMERIC_METRICS = ["m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8", "m9"]


def numeric_evidence(values: DataFrame, labels: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """One row per cluster and column: effects, distances, tests with false-discovery control, score and direction.

    ``neighbours`` holds (label, neighbour): the cluster each one is compared with besides the rest.
    """
    counts = value_counts(values)
    c = F.col
    table = cluster_moments(values, labels).join(F.broadcast(column_profile(values).select("col", c("mean").alias("g_mean"), c("std1").alias("g_std"), c("mad").alias("g_mad"), "iqr")), "col")
    table = table.join(ks_statistics(values, labels, counts), ["label", "col"]).join(wasserstein(values, labels, counts), ["label", "col"]).join(rank_sums(values, labels, counts).select("label", "col", "u"), ["label", "col"])
    table = table.join(F.broadcast(tie_terms(counts).select("col", "ties")), "col").join(F.broadcast(kruskal(values, labels)), "col", "left")
    e1 = (c("mean") - c("mean_rest")) / F.greatest(pooled_std(c("n"), c("std"), c("n_rest"), c("std_rest")), F.lit(EPS))
    e2 = (c("median") - c("median_rest")) / F.greatest(1.4826 * F.greatest("mad_rest", "g_mad"), F.lit(EPS))
    table = table.withColumns({
        "effect_mean_std": e1, "effect_median_mad": e2, "wasserstein_norm": c("w1") / F.greatest(c("iqr"), F.lit(EPS)),
        "variance_ratio_log": F.log((c("var") + EPS) / (c("var_rest") + EPS)), "concentration_gain": F.greatest(F.lit(0.0), 1 - (c("std") + EPS) / F.greatest(c("g_std"), F.lit(EPS))),
        "z_score": (c("mean") - c("g_mean")) / F.greatest(c("g_std"), F.lit(EPS)), "homogeneity": c("std") / F.greatest(c("g_std"), F.lit(EPS)),
    })
    if neighbours is not None:
        other = moments(values.join(labels, "node_id"), ["label", "col"]).select(c("label").alias("neighbour"), "col", c("n").alias("n2"), c("mean").alias("mean2"), c("std").alias("std2"))
        table = table.join(neighbours, "label", "left").join(other, ["neighbour", "col"], "left")
        table = table.withColumn("neighbor_effect", (c("mean") - c("mean2")) / F.greatest(pooled_std(c("n"), c("std"), c("n2"), c("std2")), F.lit(EPS))).drop("n2", "mean2", "std2")
    else:
        table = table.withColumns({"neighbour": F.lit(None).cast("long"), "neighbor_effect": F.lit(None).cast("double")})
    table = with_p(table, "one_vs_rest_p", lambda u, n, m, ties: special.mann_whitney_p(u, n, m, ties, ties > 0), ["u", "n", "n_rest", "ties"])
    table = with_p(table, "global_p", lambda h, g: special.chi2_sf(h, g - 1), ["h", "groups"])
    table = fdr(fdr(table, "one_vs_rest_p", "one_vs_rest_q"), "global_p", "global_q")
    near = F.coalesce(F.abs("neighbor_effect"), F.lit(0.0))
    specific = (F.abs("effect_mean_std") + F.abs("effect_median_mad") + near + c("ks") + c("wasserstein_norm")) / 5
    table = table.withColumn("specificity_score", specific)
    metrics = [F.abs("effect_mean_std"), F.abs("effect_median_mad"), c("ks"), c("wasserstein_norm"), F.greatest("concentration_gain", F.lit(0.0)), c("specificity_score"), -F.log10(c("one_vs_rest_q") + EPS), -F.log10(c("global_q") + EPS), near]
    table = table.withColumns(dict(zip(NUMERIC_METRICS, metrics)))
    scored = aggregate_score(table, NUMERIC_METRICS, ["label", "col"]).drop(*NUMERIC_METRICS)
    up = (c("effect_mean_std") > 0).cast("int") + (c("effect_median_mad") > 0).cast("int")
    down = (c("effect_mean_std") < 0).cast("int") + (c("effect_median_mad") < 0).cast("int")
    return scored.withColumn("direction", F.when((up > 0) & (down == 0), "up").when((down > 0) & (up == 0), "down").otherwise("mixed"))


def long_categories(table: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """(node_id, col, value) of categorical columns, missing as __MISSING__; columns of too many values are left out."""
    if n is not None:
        row = table.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in columns]).first()
        columns = [c for c in columns if row[c] <= max(10, 0.05 * n)]
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__MISSING__")).alias("value")) for c in columns])
    return table.select("node_id", F.explode(parts).alias("p")).select("node_id", "p.col", "p.value")


def category_counts(categories: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, col, value, both, in_cluster, with_value, n): the margins of every cluster and value that meet."""
    own = categories.join(labels, "node_id")
    both = own.groupBy("label", "col", "value").agg(F.count(F.lit(1)).alias("both"))
    cluster = both.groupBy("label", "col").agg(F.sum("both").alias("in_cluster"))
    value = both.groupBy("col", "value").agg(F.sum("both").alias("with_value"))
    total = value.groupBy("col").agg(F.sum("with_value").alias("n"))
    return both.join(cluster, ["label", "col"]).join(value, ["col", "value"]).join(F.broadcast(total), "col")


def prevalence(counts: DataFrame) -> DataFrame:
    """Prevalence in the cluster and overall (percent), lift, specificity, recall and mutual information per value."""
    c = F.col
    inside, overall = c("both") / c("in_cluster"), c("with_value") / c("n")
    outside = F.when(c("n") > c("in_cluster"), (c("with_value") - c("both")) / (c("n") - c("in_cluster"))).otherwise(0.0)
    lift = inside / F.greatest(overall, F.lit(EPS))
    joint = c("both") / c("n")
    chance = (c("in_cluster") / c("n")) * overall
    return counts.withColumns({
        "prevalence_cluster": 100 * inside, "prevalence_global": 100 * overall, "lift": lift, "log_lift": F.log(F.greatest(lift, F.lit(EPS))),
        "specificity": 100 * (inside - outside), "global_recall": 100 * c("both") / c("with_value"), "mi_contrib": joint * F.log(F.greatest(joint, F.lit(EPS)) / F.greatest(chance, F.lit(EPS))),
    })


def chi_square(categories: DataFrame, labels: DataFrame) -> DataFrame:
    """(col, chi2, dof, association): cluster by value, with Yates' correction for one degree of freedom."""
    both = category_counts(categories, labels)
    sides = both.groupBy("col").agg(F.count_distinct("label").alias("r"), F.count_distinct("value").alias("c"))
    cells = both.select("col", "label", "in_cluster").distinct().join(both.select("col", "value", "with_value", "n").distinct(), "col")
    cells = cells.join(both.select("col", "label", "value", "both"), ["col", "label", "value"], "left").join(F.broadcast(sides), "col")
    expected = F.col("in_cluster") * F.col("with_value") / F.col("n")
    gap = F.abs(F.coalesce("both", F.lit(0)) - expected)
    gap = F.when((F.col("r") - 1) * (F.col("c") - 1) == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.groupBy("col").agg(F.sum(gap * gap / expected).alias("chi2"), F.first((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.first("n").alias("n"))
    return out.select("col", "chi2", "dof", (F.col("chi2") / F.col("n")).alias("association"))


def _value_p(both: int, in_cluster: int, with_value: int, n: int) -> float:
    a, b, c = both, in_cluster - both, with_value - both
    d = n - a - b - c
    rows, cols = (in_cluster, n - in_cluster), (with_value, n - with_value)
    if min(rows) == 0 or min(cols) == 0:
        return 1.0
    least = min(x * y / n for x in rows for y in cols)
    if least < 5:
        return special.fisher_p(a, b, c, d)
    gap = abs(a - in_cluster * with_value / n)
    gap -= min(0.5, gap)
    return special.chi2_sf(sum(gap * gap / (x * y / n) for x in rows for y in cols), 1)


def categorical_evidence(categories: DataFrame, labels: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """One row per cluster, column and value that meet, with tests, false-discovery control and score."""
    table = with_p(prevalence(category_counts(categories, labels)), "p", _value_p, ["both", "in_cluster", "with_value", "n"])
    world = with_p(chi_square(categories, labels), "global_p", lambda x, d: special.chi2_sf(x, d) if d > 0 else 1.0, ["chi2", "dof"])
    table = table.join(F.broadcast(world), "col")
    if neighbours is not None:
        other = prevalence(category_counts(categories, labels)).select(F.col("label").alias("neighbour"), "col", "value", F.col("prevalence_cluster").alias("prev2"))
        table = table.join(neighbours, "label", "left").join(other, ["neighbour", "col", "value"], "left")
        table = table.withColumn("neighbor_specificity", F.when(F.col("neighbour").isNotNull(), F.col("prevalence_cluster") - F.coalesce("prev2", F.lit(0.0)))).drop("prev2")
    else:
        table = table.withColumns({"neighbour": F.lit(None).cast("long"), "neighbor_specificity": F.lit(None).cast("double")})
    table = fdr(fdr(table, "p", "fisher_q"), "global_p", "global_q")
    names = [f"m{k}" for k in range(1, 9)]
    metrics = [F.col("prevalence_cluster"), F.abs("log_lift"), F.abs("specificity"), F.col("global_recall"), F.coalesce(F.abs("neighbor_specificity"), F.lit(0.0)), F.abs("mi_contrib"), -F.log10(F.col("fisher_q") + EPS), -F.log10(F.col("global_q") + EPS)]
    return aggregate_score(table.withColumns(dict(zip(names, metrics))), names, ["label", "col", "value"]).drop(*names)


def cluster_adjacency(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, neighbour, bridge_weight, normalized_weight, bridge_strength, rank): bridges between clusters, both ways."""
    of = lambda k: labels.select(F.col("node_id").alias(k), F.col("label").alias(f"l{k}"))
    rows = edges.join(of("i"), "i").join(of("j"), "j")
    return bridges(rows.groupBy(F.least("li", "lj").alias("a"), F.greatest("li", "lj").alias("b")).agg(F.sum("w").alias("w")), labels)


def set_adjacency(graph: SetGraph, labels: DataFrame) -> DataFrame:
    """``cluster_adjacency`` of a graph of sets, from how many nodes of each set have each label."""
    own = checkpoint(graph.members.join(labels, "node_id").groupBy("rep", "label").agg(F.count(F.lit(1)).alias("n")))
    of = lambda k: own.select(F.col("rep").alias(k), F.col("label").alias(f"l{k}"), F.col("n").alias(f"n{k}"))
    # First all weight from a set to each label, then by the labels of the set: sets by labels by labels at most.
    near = graph.pairs().join(of("j"), "j").groupBy("i", "lj").agg(F.sum(F.col("w") * F.col("nj")).alias("w"))
    apart = near.join(of("i"), "i").select("li", "lj", (F.col("w") * F.col("ni")).alias("w"))
    inside = of("i").join(of("j").withColumnRenamed("j", "i"), "i").where("li <= lj")
    inside = inside.select("li", "lj", F.when(F.col("li") < F.col("lj"), F.col("ni") * F.col("nj")).otherwise(F.col("ni") * (F.col("ni") - 1) / 2).cast("double").alias("w")).where("w > 0")
    rows = apart.unionByName(inside)
    return bridges(rows.groupBy(F.least("li", "lj").alias("a"), F.greatest("li", "lj").alias("b")).agg(F.sum("w").alias("w")), labels)


def bridges(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster_adjacency`` from the weight w between labels a <= b."""
    inner = pairs.where("a = b").select(F.col("a").alias("label"), F.col("w").alias("internal"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).join(inner, "label", "left").na.fill(0.0, ["internal"])
    side = lambda k: sizes.select(F.col("label").alias(k), F.col("size").alias(f"size_{k}"), F.col("internal").alias(f"in_{k}"))
    both = pairs.where("a < b").join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.col("w").alias("bridge_weight"), (F.col("w") / F.greatest(F.sqrt(F.col("size_a") * F.col("size_b")), F.lit(1.0))).alias("normalized_weight"), (F.col("w") / F.greatest(F.col("w") + F.col("in_a") + F.col("in_b"), F.lit(EPS))).alias("bridge_strength"))
    ways = both.select(F.col("a").alias("label"), F.col("b").alias("neighbour"), *both.columns[2:]).unionByName(both.select(F.col("b").alias("label"), F.col("a").alias("neighbour"), *both.columns[2:]))
    order = Window.partitionBy("label").orderBy(F.desc("normalized_weight"), F.desc("bridge_strength"), "neighbour")
    return ways.withColumn("rank", F.row_number().over(order))


def strongest_neighbours(adjacency: DataFrame) -> DataFrame:
    return adjacency.where("rank = 1").select("label", "neighbour")


def compare_clusters(values: DataFrame, labels: DataFrame, a: int, b: int) -> DataFrame:
    """Per column: Welch's p, KS p and Cohen's d of two clusters of two rows or more each, by the size of d."""
    two = labels.where(F.col("label").isin(a, b))
    rows = values.join(two.select("node_id"), "node_id")
    m = moments(values.join(two, "node_id"), ["label", "col"]).where("n > 1")
    side = lambda k, s: m.where(F.col("label") == k).select("col", *[F.col(x).alias(f"{x}_{s}") for x in ("n", "mean", "std", "var")])
    both = side(a, "a").join(side(b, "b"), "col").join(ks_statistics(rows, two).where(F.col("label") == a).select("col", "ks"), "col")
    c = F.col
    both = both.withColumn("cohens_d", (c("mean_a") - c("mean_b")) / F.greatest(pooled_std(c("n_a"), c("std_a"), c("n_b"), c("std_b")), F.lit(EPS)))
    both = with_p(both, "welch_p", special.welch_p, ["mean_a", "var_a", "n_a", "mean_b", "var_b", "n_b"])
    return with_p(both, "ks_p", special.ks_p, ["ks", "n_a", "n_b"]).orderBy(F.desc(F.abs("cohens_d")), "col")
