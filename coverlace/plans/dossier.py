"""The dossier of a partition: what makes every cluster what it is, its neighbours, and its most central rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.operators import clustering, stats

#: Rows that stand for a cluster; features that a summary shows of each kind; tiers by detail.
CENTRAL, SHOWN = 3, 5
TIERS = {"summary": ("core", "supporting"), "standard": ("core", "supporting", "context"), "full": ("core", "supporting", "context", "noise")}


def central_rows(nodes: DataFrame, edges: DataFrame, labels: DataFrame, most: int = CENTRAL) -> DataFrame:
    """(label, rank, node_id, score): the first rows of each cluster by weighted PageRank within it, ties by id."""
    scores = clustering.pagerank(nodes, edges, labels)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("score", 12)), "node_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= most).select("label", "rank", "node_id", "score")


def _listed(evidence: DataFrame, keep: list[str], name: str, detail: str) -> DataFrame:
    """Per cluster the evidence of the tiers that ``detail`` shows, best first."""
    rows = stats.signal_tiers(evidence).where(F.col("signal_tier").isin(*TIERS[detail]))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("percentile_score"), *keep))
    rows = rows.withColumn("nth", nth)
    if detail == "summary":
        rows = rows.where(F.col("nth") <= SHOWN)
    item = F.struct("nth", *keep, "signal_tier", F.round("percentile_score", 6).alias("score"))
    return rows.groupBy("label").agg(F.sort_array(F.collect_list(item)).alias(name))


def dossier(table: DataFrame, numeric: list[str], categorical: list[str], nodes: DataFrame, edges: DataFrame, labels: DataFrame, detail: str = "standard") -> DataFrame:
    """(label, size, share, neighbours, numeric, categorical, central): one row a cluster.

    ``table`` has node_id and the columns; clusters are compared with the rest and with their strongest neighbour. The
    lists are as long as there are neighbours, columns and values; central holds the columns of CENTRAL rows.
    """
    if detail not in TIERS:
        raise ValueError("detail is summary, standard or full")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = labels.agg(F.count(F.lit(1)).alias("n"))
    adjacency = stats.cluster_adjacency(edges, labels)
    nearest = stats.strongest_neighbours(adjacency)
    near = adjacency.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", F.round("normalized_weight", 6).alias("weight")))).alias("neighbours"))
    out = sizes.crossJoin(F.broadcast(total)).select("label", "size", (F.col("size") / F.col("n")).alias("share")).join(near, "label", "left")  # one row
    if numeric:
        out = out.join(_listed(stats.numeric_evidence(stats.long_values(table, numeric), labels, nearest), ["col", "direction"], "numeric", detail), "label", "left")
    if categorical:
        out = out.join(_listed(stats.categorical_evidence(stats.long_categories(table, categorical), labels, nearest), ["col", "value"], "categorical", detail), "label", "left")
    shown = [*numeric, *categorical]
    rows = central_rows(nodes, edges, labels).join(table.select("node_id", *shown), "node_id")
    return out.join(rows.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "node_id", *shown))).alias("central")), "label", "left")
