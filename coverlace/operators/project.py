"""Scaling and projection of points (node_id, v)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlace.functions.hashing import gaussian_matrix


@dataclass(frozen=True)
class Scaler:
    """Population z-scores; a column whose deviation is under 1e-10 is only centred."""

    mean: tuple[float, ...]
    deviation: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> Scaler:
        row = df.agg(*[x for k, c in enumerate(features) for x in (F.avg(f"`{c}`").alias(f"m{k}"), F.stddev_pop(f"`{c}`").alias(f"s{k}"))]).first()
        mean = tuple(float(row[f"m{k}"] or 0.0) for k in range(len(features)))
        return cls(mean, tuple(float(row[f"s{k}"]) if (row[f"s{k}"] or 0.0) >= 1e-10 else 1.0 for k in range(len(features))))

    def _check(self, features: list[str]) -> None:
        if len(features) != len(self.mean):
            raise ValueError(f"{len(features)} columns given, {len(self.mean)} fitted")

    def transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        self._check(features)
        return df.withColumns({c: (F.col(f"`{c}`") - m) / s for c, m, s in zip(features, self.mean, self.deviation)})

    def inverse(self, df: DataFrame, features: list[str]) -> DataFrame:
        self._check(features)
        return df.withColumns({c: F.col(f"`{c}`") * s + m for c, m, s in zip(features, self.mean, self.deviation)})


EMBEDDINGS = "emb_id int, seed int, dim int, node_id long, v array<double>"


def _checked(width: int, dimensions: list[int], seeds: list[int]) -> None:
    if not dimensions or not seeds:
        raise ValueError("at least one dimension and one seed are needed")
    if min(dimensions) < 1:
        raise ValueError("a projection has at least one dimension")


def width_of(points: DataFrame) -> int:
    row = points.select(F.size("v").alias("n")).limit(1).collect()
    if not row:
        raise ValueError("no points")
    return row[0][0]


def column_means(points: DataFrame, width: int) -> np.ndarray:
    row = points.agg(*[F.avg(F.get("v", F.lit(k))) for k in range(width)]).first()
    return np.array([x or 0.0 for x in row])


def _matrix_product(points: DataFrame, blocks: list[tuple[int, int, int, np.ndarray]], means: np.ndarray) -> DataFrame:
    """All projections of a batch in one pass: a block is (embedding, seed, dimension, matrix)."""
    spark = points.sparkSession
    told = spark.sparkContext.broadcast((blocks, means))  # features by dimensions, whatever the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, means = told.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("node_id")
            x = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) - means
            for emb, seed, dim, matrix in blocks:
                y = x @ matrix
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, dim), pa.int32()), pa.array(y.ravel()))
                cols = [pa.array(np.full(len(y), k, np.int32)) for k in (emb, seed, dim)]
                yield pa.RecordBatch.from_arrays([*cols, ids, values], names=["emb_id", "seed", "dim", "node_id", "v"])

    return points.select("node_id", "v").mapInArrow(run, EMBEDDINGS)


def jl_grid(points: DataFrame, dimensions: list[int], seeds: list[int], center: bool = True) -> DataFrame:
    """Gaussian projections X G / sqrt(d) for every seed (outer) and dimension (inner)."""
    width = width_of(points)
    _checked(width, dimensions, seeds)
    means = column_means(points, width) if center else np.zeros(width)
    blocks = [(i * len(dimensions) + k, s, d, gaussian_matrix(s, width, d) / np.sqrt(d)) for i, s in enumerate(seeds) for k, d in enumerate(dimensions)]
    return _matrix_product(points, blocks, means)


def covariance(points: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, scatter matrix about them, and number of points, from partial sums per batch."""
    means = column_means(points, width)
    told = points.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            x = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) - told.value
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64())), pa.array(np.full(width, n))], names=["row", "part", "n"])

    parts = points.select("v").mapInArrow(run, "row int, part array<double>, n long")
    rows = parts.groupBy("row").agg(*[F.sum(F.get("part", F.lit(k))).alias(f"c{k}") for k in range(width)], F.sum("n").alias("n")).orderBy("row").collect()
    return means, np.array([[r[f"c{k}"] for k in range(width)] for r in rows]), rows[0]["n"] if rows else 0


def pca(points: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, loadings (features by components; each one's largest entry is positive) and explained variances."""
    width = width_of(points)
    if not 1 <= components <= width:
        raise ValueError(f"between 1 and {width} components are possible")
    means, scatter, n = covariance(points, width)
    if n < 2:
        raise ValueError("at least two points are needed")
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1][:components]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(components)])
    return means, vectors, np.maximum(values[order], 0) / (n - 1)


def pca_grid(points: DataFrame, dimensions: list[int], seeds: list[int]) -> DataFrame:
    """Prefixes of one exact decomposition; seeds are replicas, as nothing is drawn."""
    _checked(width_of(points), dimensions, seeds)
    means, loadings, _ = pca(points, max(dimensions))
    blocks = [(i * len(dimensions) + k, s, d, loadings[:, :d]) for i, s in enumerate(seeds) for k, d in enumerate(dimensions)]
    return _matrix_product(points, blocks, means)


def projection_grid(points: DataFrame, method: str, dimensions: list[int], seeds: list[int], center: bool = True) -> DataFrame:
    if method == "jl":
        return jl_grid(points, dimensions, seeds, center)
    if method == "pca":
        return pca_grid(points, dimensions, seeds)
    raise ValueError(f"unknown projection method '{method}'")
