"""Random numbers that depend on a seed and a row's own values, not on partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the hash of the seed and the keys."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def gaussian(seed: int, *keys: Column) -> Column:
    """A standard normal number by Box and Muller from two hashes."""
    a, b = uniform(seed, F.lit(1), *keys), uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * b)


def gaussian_matrix(seed: int, rows: int, columns: int) -> np.ndarray:
    """Entry (f, c) depends on the seed, f and c alone, so a narrower matrix is a prefix of a wider one."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    f, c = np.meshgrid(np.arange(rows, dtype=np.uint64), np.arange(columns, dtype=np.uint64), indexing="ij")
    key = mix(mix(f + np.uint64(1) << np.uint64(32) | c) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    u = [((mix(key + np.uint64(k)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53) for k in (1, 2)]
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * math.pi * u[1])
