"""Profiles of columns and of point clouds, and the preprocessing they suggest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.operators import project
from coverlace.operators.preprocess import is_numeric

#: Neighbours and dimensions that are reported, and points that neighbours are searched among.
NEIGHBOURS, DIMENSIONS, SUBSAMPLE = (5, 10, 20), (2, 3, 5, 10, 15, 20), 1000


def column_profiles(df: DataFrame) -> list[dict]:
    """Type, distinct and missing values of every column, in one aggregate."""
    missing = {f.name: F.col(f"`{f.name}`").isNull() | (F.isnan(f"`{f.name}`") if f.dataType.simpleString() in ("double", "float") else F.lit(False)) for f in df.schema.fields}
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[x for c in df.columns for x in (F.count_distinct(F.when(~missing[c], F.col(f"`{c}`"))).alias(f"u__{c}"), F.count_if(missing[c]).alias(f"m__{c}"))]).first()
    n = row["__n"]
    return [{"column": f.name, "dtype": f.dataType.simpleString(), "is_numeric": is_numeric(f.dataType), "n_unique": row[f"u__{f.name}"], "n_missing": row[f"m__{f.name}"], "missing_pct": round(100 * row[f"m__{f.name}"] / n, 2) if n else 0.0} for f in df.schema.fields]


def probe_column(df: DataFrame, column: str, max_sample: int = 10) -> dict:
    """A column's profile with moments, sample values, and frequent values where they are few or no numbers."""
    out = column_profiles(df.select(column))[0]
    c = F.col(column)
    if out["is_numeric"]:
        row = df.agg(F.avg(c.cast("double")), F.stddev_samp(c.cast("double")), F.min(c.cast("double")), F.max(c.cast("double"))).first()
        out |= dict(zip(("mean", "std", "min", "max"), (None if x is None else round(x, 4) for x in row)))
    out["sample"] = [r[0] for r in df.where(c.isNotNull()).select(column).limit(max_sample).collect()]
    if out["n_unique"] <= 20 or not out["is_numeric"]:
        out["top_values"] = [(r[0], r["count"]) for r in df.where(c.isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(10).collect()]
    return out


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(node_id, rank, d): distances to the first ``k`` neighbours, by brute force: for bounded sets of points, as
    ``geometry`` takes."""
    a = points.select("node_id", "v")
    b = points.select(F.col("node_id").alias("other"), F.col("v").alias("u"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "u", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t))
    pairs = a.join(b, F.col("node_id") != F.col("other")).select("node_id", "other", d.alias("d"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy("d", "other"))).where(F.col("rank") <= k).select("node_id", "rank", "d")


def subsample(points: DataFrame, size: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """At most ``size`` points, those with the least hash of their id (a sampling operator of the reported profile)."""
    return points.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(size)


def geometry(points: DataFrame, size: int = SUBSAMPLE) -> dict:
    """Mean neighbour distances, spread of the fifth neighbour's distance, and cumulative variance by dimension."""
    few = subsample(points, size).persist()
    try:
        near = nearest(few, max(NEIGHBOURS)).persist()
        means = near.agg(*[F.avg(F.when(F.col("rank") <= k, F.col("d"))).alias(f"k{k}") for k in NEIGHBOURS]).first().asDict()
        q = near.where("rank = 5").agg(F.percentile("d", [0.05, 0.25, 0.5, 0.75, 0.95])).first()[0] or [0.0] * 5
        near.unpersist()
        width = project.width_of(few)
        _, scatter, _ = project.covariance(few, width)
    finally:
        few.unpersist()
    values = np.sort(np.linalg.eigvalsh(scatter))[::-1]
    share = np.cumsum(np.maximum(values, 0)) / max(values.sum(), 1e-12)
    return {"knn_mean": means, "knn": dict(zip(("p5", "p25", "p50", "p75", "p95"), q)), "variance": {d: float(share[d - 1]) for d in DIMENSIONS if d <= width}}


PROTECTED = ("age", "income", "target", "outcome", "label", "score")


def recommend(profiles: list[dict], n: int, numeric_text: dict[str, float] | None = None) -> dict:
    """Columns to drop, impute and encode, by type, missing share and number of values.

    ``numeric_text`` gives, for text columns, the share of sampled values that parse as numbers.
    """
    drop, impute, encode, review = [], {}, {}, []
    for p in profiles:
        c, share, unique = p["column"], p["missing_pct"] / 100, p["n_unique"]
        if share >= 1:
            drop.append(c)
        elif not p["is_numeric"]:
            if (numeric_text or {}).get(c, 0) > 0.5:
                impute[c] = {"method": "sample_normal" if share >= 0.3 else "fill_mean"}
            elif n and unique / n > 0.9 or unique > 50:
                drop.append(c)
            else:
                encode[c] = {"method": "one_hot"} | ({"max_categories": unique} if unique > 20 else {})
                if share > 0:
                    impute[c] = {"method": "fill_mode" if unique == 2 else "sample_categorical"}
        elif share >= 0.8 and not any(h in c.lower() for h in PROTECTED):
            drop.append(c)
        elif share >= 0.1:
            impute[c] = {"method": "sample_normal"}
            if share >= 0.6:
                review.append(c)
        elif share > 0:
            impute[c] = {"method": "fill_mean"}
    return {"drop_columns": drop, "impute": impute, "encode": encode, "review": review}


def repair(message: str, raw: dict) -> dict:
    """A configuration patched for a preprocessing error that it caused."""
    import re

    out = json_copy(raw)
    pre = out.setdefault("preprocessing", {})
    impute, encode, drop = pre.setdefault("impute", {}), pre.setdefault("encode", {}), pre.setdefault("drop_columns", [])
    if m := re.search(r"Column '(.+?)' is configured for numeric imputation", message):
        impute[m[1]] = {"method": "fill_mode"}
        encode.setdefault(m[1], {"method": "one_hot"})
    elif m := re.search(r"Column '(.+?)' is all-missing", message):
        impute.pop(m[1], None)
        encode.pop(m[1], None)
        drop.append(m[1])
    elif m := re.search(r"Column '(.+?)' has .*exceeding max_categories", message):
        encode.pop(m[1], None)
        impute.pop(m[1], None)
        drop.append(m[1])
    elif "NaN values remain after imputation" in message:
        for c in re.findall(r"'(.+?)':", message):
            impute.setdefault(c, {"method": "fill_mean"})
    elif "Non-numeric columns remain" in message:
        for c in re.findall(r"'(.+?)':", message):
            drop.append(c)
    else:
        raise ValueError(f"no repair is known for: {message}")
    return out


def json_copy(x: dict) -> dict:
    import copy

    return copy.deepcopy(x)
