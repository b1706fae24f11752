"""Columns made numeric and complete, in a fixed order: drop, coerce, guard, flag, impute, encode, check.

Null and NaN are both missing. Each step is one projection or one wide aggregate over the table.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlace.functions.hashing import gaussian, uniform
from coverlace.operators.stats import running
from coverlace.sources.tables import with_node_id

NUMERIC_METHODS = ("fill_mean", "fill_median", "sample_normal")
#: Columns that one column's categories may become where no limit is given.
MAX_CATEGORIES = 10_000
METHODS = (*NUMERIC_METHODS, "fill_mode", "sample_categorical")


@dataclass(frozen=True)
class Impute:
    method: str
    seed: int = 42


@dataclass(frozen=True)
class OneHot:
    max_categories: int | None = None


@dataclass
class Preprocessing:
    drop: list[str] = field(default_factory=list)
    impute: dict[str, Impute] = field(default_factory=dict)
    encode: dict[str, OneHot] = field(default_factory=dict)


@dataclass(frozen=True)
class Layout:
    """Names in order, category lists and the number of rows of a preprocessed table."""

    features: tuple[str, ...]
    vocabulary: dict[str, tuple[str, ...]]
    n_rows: int


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def unify_missing(df: DataFrame) -> DataFrame:
    """NaN to null in floating columns."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to numbers; at least half of a column's values must parse."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    todo = [c for c in columns if not is_numeric(kinds[c])]
    if not todo:
        return df
    parsed = {c: F.expr(f"try_cast(`{c}` as double)") for c in todo}
    row = df.agg(*[x for c in todo for x in (F.count(c).alias(f"{c}__n"), F.count(parsed[c]).alias(f"{c}__ok"))]).first()
    for c in todo:
        if row[f"{c}__ok"] < 0.5 * row[f"{c}__n"]:
            bad = [r[0] for r in df.where(F.col(c).isNotNull() & parsed[c].isNull()).select(c).limit(5).collect()]
            raise ValueError(f"Column '{c}' is configured for numeric imputation (fewer than half of its values are numbers), e.g. {bad}")
    return df.withColumns({c: parsed[c] for c in todo})


def guard_all_missing(df: DataFrame, columns: list[str]) -> None:
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first() if columns else None
    for c in columns:
        if row[c] == 0:
            raise ValueError(f"Column '{c}' is all-missing")


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("double") for c in columns})


#: Parts of [0, 1) in which draws meet the values that may be drawn there.
DRAW_PARTS = 1024


def drawn_categories(df: DataFrame, column: str, seed: int, row_key: str) -> DataFrame:
    """``df`` with missing values of ``column`` drawn by the shares of the others, in the values' order.

    Values and draws meet by parts of [0, 1), so neither is collected; draws depend on the seed, the column and the key.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("total"))
    # Ascending; distinct values are few against the rows, and running totals are taken in ranges of their numbers.
    placed = with_node_id(counts, "value", name="at")
    upto = running(placed.withColumn("one", F.lit(0)), ["one"], "at", "k").crossJoin(F.broadcast(total))  # one row
    shares = upto.select("value", ((F.col("upto") - F.col("k")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))
    of = lambda c: F.least(F.floor(F.col(c) * DRAW_PARTS), F.lit(DRAW_PARTS - 1))
    shares = shares.withColumn("part", F.explode(F.sequence(of("lo"), of("hi"))))
    u = F.greatest(uniform(seed, F.lit(column), F.col(row_key)), F.lit(1e-300))
    draws = df.where(F.col(column).isNull()).select(F.col(row_key).alias("key"), u.alias("u")).withColumn("part", of("u"))
    drawn = draws.join(shares, "part").where("lo < u AND u <= hi").select("key", "value")
    out = df.join(drawn, df[row_key] == drawn["key"], "left")
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.col("value")).alias(c) if c == column else df[f"`{c}`"] for c in df.columns])


def imputation(df: DataFrame, column: str, spec: Impute, row_key: str) -> Column | None:
    """The value that replaces a missing one; draws depend on the seed, the column and the row's key alone.

    Categories are drawn by ``drawn_categories`` instead.
    """
    kind = df.schema[column].dataType
    if spec.method not in METHODS:
        raise ValueError(f"Invalid parameter: unknown imputation method '{spec.method}'")
    if spec.method in NUMERIC_METHODS and not is_numeric(kind):
        raise ValueError(f"Column '{column}' is configured for numeric imputation ({spec.method}) but is not numeric")
    c = F.col(column)
    if spec.method == "fill_mode":
        return F.lit(df.agg(F.mode(c, True)).first()[0])
    x = c.cast("double")
    if spec.method == "fill_mean":
        return F.lit(df.agg(F.avg(x)).first()[0])
    if spec.method == "fill_median":
        return F.lit(df.agg(F.median(x)).first()[0])
    mean, deviation = df.agg(F.avg(x), F.stddev_pop(x)).first()
    return F.lit(mean) + F.lit(max(deviation or 0.0, 1e-10)) * gaussian(spec.seed, F.lit(column), F.col(row_key))


def vocabulary_of(df: DataFrame, column: str, limit: int | None) -> tuple[str, ...]:
    """Sorted categories; more than ``limit``, or than columns can be made for, is an error, more than fifty a warning."""
    most = MAX_CATEGORIES if limit is None else limit
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("c")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"Column '{column}' has {len(found)} categories or more, exceeding max_categories={most}")
    if len(found) > 50:
        warnings.warn(f"Column '{column}' has {len(found)} categories", stacklevel=2)
    return tuple(sorted(found))


def one_hot(df: DataFrame, column: str, categories: tuple[str, ...]) -> DataFrame:
    """A 0/1 column per category, appended in order; a missing value is all zeros; the source column goes."""
    text = F.col(column).cast("string")
    return df.withColumns({f"{column}_{v}": F.when(text == v, 1.0).otherwise(0.0) for v in categories}).drop(column)


def preprocess(df: DataFrame, spec: Preprocessing, row_key: str = "node_id", expected: Layout | None = None, vocabulary: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, Layout]:
    """A table of doubles without missing values, keyed by ``row_key``, and its layout."""
    df = unify_missing(df.drop(*[c for c in spec.drop if c in df.columns]))
    impute = {c: s for c, s in spec.impute.items() if c in df.columns}
    encode = {c: s for c, s in spec.encode.items() if c in df.columns}
    df = coerce(df, [c for c, s in impute.items() if s.method in NUMERIC_METHODS])
    guard_all_missing(df, list(dict.fromkeys([*impute, *encode])))
    df = missing_flags(df, list(impute))
    filled = {c: F.coalesce(F.col(c), value.cast(df.schema[c].dataType) if not is_numeric(df.schema[c].dataType) else value.cast("double")) for c, s in impute.items() if s.method != "sample_categorical" and (value := imputation(df, c, s, row_key)) is not None}
    df = df.withColumns(filled) if filled else df
    for c, s in impute.items():
        if s.method == "sample_categorical":
            df = drawn_categories(df, c, s.seed, row_key)
    words = {c: (vocabulary or {}).get(c) or vocabulary_of(df, c, s.max_categories) for c, s in encode.items()}
    for c in encode:
        df = one_hot(df, c, words[c])
    features = [c for c in df.columns if c != row_key]
    text = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != row_key and not is_numeric(f.dataType)}
    nulls = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in features]).first()
    missing = {c: nulls[c] for c in features if nulls[c]}
    if missing:
        raise ValueError(f"NaN values remain after imputation: {missing}")
    if text:
        raise TypeError(f"Non-numeric columns remain: {text}")
    layout = Layout(tuple(features), words, nulls["__n"])
    if expected is not None and (layout.features != expected.features or layout.n_rows != expected.n_rows):
        raise ValueError("the table's columns or rows differ from the expected layout")
    return df.select(row_key, *[F.col(f"`{c}`").cast("double").alias(c) for c in features]), layout


def as_points(df: DataFrame, features: list[str], row_key: str = "node_id") -> DataFrame:
    """(node_id, v): the features as one array."""
    return df.select(F.col(row_key).alias("node_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("v"))
