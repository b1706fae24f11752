"""Longitudinal tables: panels, graphs over time and their aggregations, trajectories and their classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = ("drop_entity", "forward_fill", "allow_ragged")


class PanelError(ValueError):
    """``code`` is stable for callers that repair their input."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def pivot_panel(df: DataFrame, entity: str, time: str, features: list[str] | None = None, on_missing: str = "drop_entity") -> DataFrame:
    """(entity, t_idx, time_label, features): one row per entity and time, ``t_idx`` counting the times in order.

    drop_entity keeps entities that have every time and no missing feature; forward_fill carries the last value and then
    drops like it; allow_ragged keeps what there is, without rows that miss a feature.
    """
    if on_missing not in POLICIES:
        raise PanelError("INVALID_PIVOT_POLICY", on_missing)
    for c in (entity, time, *(features or [])):
        if c not in df.columns:
            raise PanelError("PANEL_COLUMN_NOT_FOUND", c)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if features is None:
        features = [c for c, k in kinds.items() if isinstance(k, T.NumericType) and c not in (entity, time)]
    if not features:
        raise PanelError("PANEL_NO_FEATURES", "no numeric columns")
    if bad := [c for c in features if not isinstance(kinds[c], (T.NumericType, T.BooleanType))]:
        raise PanelError("PANEL_FEATURES_NOT_NUMERIC", str(bad))
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(F.col(entity).alias("entity"), F.col(time).alias("time_label"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features])
    if rows.groupBy("entity", "time_label").count().where("count > 1").limit(1).count():
        raise PanelError("PANEL_DUPLICATE_OBSERVATIONS", "an entity has two rows at one time")
    labels = sorted(r[0] for r in rows.select("time_label").distinct().collect())  # the panel's times
    if not labels:
        raise PanelError("PANEL_EMPTY", "no rows")
    if len(labels) < 2:
        raise PanelError("PANEL_SINGLE_TIME_STEP", "at least two times are needed")
    times = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(labels)], T.StructType([T.StructField("t_idx", T.IntegerType()), T.StructField("time_label", rows.schema["time_label"].dataType)]))
    placed = rows.join(F.broadcast(times), "time_label")
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in features])
    if on_missing == "allow_ragged":
        return placed.where(complete).select("entity", "t_idx", "time_label", *features)
    if on_missing == "forward_fill":
        grid = placed.select("entity").distinct().crossJoin(F.broadcast(times))  # a row for each entity and time is the result
        last = Window.partitionBy("entity").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
        placed = grid.join(placed.drop("time_label"), ["entity", "t_idx"], "left").select("entity", "t_idx", "time_label", *[F.last(c, True).over(last).alias(c) for c in features])
    good = placed.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(~complete).alias("holes")).where((F.col("n") == len(labels)) & (F.col("holes") == 0)).select("entity")
    return placed.join(good, "entity", "left_semi").select("entity", "t_idx", "time_label", *features)


def panel_report(df: DataFrame, panel: DataFrame, entity: str) -> dict:
    had = df.select(entity).distinct().count()
    kept, times, rows = panel.agg(F.count_distinct("entity"), F.count_distinct("t_idx"), F.count(F.lit(1))).first()
    if not kept:
        raise PanelError("PANEL_NO_COMPLETE_ENTITIES", "no entity is complete")
    return {"entities": kept, "dropped": had - kept, "times": times, "rows": rows}


# Graphs over time: (t, i, j, w), an absent row is a weight of zero ---------------------------------------------------


def persistence(tedges: DataFrame, steps: int, threshold: float = 0.0) -> DataFrame:
    return tedges.groupBy("i", "j").agg((F.count_if(F.col("w") > threshold) / F.lit(float(steps))).alias("w"))


def mean(tedges: DataFrame, steps: int) -> DataFrame:
    return tedges.groupBy("i", "j").agg((F.sum("w") / F.lit(float(steps))).alias("w"))


def recency(tedges: DataFrame, steps: int, decay: float = 0.9) -> DataFrame:
    if not 0 < decay < 1:
        raise ValueError("the decay lies between 0 and 1")
    total = sum(decay ** (steps - 1 - t) for t in range(steps))
    return tedges.groupBy("i", "j").agg((F.sum(F.pow(F.lit(decay), F.lit(steps - 1) - F.col("t")) * F.col("w")) / F.lit(total)).alias("w"))


def volatility(tedges: DataFrame, steps: int) -> DataFrame:
    m = F.sum("w") / F.lit(float(steps))
    return tedges.groupBy("i", "j").agg(F.greatest(F.sum(F.col("w") * F.col("w")) / F.lit(float(steps)) - m * m, F.lit(0.0)).alias("w"))


def trend(tedges: DataFrame, steps: int) -> DataFrame:
    middle = (steps - 1) / 2
    spread = sum((t - middle) ** 2 for t in range(steps)) or 1.0
    return tedges.groupBy("i", "j").agg((F.sum((F.col("t") - F.lit(middle)) * F.col("w")) / F.lit(spread)).alias("w"))


def change_point(tedges: DataFrame, steps: int) -> DataFrame:
    """Largest step between neighbouring times, each pair's weights laid out as an array over all times."""
    own = tedges.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("m"))
    at = lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))
    if steps < 2:
        return own.select("i", "j", F.lit(0.0).alias("w"))
    jumps = F.transform(F.sequence(F.lit(0), F.lit(steps - 2)), lambda t: F.abs(at((t + 1).cast("int")) - at(t.cast("int"))))
    return own.select("i", "j", F.array_max(jumps).alias("w"))


AGGREGATIONS = {"persistence": persistence, "mean": mean, "recency": recency, "volatility": volatility, "trend": trend, "change_point": change_point}


def aggregated(tedges: DataFrame, steps: int, name: str, threshold: float = 0.0, **options) -> DataFrame:
    if name not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation '{name}'")
    return AGGREGATIONS[name](tedges, steps, **options).where(F.col("w") > threshold)


def time_slice(tedges: DataFrame, start: int, stop: int) -> DataFrame:
    return tedges.where((F.col("t") >= start) & (F.col("t") < stop)).withColumn("t", F.col("t") - start)


# Trajectories: observations (obs_id, entity, t) and one graph over all of them ---------------------------------------


def cross_time(edges: DataFrame, obs: DataFrame, threshold: float = 0.0) -> DataFrame:
    return _timed(edges, obs).where((F.col("w") > threshold) & (F.col("t_i") != F.col("t_j")))


def within_time(edges: DataFrame, obs: DataFrame, t: int, threshold: float = 0.0) -> DataFrame:
    return _timed(edges, obs).where((F.col("w") > threshold) & (F.col("t_i") == t) & (F.col("t_j") == t))


def _timed(edges: DataFrame, obs: DataFrame) -> DataFrame:
    of = lambda k: obs.select(F.col("obs_id").alias(k), F.col("entity").alias(f"entity_{k}"), F.col("t").alias(f"t_{k}"))
    return edges.join(of("i"), "i").join(of("j"), "j")


def trajectory_edges(obs: DataFrame) -> DataFrame:
    """(i, j): an entity's observations at t and t + 1."""
    w = Window.partitionBy("entity").orderBy("t", "obs_id")
    nxt = obs.select("obs_id", "t", F.lead("obs_id").over(w).alias("next_id"), F.lead("t").over(w).alias("next_t"))
    return nxt.where("next_t = t + 1").select(F.col("obs_id").alias("i"), F.col("next_id").alias("j"))


def sequences(states: DataFrame) -> DataFrame:
    """(entity, seq): an entity's states in the order of time; missing states are skipped."""
    rows = states.where(F.col("state").isNotNull()).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("t", "state"))).alias("s"))
    return rows.select("entity", F.col("s.state").alias("seq"))


def archetypes(states: DataFrame) -> DataFrame:
    """(sequence, members): different sequences by how many entities have them."""
    text = F.array_join(F.col("seq").cast("array<string>"), ">")
    return sequences(states).groupBy(text.alias("sequence")).agg(F.count(F.lit(1)).alias("members"))


def transitions(states: DataFrame) -> DataFrame:
    """(state, next_state, n): moves between neighbouring states of a sequence."""
    s = sequences(states)
    steps = F.when(F.size("seq") > 1, F.arrays_zip(F.slice("seq", 1, F.size("seq") - 1).alias("state"), F.slice("seq", 2, F.size("seq") - 1).alias("next_state")))
    return s.select(F.explode(steps).alias("x")).groupBy(F.col("x.state").alias("state"), F.col("x.next_state").alias("next_state")).agg(F.count(F.lit(1)).alias("n"))


def classify(states: DataFrame, method: str) -> DataFrame:
    """(entity, label) by complexity, transition or sequence."""
    s = sequences(states)
    n = F.size("seq")
    changes = F.when(n > 1, F.size(F.filter(F.zip_with(F.slice("seq", 1, n - 1), F.slice("seq", 2, n - 1), lambda a, b: a != b), lambda x: x))).otherwise(0)
    kinds = F.size(F.array_distinct("seq"))
    if method == "complexity":
        label = F.when(n <= 1, "Singleton (1 visit)").when(kinds == 1, "Stable (0 entropy)").when(changes < 2, "Gradual Transition").otherwise("Volatile / Refractory")
    elif method == "transition":
        rate = 1 - changes / (n - 1)
        label = F.when(n <= 1, "Insufficient Visits (<2)").when(rate >= 0.8, "High Self-Retention").when(rate >= 0.4, "Moderate Self-Retention").otherwise("Low Self-Retention")
    elif method == "sequence":
        label = F.when(n <= 1, "Singleton Path").when(kinds == 1, "Monostate Path").otherwise(F.concat(F.lit("Multistate Transitioning Path ("), kinds.cast("string"), F.lit(" states)")))
    else:
        raise ValueError(f"unknown classification '{method}'")
    return s.select("entity", label.alias("label"))


def sequence_distances(seqs: DataFrame, method: str = "levenshtein") -> DataFrame:
    """(a, b, distance) between different sequences, each written as characters; entities of one sequence are one class.

    Pairs are of distinct sequences, few against the entities; dynamic time warping counts unequal pairs on the path.
    """
    coded = seqs.select(F.array_join(F.transform("seq", lambda x: F.call_function("chr", x.cast("long") + 33)), "").alias("s")).distinct()
    a, b = coded.withColumnRenamed("s", "a"), coded.withColumnRenamed("s", "b")
    pairs = a.join(b, F.col("a") < F.col("b"))
    if method == "levenshtein":
        return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"))
    if method != "dtw":
        raise ValueError(f"unknown distance '{method}'")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            d = [dtw(x, y) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32())], names=["a", "b", "distance"])

    return pairs.mapInArrow(run, "a string, b string, distance int")


def dtw(x: str, y: str) -> int:
    row = [0] + [1 << 30] * len(y)
    for c in x:
        new = [1 << 30]
        for k, e in enumerate(y):
            new.append((c != e) + min(row[k], row[k + 1], new[k]))
        row = new
    return row[-1]
