"""Reading input tables, dense row identity, dataset handles, and exports."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlace.session import materialize


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its suffix (any case), else CSV with a header, inferred types and NA as null."""
    if not path:
        raise ValueError("no data path was given")
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True, nullValue="NA")


def with_node_id(df: DataFrame, *order: str, name: str = "node_id") -> DataFrame:
    """Dense ids from 0 in the order of ``order``, without bringing all rows into one partition.

    Rows are range-sorted and written; only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    free = lambda c: next(x for x in (f"{c}{k}" for k in range(len(df.columns) + 1)) if x not in df.columns)
    at, of, base = free("__at"), free("__part"), free("__base")
    placed = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "rows")
    part, place = F.shiftrightunsigned(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts = np.cumsum([0] + [c for _, c in counts])[:-1].tolist() if counts else []
    bases = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts)], f"{of} long, {base} long")
    joined = placed.withColumn(of, part).join(F.broadcast(bases), of)  # a row a partition
    return joined.select((F.col(base) + place).alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name])


# Handles of ingested files -------------------------------------------------------------------------------------------


def dataset_handle(path: str) -> dict:
    """Id, size and modification time of a local file; the id changes when the file does."""
    st = os.stat(path)
    key = f"{os.path.abspath(path)}:{st.st_size}:{st.st_mtime_ns}"
    return {"dataset_id": "ds_" + hashlib.sha256(key.encode()).hexdigest()[:12], "path": os.path.abspath(path), "size": st.st_size, "mtime_ns": st.st_mtime_ns}


def handle_is_current(handle: dict) -> bool:
    try:
        st = os.stat(handle["path"])
    except OSError:
        return False
    return (st.st_size, st.st_mtime_ns) == (handle["size"], handle["mtime_ns"])


class Upload:
    """A file sent in pieces; a byte-order mark at its start is dropped and the id follows from the content."""

    def __init__(self, folder: str, name: str):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.name = folder, os.path.basename(name)
        self.part = os.path.join(folder, f"{self.name}.part")
        open(self.part, "wb").close()

    def append(self, chunk: str | bytes) -> int:
        data = chunk.encode() if isinstance(chunk, str) else chunk
        if os.path.getsize(self.part) == 0 and data.startswith(b"\xef\xbb\xbf"):
            data = data[3:]
        with open(self.part, "ab") as f:
            f.write(data)
        return os.path.getsize(self.part)

    def finish(self) -> dict:
        with open(self.part, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()[:12]
        path = os.path.join(self.folder, f"{digest}_{self.name}")
        os.replace(self.part, path)
        return dataset_handle(path) | {"dataset_id": f"ds_{digest}"}


class RunStore:
    """Records of runs and cluster assignments as JSON files, replaced as a whole; writers wait for each other."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def save(self, kind: str, key: str, record: dict) -> str:
        path = os.path.join(self.folder, f"{kind}-{key}.json")
        with open(os.path.join(self.folder, ".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            with open(path + ".new", "w") as f:
                json.dump(record, f, sort_keys=True)
            os.replace(path + ".new", path)
        return path

    def load(self, kind: str, key: str) -> dict | None:
        try:
            with open(os.path.join(self.folder, f"{kind}-{key}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def keys(self, kind: str) -> list[str]:
        return sorted(x[len(kind) + 1 : -5] for x in os.listdir(self.folder) if x.startswith(f"{kind}-") and x.endswith(".json"))


# Exports -------------------------------------------------------------------------------------------------------------


def edge_table(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """source_id, target_id, weight (float): edges i < j above ``threshold``."""
    return edges.where(F.col("w") > threshold).select(F.col("i").cast("long").alias("source_id"), F.col("j").cast("long").alias("target_id"), F.col("w").cast("float").alias("weight"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree, val): number and summed weight of each node's edges, zero for lone nodes."""
    ends = edges.select(F.col("i").alias("node_id"), "w").unionByName(edges.select(F.col("j").alias("node_id"), "w"))
    sums = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("val"))
    return with_degrees(nodes, sums)


def with_degrees(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """(node_id, degree, val) of all nodes from those of nodes with edges."""
    return nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("val", F.lit(0.0)).alias("val"))


def node_table(nodes: DataFrame, edges: DataFrame | None, labels: DataFrame, archetypes: dict[int, str] | None = None, layout: DataFrame | None = None, passthrough: list[str] = (), degrees: DataFrame | None = None) -> DataFrame:
    """node_id, group_id, val, archetype, ex, ey, ez, is_live and the columns in ``passthrough``.

    A passthrough column whose name is taken gets the prefix ``src_``; ``layout`` holds (node_id, v), and ``degrees`` what
    ``node_degrees`` would find in ``edges``.
    """
    fixed = ["node_id", "group_id", "val", "archetype", "ex", "ey", "ez", "is_live"]
    names = F.create_map(*[F.lit(x) for k, v in (archetypes or {}).items() for x in (k, v)]) if archetypes else None
    out = (node_degrees(nodes, edges) if degrees is None else degrees).select("node_id", "val").join(labels.select("node_id", F.col("label").alias("group_id")), "node_id", "left")
    archetype = F.coalesce(names[F.col("group_id")] if names is not None else F.lit(None), F.concat(F.lit("Group "), F.col("group_id").cast("string")), F.lit("Ungrouped"))
    out = out.withColumn("archetype", archetype)
    if layout is None:
        out = out.withColumns({c: F.lit(0.0).cast("float") for c in ("ex", "ey", "ez")})
    else:
        out = out.join(layout.select("node_id", "v"), "node_id", "left")
        out = out.withColumns({c: F.coalesce(F.get("v", F.lit(k)), F.lit(0.0)).cast("float") for k, c in enumerate(("ex", "ey", "ez"))}).drop("v")
    out = out.withColumn("val", F.col("val").cast("float")).withColumn("is_live", F.lit(True))
    extra = nodes.select("node_id", *[F.col(c).alias(c if c not in fixed else f"src_{c}") for c in passthrough])
    return out.join(extra, "node_id") if passthrough else out


def group_table(labels: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """group_id, name, desc, member_ids (sorted)."""
    given = F.create_map(*[F.lit(x) for k, v in (names or {}).items() for x in (k, v)])[F.col("group_id")] if names else F.lit(None).cast("string")
    g = labels.groupBy(F.col("label").alias("group_id")).agg(F.sort_array(F.collect_list("node_id")).alias("member_ids"))
    size = F.size("member_ids").cast("string")
    return g.select("group_id", F.coalesce(given, F.concat(F.lit("Group "), F.col("group_id").cast("string"))).alias("name"), F.concat(size, F.lit(" members")).alias("desc"), "member_ids")


def export_bundle(folder: str, name: str, raw: DataFrame, clean: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame, threshold: float, config: dict) -> dict:
    """Write tabular and graph tables below ``folder/name`` and return the manifest with counts and the config's hash."""
    slug = "".join(c if c.isalnum() else "-" for c in name.lower()).strip("-")
    base = f"{folder.rstrip('/')}/{slug}"
    tables = {"tabular/raw": raw, "tabular/clean": clean, "graph/nodes": nodes, "graph/cosmic": edge_table(edges), "graph/edges": edge_table(edges, threshold), "graph/groups": groups}
    counts = {}
    spark = raw.sparkSession
    for part, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{part}.parquet")
        counts[part] = spark.read.parquet(f"{base}/{part}.parquet").count()
    text = json.dumps(config, sort_keys=True, default=str)
    manifest = {"name": name, "threshold": threshold, "counts": counts, "config_sha256": hashlib.sha256(text.encode()).hexdigest()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/manifest")
    return manifest


def labelled(rows: DataFrame, labels: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """``rows`` (with node_id) with topological_cluster_id and topological_cluster_name.

    Rows and labels must be of the same nodes, each once: labels of another run of the table are refused.
    """
    n, m = rows.count(), labels.count()
    met = rows.join(labels, "node_id").count()
    if not n == m == met:
        raise ValueError(f"{n} rows and {m} labels, of which {met} meet: the labels are not of this table")
    out = rows.join(labels.select("node_id", F.col("label").alias("topological_cluster_id")), "node_id", "left")
    given = F.create_map(*[F.lit(x) for k, v in (names or {}).items() for x in (k, v)])[F.col("topological_cluster_id")] if names else F.lit(None).cast("string")
    return out.withColumn("topological_cluster_name", F.coalesce(given, F.concat(F.lit("Cluster "), F.col("topological_cluster_id").cast("string")))).drop("node_id")


def centre_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node of the greatest summed weight, the least id on ties."""
    return node_degrees(nodes, edges).orderBy(F.desc("val"), "node_id").limit(1)


def ranked_within(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
