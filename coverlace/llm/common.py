"""What the corpus operators share: reading, cheap sizes, packed exchange of arrays between shards and buckets."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts (a scan and a sum)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def sharded(docs: DataFrame, n_shards: int, carry: list[str] | None = None) -> DataFrame:
    """(shard, doc_id, text, and the columns in ``carry`` as one struct): shards are even whatever the ids are, and a
    row's shard depends on the row alone."""
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def n_shards_for(total_bytes: int, shard_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / shard_bytes))


def pack6(values: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    v = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(v[:, :6]).tobytes()


def unpack6(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def text_list(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as differences of as many bytes as the largest needs. The last byte of all, then the ones before
    it, stand together; the upper ones, which are small, are compressed. A head tells width, plain bytes and number."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    columns = np.ascontiguousarray(np.ascontiguousarray(steps, "<u8").view(np.uint8).reshape(-1, 8).T[:width])
    plain = max(0, int(np.median(steps)).bit_length() // 8 - 1) if len(steps) else 0
    return bytes([width, plain]) + len(steps).to_bytes(6, "little") + columns[:plain].tobytes() + pa.compress(columns[plain:].tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(blob: bytes) -> np.ndarray:
    width, plain, n = blob[0], blob[1], int.from_bytes(blob[2:8], "little")
    out = np.zeros((8, n), np.uint8)
    out[:plain] = np.frombuffer(blob, np.uint8, plain * n, 8).reshape(plain, n)
    rest = pa.decompress(memoryview(blob)[8 + plain * n :], decompressed_size=(width - plain) * n, codec="zstd", asbytes=True)
    out[plain:width] = np.frombuffer(rest, np.uint8).reshape(width - plain, n)
    return np.cumsum(np.ascontiguousarray(out.T).view("<u8").ravel(), dtype=np.uint64)


#: What empties tables that operators keep in a worker between tasks of one stage.
EMPTY: list[Callable[[], None]] = []


def release() -> None:
    """Give memory back to the system, as a worker serves many groups and stages: other operators' tables and what is
    freed."""
    for empty in EMPTY:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def releasing_batches(of: Callable) -> Callable:
    """``of`` for batches, after which freed memory is given back."""

    def run(batches):
        try:
            yield from of(batches)
        finally:
            release()

    return run


def releasing(of: Callable) -> Callable:
    """``of`` for one group, after which freed memory is given back."""

    def run(*tables):
        try:
            return of(*tables)
        finally:
            release()

    # Spark counts the parameters.
    return (lambda t: run(t)) if of.__code__.co_argcount == 1 else (lambda t, told: run(t, told))
