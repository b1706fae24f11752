"""Concatenate and cut: documents' ids in one stream, cut into fixed windows.

Pass one encodes each document once and writes, with its ids, where it starts within its partition. The partitions'
totals (one number each, all that reaches the driver) are summed into global offsets. Pass two cuts each document at
the windows' bounds; a boundary record is written for every piece. What is left after the last full window is cut into
windows of the powers of two that sum to it, so no sequence needs padding.

Cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces; other
columns are ignored. The order of the stream is that of the table's partitions.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlace.llm.bpe import piece_table
from coverlace.llm.common import EMPTY
from coverlace.session import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def _special(path: str) -> tuple[list[str], Callable[[str], bytes]]:
    """The tokenizer's added tokens, and its own encoding of texts that hold one."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if t.get_vocab_size() > 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    return [x.content for x in t.get_added_tokens_decoder().values()], lambda s: np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u2").tobytes()


EMPTY.append(_special.cache_clear)


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[bytes]:
    """Ids of whole texts as little-endian 16-bit integers, as the tokenizer in ``path`` gives them."""
    added, own = _special(path)
    special = {k: own(t) for k, t in enumerate(texts) if t and any(x in t for x in added)}
    plain = piece_table(path, pattern, "<u2").texts(["" if k in special else t for k, t in enumerate(texts)])
    return [special.get(k, x) for k, x in enumerate(plain)]


def encoded(docs: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """(part, local_start, doc_id, n, ids): ids as little-endian 16-bit integers with the end id."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            blobs = [x + end for x in encode_texts(batch.column("text").to_pylist(), path, pattern)]
            n = np.array([len(b) // 2 for b in blobs], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(blobs, pa.binary())], names=["part", "local_start", "doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, local_start long, doc_id long, n long, ids binary")


def window_bounds(total: int, width: int) -> tuple[int, np.ndarray]:
    """Number of full windows, and the starts of the tail's windows, ended by ``total``."""
    full, rest = divmod(total, width)
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return full, full * width + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)


def cut(start: int, n: int, width: int, full: int, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Global begins and ends, sequence ids and offsets of the pieces of ids ``start`` to ``start + n``."""
    end = start + n
    inner = np.arange((start // width + 1) * width, min(end, full * width + 1), width, dtype=np.int64)
    late = tail[(tail > start) & (tail < end)]
    begins = np.unique(np.concatenate(([start], inner[inner < end], late)))
    ends = np.append(begins[1:], end)
    in_tail = np.searchsorted(tail, begins, side="right") - 1
    seq = np.where(begins < full * width, begins // width, full + in_tail)
    offset = np.where(begins < full * width, begins % width, begins - tail[np.maximum(in_tail, 0)])
    return begins, ends, seq, offset


def cuts(start: np.ndarray, n: np.ndarray, width: int, full: int, tail: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of many documents: each piece's document, global begin and end, sequence id and offset."""
    first, last = start // width, (start + n - 1) // width
    # Documents that end within the full windows are cut at multiples of the width alone; the few others one by one.
    inside = start + n <= full * width
    k = np.where(inside, last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    seq = first[row] + nth
    begins, stops = np.maximum(seq * width, start[row]), np.minimum((seq + 1) * width, (start + n)[row])
    parts = [(row, begins, stops, seq, begins - seq * width)]
    for i in np.flatnonzero(~inside).tolist():
        b, e, s, o = cut(int(start[i]), int(n[i]), width, full, tail)
        parts.append((np.full(len(b), i), b, e, s, o))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*parts))


def pack(docs: DataFrame, path: str, pattern: str, width: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``width`` ids."""
    spark = docs.sparkSession
    tokens = materialize(encoded(docs, path, pattern, end_id), "tokens")
    totals = sorted(tokens.groupBy("part").agg(F.sum("n")).collect())  # one row a partition
    ends = np.cumsum([x[1] for x in totals], dtype=np.int64)
    total = int(ends[-1]) if totals else 0
    bases = spark.createDataFrame([(int(p), int(e - n)) for (p, n), e in zip(totals, ends)], "part int, base long")
    full, tail = window_bounds(total, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
            row, begins, stops, seq, offset = cuts(start, n, width, full, tail)
            ids = memoryview(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2").astype("<u4").tobytes())
            # Where a piece's ids stand in the batch.
            own, length = begins - start[row], stops - begins
            at = 4 * ((np.cumsum(n) - n)[row] + own)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            arrays = [batch.column("doc_id").take(pa.array(row)), pa.array(own), pa.array(length), pa.array(sums, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n", "ids")
    return placed.mapInArrow(run, PIECES)
