"""Chroma fingerprints of audio columns, and their alignment.

A recording's spectrum is folded into twelve pitch classes per frame. An integral image over frames and classes gives the
sums under the filters' rectangles in four look-ups each; every filter compares two areas and yields two bits (Gray
coded), and the filters' bits are packed into one integer per frame. Recordings align where many of their frames have
equal integers at one offset: equal integers vote for (query, recording, offset), and the best offset of each pair is
then compared bit by bit over the whole overlap.

Only different recordings are indexed: rows with equal media are one class. The queries go to all tasks, some at a time, and
each task counts the votes of its own recordings, so no integer is too common to vote; equal integers in a row vote as runs.

Cases: null or empty media have no frames and no matches; shorter recordings than a filter have none either; repeated
rows share a class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlace.session import materialize

RATE = 4096
FRAME, HOP = 1024, 256
LOWEST, HIGHEST = 110.0, 1760.0
#: (kind, first class, classes, frames): areas compared by halves of frames, halves of classes, or a middle and its sides.
FILTERS = [("time", 0, 3, 8), ("class", 4, 4, 4), ("middle", 2, 6, 9), ("time", 6, 4, 12), ("class", 0, 12, 8), ("time", 9, 3, 4), ("class", 6, 6, 12), ("middle", 0, 12, 12), ("time", 3, 3, 12), ("class", 8, 4, 8), ("time", 0, 12, 6), ("middle", 6, 6, 6), ("class", 2, 4, 12), ("time", 5, 5, 8), ("class", 0, 6, 6), ("middle", 3, 9, 8)]
#: Bounds between the four values of a filter's log ratio.
BOUNDS = np.array([-0.15, 0.0, 0.15])
SPAN = max(f[3] for f in FILTERS)
#: Frames of queries that are sent to the tasks at a time, about, and pairs of runs or frames that a task holds.
QUERY_FRAMES, HITS = 1 << 21, 1 << 20
ALIGNED = "query long, match long, offset int, votes long, overlap int, bit_error double, match_copies long"
MIN_VOTES, MAX_ERROR = 4, 0.25
#: Recordings that are rendered at a time.
RENDERED = 64


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame scaled to unit length."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.arange(power.shape[1]) * RATE / FRAME
    heard = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    fold = np.zeros((len(heard), 12))
    fold[np.arange(len(heard)), np.round(12 * np.log2(hertz[heard] / 440.0)).astype(int) % 12] = 1
    out = power[:, heard] @ fold
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0.0)


def integral(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    return out


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer per frame at which all filters fit."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total, t = integral(image), np.arange(n)

    def area(t0, t1, c0, c1):
        return total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]

    out = np.zeros(n, np.int64)
    for kind, c, classes, frames in FILTERS:
        if kind == "time":
            a, b = area(0, frames // 2, c, c + classes), area(frames // 2, frames, c, c + classes)
        elif kind == "class":
            a, b = area(0, frames, c, c + classes // 2), area(0, frames, c + classes // 2, c + classes)
        else:
            third = frames // 3
            a = area(third, frames - third, c, c + classes)
            b = area(0, frames, c, c + classes) - a
        value = np.searchsorted(BOUNDS, np.log((a + 1e-3) / (b + 1e-3)))
        out = out << 2 | (value ^ value >> 1)
    return out


def samples_of(media: bytes | None) -> np.ndarray:
    """Samples of a media cell: little-endian 16-bit mono at RATE."""
    media = media or b""
    return np.frombuffer(media, "<i2", count=len(media) // 2)


def rendered(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(id, media): each vector played as a tune, a note of an eighth of a second per value.

    Stands in for a table of recordings; equal vectors give equal bytes.
    """
    note = RATE // 8
    time = np.arange(note) / RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, RENDERED):
                batch, media = whole.slice(at, RENDERED), []
                for v in batch.column(values).to_pylist():
                    x = np.array([0.0 if y is None else y for y in v or []])
                    pitch = 220.0 * 2 ** (np.clip(np.round(x * 48), -12, 24) / 12)
                    sound = np.sin(2 * np.pi * pitch[:, None] * time) + 0.4 * np.sin(4 * np.pi * pitch[:, None] * time)
                    media.append((sound.ravel() * 8000).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])

    return vectors.select(key, values).mapInArrow(run, "id long, media binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(id, digest, codes): digest tells equal media, codes holds an integer per frame."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            codes = [fingerprint(chroma(samples_of(m))) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([hashlib.blake2b(m or b"", digest_size=16).hexdigest() for m in media]), pa.array(codes, pa.list_(pa.int64()))], names=["id", "digest", "codes"])

    return recordings.mapInArrow(run, "id long, digest string, codes array<long>")


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all rows in a row, and where each row's begin (and the last one's end)."""
    if isinstance(codes, pa.ChunkedArray):
        codes = pa.concat_arrays(codes.chunks) if codes.num_chunks else pa.array([], codes.type)
    return codes.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def _runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal codes: code, row, first frame in the row, and length."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), (codes[1:] != codes[:-1]) | (row[1:] != row[:-1]))))
    return codes[at], row[at], at - starts[row[at]], np.diff(np.append(at, len(codes)))


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number of it, for ``count`` numbers from each of ``first``."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


class Queries:
    """Recordings asked for, with their runs of equal codes in order of the codes."""

    def __init__(self, rec: np.ndarray, codes: np.ndarray, starts: np.ndarray):
        self.rec, self.codes, self.starts = rec, codes, starts
        code, row, first, size = _runs(codes, starts)
        order = np.argsort(code, kind="stable")
        self.code, self.row, self.first, self.size = code[order], row[order], first[order], size[order]

    def best(self, row: np.ndarray, first: np.ndarray, size: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query, row, votes and offset of the best offset of every pair with MIN_VOTES votes there, from pairs of runs.

        The votes of two runs rise, stay and fall over the offsets by one a step, so four changes of slope say all of them;
        the most votes stand just before a change of slope.
        """
        q, q_first, q_size = self.row[run], self.first[run], self.size[run]
        pair = row * len(self.rec) + q
        ids, of = np.unique(pair, return_inverse=True)
        use = (np.bincount(of, weights=size * q_size) >= MIN_VOTES)[of]  # no offset has more votes than all together
        pair, lo, q_size, size = pair[use], (first - q_first - q_size + 1)[use], q_size[use], size[use]
        ids = np.unique(pair)
        bend = np.concatenate([lo, lo + size, lo + q_size, lo + size + q_size, np.ones(len(ids), np.int64)])  # offset 0 wins ties
        turn = np.concatenate([np.repeat([1, -1, -1, 1], len(lo)), np.zeros(len(ids), np.int64)])
        pair = np.concatenate([pair, pair, pair, pair, ids])
        order = np.lexsort((bend, pair))
        bend, turn, pair = bend[order], turn[order], pair[order]
        votes, offset = bend * np.cumsum(turn) - np.cumsum(turn * bend), bend - 1
        votes, offset, pair = (x[votes >= MIN_VOTES] for x in (votes, offset, pair))
        order = np.lexsort((offset, np.abs(offset), -votes, pair))
        votes, offset, pair = votes[order], offset[order], pair[order]
        top = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
        return pair[top] % len(self.rec), pair[top] // len(self.rec), votes[top], offset[top]

    def aligned(self, rec: np.ndarray, codes: np.ndarray, starts: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of ALIGNED for recordings, about HITS pairs of runs or frames at a time."""
        code, row, first, size = _runs(codes, starts)
        lo = np.searchsorted(self.code, code)
        hits = np.searchsorted(self.code, code, "right") - lo
        for a, b in _portions(np.bincount(row, weights=hits, minlength=len(rec))):
            x, y = np.searchsorted(row, (a, b))
            of, run = _spread(lo[x:y], hits[x:y])
            of += x
            other = rec[row[of]] != self.rec[self.row[run]]
            q, m, votes, offset = self.best(row[of[other]], first[of[other]], size[of[other]], run[other])
            begin = np.maximum(0, -offset)
            overlap = np.minimum(np.diff(self.starts)[q], np.diff(starts)[m] - offset) - begin
            for c, d in _portions(overlap):
                pair, at = _spread(begin[c:d], overlap[c:d])
                pair += c
                bits = np.bitwise_count(self.codes[self.starts[q[pair]] + at] ^ codes[starts[m[pair]] + at + offset[pair]])
                error = np.bincount(pair - c, weights=bits, minlength=d - c) / (32.0 * overlap[c:d])
                k = c + np.flatnonzero(error <= MAX_ERROR)
                cols = [self.rec[q[k]], rec[m[k]], offset[k].astype(np.int32), votes[k], overlap[k].astype(np.int32), error[k - c], copies[m[k]]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["query", "match", "offset", "votes", "overlap", "bit_error", "match_copies"])


def _portions(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about HITS together, one row at least."""
    part = (np.cumsum(weights) - weights) // HITS
    cuts = np.flatnonzero(np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1])))
    return zip(cuts.tolist(), np.append(cuts[1:], len(part)).tolist())


def alignments(prints: DataFrame, every: int = 20) -> DataFrame:
    """query, match, offset (frames), votes, overlap, bit_error: pairs of classes of equal media, where the query's class
    holds an id divisible by ``every``; with class sizes and the queries' class ids as the least id of each class."""
    prints = materialize(prints, "codes")
    classes = prints.groupBy("digest").agg(F.min("id").alias("rec"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"), F.count(F.lit(1)).alias("copies"), F.first("codes").alias("codes"))
    classes = materialize(classes.select("rec", "asks", "copies", "codes"), "recordings")
    frames = classes.where("asks = 1").agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks, found = -(-frames // QUERY_FRAMES), []
    for k in range(blocks):
        # About QUERY_FRAMES frames, so they may be sent to all tasks.
        own = classes.where((F.col("asks") == 1) & (F.size("codes") > 0) & (F.pmod(F.xxhash64("rec"), F.lit(blocks)) == k)).select("rec", "codes").toArrow()
        told = prints.sparkSession.sparkContext.broadcast(Queries(own["rec"].to_numpy(), *_flat(own["codes"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from told.value.aligned(batch.column("rec").to_numpy(), *_flat(batch.column("codes")), batch.column("copies").to_numpy())

        found.append(materialize(classes.select("rec", "codes", "copies").mapInArrow(run, ALIGNED), "aligned"))
        told.unpersist()
    return reduce(DataFrame.unionByName, found) if found else prints.sparkSession.createDataFrame([], ALIGNED)


def searches(recordings: DataFrame, every: int = 20) -> DataFrame:
    """One row per recording: id, class_id (least id with equal media), n_frames, fingerprint digest, and the class's
    aligned classes as a sorted list; queries are the ids divisible by ``every``."""
    prints = materialize(fingerprints(recordings), "prints")
    found = alignments(prints, every)
    lists = found.groupBy(F.col("query").alias("class_id")).agg(F.sort_array(F.collect_list(F.struct("match", "offset", "votes", "overlap", F.round("bit_error", 6).alias("bit_error")))).alias("aligned"))
    own = prints.withColumn("class_id", F.min("id").over(Window.partitionBy("digest")))
    out = own.select("id", "class_id", F.size("codes").cast("long").alias("n_frames"), F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256).alias("codes_sha256"), (F.col("id") % every == 0).alias("is_query"))
    return out.join(lists, "class_id", "left").select("id", "class_id", "n_frames", "codes_sha256", "is_query", F.when(F.col("is_query"), F.coalesce("aligned", F.array().cast("array<struct<match:bigint,offset:int,votes:bigint,overlap:int,bit_error:double>>"))).alias("aligned"))
