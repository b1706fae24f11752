"""Signatures of a growing table of balls, kept by a stream.

Every micro-batch folds its balls into partial minima; minima of minima are minima, so batches may come in any order.
The state is a Parquet table for each batch, and the last one that was written whole counts: a stream that starts again
goes on from there, a batch that is delivered again changes nothing, and one that broke off is written anew. The table
before the last one stays until the next batch; older ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from coverlace.operators.graph import merge_signatures, signatures


class SignatureStream:
    def __init__(self, spark: SparkSession, folder: str, d: int = 256, seed: int = 42):
        self.spark, self.folder, self.d, self.seed, self.version = spark, folder.rstrip("/"), d, seed, -1
        fs = self._files()
        done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*/_SUCCESS")) or []
        self.version = max((int(x.getPath().getParent().getName()[1:]) for x in done), default=-1)

    def _files(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}") if self.version >= 0 else None

    def fold(self, balls: DataFrame, batch: int) -> None:
        if batch <= self.version:
            return
        new = signatures(balls, self.d, self.seed)
        old = self.current()
        (new if old is None else merge_signatures([old, new])).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        kept, self.version = self.version, batch
        for x in self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*")) or []:
            if int(x.getPath().getName()[1:]) < kept:
                self._files().delete(x.getPath(), True)

    def start(self, balls: DataFrame, checkpoint: str) -> StreamingQuery:
        """``balls`` is a streaming table of (ball, node_id)."""
        return balls.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
