"""A sink for ``foreachBatch`` that takes every batch exactly once.

Spark may hand a batch out again: after a failure, or after a crash between the work and
its own commit. A batch is written to a folder of its own and becomes visible by a
ledger entry, written whole by a rename after all its rows. A batch that the ledger
has is not taken again; what a failed attempt left behind is replaced and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddspark.sources.paths import Folder

LEDGER = "_ledger"


class OnceSink:
    """Rows at ``path``, appended by batches of the query ``name``; several queries may share a path."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.folder, self.name = spark, Folder(spark, path), name

    def _batch(self, batch_id: int) -> str:
        return f"{batch_id:012d}"

    def taken(self, batch_id: int) -> bool:
        return self.folder.exists(LEDGER, self.name, self._batch(batch_id))

    def begin(self, batch_id: int) -> None:
        """Forget what an attempt that was never committed has left."""
        self.folder.delete(self.name, self._batch(batch_id))

    def add(self, rows: DataFrame, batch_id: int, part: str) -> None:
        """Write a part of a batch; not visible before ``commit``."""
        rows.write.mode("errorifexists").parquet(self.folder.at(self.name, self._batch(batch_id), part))

    def commit(self, batch_id: int) -> None:
        self.folder.replace_text(self.name, LEDGER, self.name, self._batch(batch_id))

    def _parts(self, name: str, batch: str) -> list[str]:
        return [self.folder.at(name, batch, p) for p in self.folder.folders(name, batch)]

    def read(self, open_batch: int | None = None) -> DataFrame | None:
        """Rows of all committed batches, and of the batch being written; None if there are none."""
        paths = []
        for name in self.folder.folders():
            if name == LEDGER:
                continue
            for batch in self.folder.folders(name):
                own = name == self.name and open_batch is not None and batch == self._batch(open_batch)
                if own or self.folder.exists(LEDGER, name, batch):
                    paths += self._parts(name, batch)
        return self.spark.read.parquet(*paths) if paths else None
