"""Versioned tables: written whole under a version, published by one rename, read pinned to a version.

``root/<version>/<layout>`` holds the rows of a version, once for each layout, sorted by
the layout's columns in ranges, so that a filter on the first of them is settled by the
minima and maxima of files and row groups. ``root/_current`` names the version that
readers get. It is replaced by an atomic rename after all layouts are complete: a reader
sees the old version or the new one, and one that has begun keeps the version it began
with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from oddspark.sources.paths import Folder

POINTER = "_current"
#: Rows of a version before they are sorted; gone when it is complete.
DRAFT = "_draft"


class StoredTable:
    """A table at ``root`` with layouts ``{name: [columns to sort by]}``; the first layout is the default."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, list[str]]):
        self.spark, self.folder, self.layouts = spark, Folder(spark, root), layouts

    def versions(self) -> list[str]:
        """Versions of which all layouts are complete, oldest first."""
        return [v for v in self.folder.folders() if all(self.folder.exists(v, layout, "_SUCCESS") for layout in self.layouts)]

    def current(self) -> str | None:
        """The published version, or None if there is none yet."""
        return self.folder.read_text(POINTER)

    def write(self, rows: DataFrame, files: int | None = None) -> str:
        """Write a new version that no reader sees yet, and name it. ``files`` fixes the ranges of a layout; else sizes decide."""
        last = self.versions()[-1:]
        version = f"{int(last[0].split('-')[0]) + 1 if last else 1:08d}-{uuid.uuid4().hex[:8]}"
        draft = self.folder.at(version, DRAFT)
        rows.write.parquet(draft)  # computed once: ranges are drawn from a sample, which would compute the rows a second time
        source = self.spark.read.schema(rows.schema).parquet(draft)
        for layout, order in self.layouts.items():
            where = self.folder.at(version, layout)
            source.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).write.parquet(where)
        self.folder.delete(version, DRAFT)
        return version

    def point(self, version: str) -> None:
        """Make a complete version the current one, also an earlier one again."""
        if version not in self.versions():
            raise ValueError(f"{self.folder.root} has no complete version {version}")
        self.folder.replace_text(version, POINTER)

    def publish(self, rows: DataFrame, files: int | None = None) -> str:
        version = self.write(rows, files)
        self.point(version)
        return version

    def read(self, layout: str | None = None, version: str | None = None) -> DataFrame:
        """The rows of a version, by default of the one that is current now; later publications do not change them."""
        pinned = version or self.current()
        if pinned is None:
            raise FileNotFoundError(f"{self.folder.root} has no published version")
        return self.spark.read.parquet(self.folder.at(pinned, layout or next(iter(self.layouts))))

    def retire(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` versions and the current one; gives the removed ones."""
        current = self.current()
        gone = [v for v in self.versions()[: -keep or None] if v != current]
        for version in gone:
            self.folder.delete(version)
        return gone
