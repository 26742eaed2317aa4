"""Change detection on each arriving snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oddspark.operators import snapshots as N
from oddspark.streaming.once import OnceSink


def run_cycle(
    spark: SparkSession, scored: DataFrame, snapshot_path: str, when: str, users: DataFrame, tracked: DataFrame,
    bias: DataFrame | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    """Store the snapshot, compare it with the previous one, return the notifications to append.

    The first cycle has nothing to compare with and yields none. Running a date
    again replaces its partition and re-sends nothing already in ``existing``.
    """
    N.write_snapshot(N.snapshot_rows(scored, when), snapshot_path)
    snapshots = spark.read.parquet(snapshot_path)
    current = N.read_snapshot(snapshots, when)
    previous = N.previous_snapshot(snapshots, when)
    changes = N.detect_changes(previous, current)
    first = previous.limit(1).count() == 0
    if first:
        changes = changes.where(F.lit(False))
    if bias is not None:
        changes = N.annotate_changes(changes, bias)
    return N.notifications(changes, tracked, users, existing, created_at=f"{when} 00:00:00")


def change_batches(snapshot_path: str, notes_path: str, users: DataFrame, tracked: DataFrame, name: str = "changes") -> Callable[[DataFrame, int], None]:
    """What to do with each batch of ``(snapshot_date, ...)`` rows: one cycle a date, oldest first, its notifications stored once.

    A date that comes late is compared with the snapshot before it, and leaves later
    ones as they are. A batch that comes again adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sink = OnceSink(spark, notes_path, name)
        if sink.taken(batch_id):
            return
        sink.begin(batch_id)
        batch = batch.persist()  # read once for the dates and once for each of them
        try:
            for (day,) in batch.select("snapshot_date").distinct().orderBy("snapshot_date").collect():
                scored = batch.where(F.col("snapshot_date") == F.lit(day)).drop("snapshot_date")
                fresh = run_cycle(spark, scored, snapshot_path, str(day), users, tracked, existing=sink.read(batch_id))
                sink.add(fresh, batch_id, str(day))
            sink.commit(batch_id)
        finally:
            batch.unpersist()

    return handle


def start_change_stream(
    arrivals: DataFrame, snapshot_path: str, notes_path: str, checkpoint: str, users: DataFrame, tracked: DataFrame, name: str = "changes",
) -> StreamingQuery:
    """Process scored tables arriving as a stream of ``(snapshot_date, ...)`` rows; see :func:`change_batches`."""
    handle = change_batches(snapshot_path, notes_path, users, tracked, name)
    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
