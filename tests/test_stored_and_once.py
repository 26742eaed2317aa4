"""Versioned tables and their readers, the exactly-once sink under replay and failure, tracked lists as a stream."""

import pytest
from pyspark.sql import functions as F

from oddspark.operators import snapshots as N
from oddspark.plans import load
from oddspark.sources.stored import StoredTable
from oddspark.streaming import changes, once, tracked, usage
from tests.conftest import DATA
from tests.test_snapshots_and_streams import NEW, OLD, folder, scored, users
from tests.test_snapshots_and_streams import tracked as lists

LAYOUTS = {"by_drug": ["drug", "reaction_pt"], "by_reaction": ["reaction_pt", "drug"]}


def rows_read(df):
    """Rows that the scan of a plan without shuffles gave."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value(), leaf.toString()


def test_versions_pin_readers_and_filters_prune(spark):
    table = StoredTable(spark, folder() + "/t", LAYOUTS)
    assert table.current() is None and table.versions() == []
    with pytest.raises(FileNotFoundError):
        table.read()
    make = lambda base: spark.range(4000).select((F.col("id") % 40).cast("string").alias("drug"), F.col("id").cast("string").alias("reaction_pt"), (F.col("id") + base).alias("a"))
    first = table.publish(make(0), files=8)
    old = table.read()
    draft = table.write(make(7), files=8)
    assert table.current() == first and table.read().agg(F.min("a")).first()[0] == 0
    table.point(draft)
    assert table.read().agg(F.min("a")).first()[0] == 7 and old.agg(F.min("a")).first()[0] == 0
    assert table.read(version=first).count() == table.read("by_reaction").count() == 4000
    for layout, wanted in (("by_drug", "drug = '17'"), ("by_reaction", "reaction_pt = '1234'")):
        n, scan = rows_read(table.read(layout).where(wanted))
        assert 0 < n <= 1500 and "PushedFilters: [IsNotNull(" in scan and "EqualTo(" in scan
    table.point(first)
    assert table.retire(keep=1) == [] and table.retire(keep=0) == [draft] and table.read().count() == 4000
    with pytest.raises(ValueError):
        table.point(draft)


@pytest.mark.parametrize("name", ["compare_two", "drug_profile", "reaction_profile"])
def test_serving_reads_the_stored_table(spark, name):
    df = load().QUERIES[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "stored-" in plan and "lineitem" not in plan and "PushedFilters: [IsNotNull(" in plan


def arrivals(spark, source):
    return spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)


def key(df):
    return sorted((r.user_id, r.drug, r.reaction_pt, r.kind, r.detail, str(r.created_at)) for r in df.collect())


def test_change_stream_equals_batch_through_failure_and_replay(spark, monkeypatch):
    source, base = folder(), folder()
    days = {"2024-01-01": OLD, "2024-01-02": NEW}
    for day, rows in days.items():
        scored(spark, *rows).withColumn("snapshot_date", F.lit(day).cast("date")).coalesce(1).write.mode("append").parquet(source)
    places = (base + "/snap", base + "/notes", base + "/check")
    commit, broken = once.OnceSink.commit, []

    def fail_once(self, batch_id):
        if batch_id == 1 and not broken:
            broken.append(batch_id)
            raise RuntimeError("lost before the ledger entry")
        commit(self, batch_id)

    monkeypatch.setattr(once.OnceSink, "commit", fail_once)
    start = lambda: changes.start_change_stream(arrivals(spark, source), *places, users(spark), lists(spark)).awaitTermination(180)
    with pytest.raises(Exception, match="lost before the ledger entry"):
        start()
    sink = once.OnceSink(spark, places[1], "changes")
    assert broken == [1] and sink.taken(0) and not sink.taken(1) and sink.read().count() == 0
    start()
    before, after = (N.snapshot_rows(scored(spark, *rows), day) for day, rows in days.items())
    want = key(N.notifications(N.detect_changes(before, after), lists(spark), users(spark), created_at="2024-01-02 00:00:00"))
    assert key(sink.read()) == want and len(want) == 6
    # the same batch again, as after a crash behind the ledger entry; then its rows under a new number
    handle = changes.change_batches(*places[:2], users(spark), lists(spark))
    again = scored(spark, *NEW).withColumn("snapshot_date", F.lit("2024-01-02").cast("date"))
    handle(again, 1)
    handle(again, 2)
    assert key(sink.read()) == want


def test_late_dates_are_compared_with_the_one_before(spark):
    base = folder()
    handle = changes.change_batches(base + "/snap", base + "/notes", users(spark), lists(spark))
    dated = lambda rows, day: scored(spark, *rows).withColumn("snapshot_date", F.lit(day).cast("date"))
    handle(dated(OLD, "2024-01-01").unionByName(dated(OLD, "2024-01-05")), 0)
    handle(dated(NEW, "2024-01-03"), 1)
    notes = once.OnceSink(spark, base + "/notes", "changes").read()
    assert notes.count() == 6 and {str(r[0]) for r in notes.select("created_at").distinct().collect()} == {"2024-01-03 00:00:00"}


def test_backlog_stream_equals_batch(spark):
    source = folder()
    log = spark.read.parquet(f"{DATA}/events.parquet").select(
        F.col("event_type").alias("drug_query"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("matched_drug"), F.col("ts").cast("timestamp").alias("created_at")
    )
    log.write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    q = usage.unmatched_backlog(stream).writeStream.format("memory").queryName("backlog").option("checkpointLocation", folder()).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(str(r.day), r.term): r.n for r in spark.table("backlog").collect()}
    days = log.where("matched_drug is null").groupBy(F.to_date("created_at").alias("day"), F.lower("drug_query").alias("term")).count().collect()
    want = {(str(r["day"]), r["term"]): r["count"] for r in days}
    assert got and got.items() <= want.items() and {k for k in want if k not in got} <= {k for k in want if k[0] >= "2024-01-29"}


EVENTS = "user_id long, drug string, action string, at timestamp, seq long"


def run_lists(spark, batches, **kw):
    """All that the stream gives for batches of events, one file and one run each."""
    source, out, check = folder(), folder() + "/out", folder()
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        handle = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        tracked.tracked_lists(stream, **kw).writeStream.foreachBatch(handle).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(out)


def test_tracked_lists_stream_equals_batch(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(
        F.col("user_id").cast("long").alias("user_id"), F.col("event_type").alias("drug"), F.when(F.col("value") < 20, "remove").otherwise("add").alias("action"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"),
    )
    many = spark.range(45).select(F.lit(-1).cast("long").alias("user_id"), F.format_string("d%02d", "id").alias("drug"), F.lit("add").alias("action"), F.timestamp_seconds(F.lit(1706000000) + F.col("id")).alias("at"), F.col("id").alias("seq"))
    whole = events.unionByName(many)
    half = F.xxhash64("seq", "user_id") % 2 == 0
    # rows of the second half are older and newer than those of the first
    given = run_lists(spark, [whole.where(half), whole.where(~half)], late="90 days")
    rows = lambda df: sorted((r.user_id, r.drug, str(r.added_at)) for r in df.collect())
    want = N.tracked_state(whole)
    assert rows(tracked.latest_lists(given)) == rows(want) and want.where("user_id = -1").count() == 40


def test_idle_lists_are_evicted_by_their_timer(spark):
    day = lambda *events: spark.createDataFrame([(u, d, a, s, s) for u, d, a, s in events], "user_id long, drug string, action string, s long, seq long").select("user_id", "drug", "action", F.timestamp_seconds("s").alias("at"), "seq")
    given = run_lists(spark, [day((1, "x", "add", 100), (2, "y", "add", 100)), day((2, "z", "add", 5000)), day((2, "y", "remove", 9000))], idle_seconds=3600, late="1 second")
    assert {(r.user_id, r.drug) for r in tracked.latest_lists(given).collect()} == {(2, "z")}
    evicted = given.where("user_id = 1 and drug is null").collect()
    assert len(evicted) == 1 and evicted[0].as_of_us == 3700 * 1_000_000 + 1000
