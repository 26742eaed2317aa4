import tempfile

from pyspark.sql import functions as F

from oddspark.operators import snapshots as N
from oddspark.operators import usage as U
from oddspark.streaming import changes, usage
from tests.conftest import DATA


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


SCORED = "drug string, reaction_pt string, a long, IC025 double, tier string, labelled boolean"


def scored(spark, *rows):
    return spark.createDataFrame(list(rows), SCORED)


def users(spark):
    return spark.createDataFrame([(1, True, True, True), (2, True, True, False), (3, False, True, True), (4, True, False, True)], "user_id long, notify_opt_in boolean, is_active boolean, email_verified boolean")


def tracked(spark):
    return spark.createDataFrame([(u, "d") for u in (1, 2, 3, 4)], "user_id long, drug string")


OLD = [("d", "R1", 5, 0.4, "weak", False), ("d", "R2", 9, 1.2, "moderate", None), ("d", "GONE", 9, 2.2, "strong", True), ("d", "R5", 9, 1.2, "moderate", False)]
NEW = [
    ("d", "R1", 1234, 1.4, "moderate", True), ("d", "R2", 9, 1.3, "moderate", True), ("d", "R3", 7, 2.5, "strong", None),
    ("d", "R4", 7, 0.5, "weak", None), ("d", "R5", 9, 1.9, "moderate", None), ("d", "R6", 1, 0.5, "none", None),
]


def test_changes(spark):
    before, after = N.snapshot_rows(scored(spark, *OLD), "2024-01-01"), N.snapshot_rows(scored(spark, *NEW), "2024-01-02")
    got = {(r["reaction_pt"], r["kind"]): r for r in N.detect_changes(before, after).collect()}
    assert set(got) == {("R1", "strengthened"), ("R1", "newly_labelled"), ("R3", "new_signal")}
    assert got["R1", "strengthened"]["detail"] == "from weak to moderate on 1,234 reports"
    assert got["R3", "new_signal"]["prev_ic025"] is None


def test_cycle_is_idempotent(spark):
    path = folder() + "/snap"
    run = lambda rows, day, old=None: changes.run_cycle(spark, scored(spark, *rows), path, day, users(spark), tracked(spark), existing=old)
    assert run(OLD, "2024-01-01").count() == 0
    first = run(NEW, "2024-01-02").collect()
    assert {r["user_id"] for r in first} == {1, 2} and len(first) == 6
    sent = spark.createDataFrame(first, N.notifications(N.detect_changes(*[N.snapshot_rows(scored(spark, *OLD), "2024-01-01")] * 2), tracked(spark), users(spark)).schema)
    assert run(NEW, "2024-01-02", sent).count() == 0
    assert spark.read.parquet(path).groupBy("snapshot_date").count().count() == 2
    assert spark.read.parquet(path).where("snapshot_date = '2024-01-02'").count() == 5
    digest = N.digests(sent, users(spark)).collect()
    assert [(r["user_id"], r["items"]) for r in digest] == [(1, 3)]
    marks = sent.select("user_id", "drug", "reaction_pt", "kind", F.lit("2024-01-03").cast("timestamp_ntz").alias("at"))
    read = N.stamp_latest(sent, marks, "read_at")
    assert U.unread_per_user(read).count() == 0 and U.notification_kpis(read).first()["notifications_unread"] == 0


def test_since_date_allows_a_repeat(spark):
    change = spark.createDataFrame([("d", "R", "new_signal", "x", 2.0, None)], "drug string, reaction_pt string, kind string, detail string, ic025 double, prev_ic025 double")
    old = spark.createDataFrame([(1, "d", "R", "new_signal", "2020-01-01")], "user_id long, drug string, reaction_pt string, kind string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    assert N.notifications(change, tracked(spark), users(spark), old).count() == 1
    assert N.notifications(change, tracked(spark), users(spark), old, since="2021-01-01").count() == 2


def test_clear_history_and_counters(spark):
    log = spark.createDataFrame([(1, 10), (1, 30), (2, 10)], "user_id long, created_at long")
    cleared = spark.createDataFrame([(1, 20)], "user_id long, cleared_at long")
    assert sorted((r[0], r[1]) for r in N.clear_history(log, cleared).select("user_id", "created_at").collect()) == [(1, 30), (2, 10)]
    a = spark.createDataFrame([("2024-01-01", "x", 2)], "day string, metric string, value long")
    assert U.add_counters(a, a.withColumn("metric", F.explode(F.array(F.lit("x"), F.lit("y"))))).count() == 2


def _stream(spark):
    path = f"{DATA}/events.parquet"
    batch = spark.read.parquet(path)
    # The watermark needs a zoned timestamp; the session runs in UTC.
    source = folder()
    batch.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("overwrite").parquet(source)
    return batch, spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)


def _drain(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder()).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_daily_counters_stream_equals_batch(spark):
    batch, stream = _stream(spark)
    got = {(str(r["day"]), r["metric"]): r["value"] for r in _drain(usage.daily_counters(stream), "daily", spark).collect()}
    want = {(str(r["day"]), r["metric"]): r["value"] for r in U.daily_counters(batch).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert {k for k in want if k not in got} <= {k for k in want if k[0] >= "2024-01-29"}  # days the watermark has not closed


def test_sessions_and_sliding_stream(spark):
    batch, stream = _stream(spark)
    got = {tuple(r) for r in _drain(usage.sessions(stream, gap="8 hours"), "sess", spark).collect()}
    whole = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in U.search_sessions(whole, gap="8 hours").collect()}
    assert got and got <= want
    rates = _drain(usage.sliding_rate(stream, "user_id", "ts", "1 day", "6 hours"), "rates", spark)
    assert rates.count() > 0


def test_trailing_rate_stream_equals_batch(spark):
    batch, stream = _stream(spark)
    got = sorted((r["client"], r["us"], r["in_window"], r["limited"]) for r in _drain(usage.trailing_rate(stream, "user_id", "ts", 86400, 5, late="40 days"), "trail", spark).collect())
    rows = U.rolling_rate(batch.select("user_id", "ts"), "user_id", "ts", 86400, 5)
    want = sorted((r[0], r[1], r[2], r[3]) for r in rows.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")), "in_window", "limited").collect())
    assert got == want


def test_trailing_rate_counts_rows_before_a_late_one(spark):
    """Three batches; the last one is late, and needs rows older than a window before the newest."""
    batches = [[100, 130, 150], [400], [160]]
    source = folder()
    schema = "client long, ts timestamp"
    out = folder()
    stream = usage.trailing_rate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "client", "ts", 60, 3, late="10 minutes")
    check = folder()
    for stamps in batches:
        spark.createDataFrame([(1, s) for s in stamps], "client long, s long").select("client", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(180)
    got = {r["us"] // 1_000_000: r["in_window"] for r in spark.read.parquet(out).collect()}
    assert got == {100: 1, 130: 2, 150: 3, 400: 1, 160: 4}


def test_rolling_rate_matches_a_plain_window(spark):
    hot = [(1, t) for t in range(0, 4000, 7)] + [(2, 5), (2, 64), (2, 65), (2, 66)]
    df = spark.createDataFrame(hot, "client long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["client"], r["s"]): r["in_window"] for r in U.rolling_rate(df, "client", "ts", 60, 5).collect()}
    for c, t in hot:
        assert got[c, t] == sum(1 for c2, t2 in hot if c2 == c and t - 60 <= t2 <= t)
