"""Usage of the service: searches, counters, request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark.functions import text as X


def top_values(rows: DataFrame, value: Column, limit: int = 20) -> DataFrame:
    """Most frequent lower-cased values."""
    return (
        rows.select(F.lower(value).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term").limit(limit)
    )


def top_searches(log: DataFrame, limit: int = 20) -> DataFrame:
    return top_values(log, F.coalesce("matched_drug", "drug_query"), limit)


def top_unmatched(log: DataFrame, limit: int = 20) -> DataFrame:
    return top_values(log.where(F.col("matched_drug").isNull()), F.col("drug_query"), limit)


def search_kpis(log: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    since = lambda days: F.col("created_at") >= at - F.expr(f"interval {days} days")
    return log.agg(
        F.count(F.lit(1)).alias("searches_total"),
        F.count_if(since(7)).alias("searches_7d"),
        F.count_if(since(30)).alias("searches_30d"),
        F.count_if(F.col("matched_drug").isNull()).alias("searches_unmatched"),
        F.count_distinct("user_id").alias("searchers"),
    )


def user_kpis(users: DataFrame, tracked: DataFrame) -> DataFrame:
    """User and tracked-list totals as ``(metric, value)`` rows."""
    people = users.agg(
        F.count(F.lit(1)).alias("users_total"), F.count_if("email_verified").alias("users_verified"), F.count_if("notify_opt_in").alias("users_notify")
    )
    lists = tracked.agg(F.count(F.lit(1)).alias("medications_tracked"), F.count_distinct(F.lower("drug")).alias("medications_distinct"))
    return as_metrics(people).unionByName(as_metrics(lists))


def notification_kpis(notes: DataFrame) -> DataFrame:
    return notes.agg(
        F.count(F.lit(1)).alias("notifications_created"),
        F.count("emailed_at").alias("notifications_emailed"),
        F.count_if(F.col("read_at").isNull()).alias("notifications_unread"),
    )


def unread_per_user(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("read_at").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"))


def as_metrics(row: DataFrame) -> DataFrame:
    """One wide aggregate row to ``(metric, value)`` rows."""
    parts = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*parts)))


def daily_counters(events: DataFrame, ts: str = "ts", metric: str = "event_type") -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day"), F.col(metric).alias("metric")).agg(F.count(F.lit(1)).alias("value"))


def add_counters(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add new amounts to stored counters, creating missing rows."""
    return stored.unionByName(fresh).groupBy("day", "metric").agg(F.sum("value").alias("value"))


def daily_pivot(counters: DataFrame, now: str, metrics: list[str], days: int = 14) -> DataFrame:
    """One row per recent day with a column per metric, newest first."""
    recent = counters.where(F.col("day") >= F.date_sub(F.lit(now).cast("date"), days))
    return recent.groupBy("day").pivot("metric", metrics).agg(F.sum("value")).orderBy(F.desc("day"))


def recent_per_user(log: DataFrame, n: int, ts: str = "created_at", tie: str = "event_id") -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc(ts), F.desc(tie))
    return log.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search_hygiene(texts: DataFrame) -> DataFrame:
    """Accepted and refused queries per kind from ``(kind, query)``."""
    return texts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(X.is_safe_query(F.col("query"))).alias("accepted")
    ).withColumn("refused", F.col("queries") - F.col("accepted"))


def rolling_rate(requests: DataFrame, client: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Requests of the same client in the trailing window at every request, and whether that reaches the limit.

    The log is cut into slots of one window length. A window spans its own slot and
    at most the one before, so each row also visits the next slot as context. That
    splits a client holding a large share of the log over all its slots instead of
    sorting the whole client in one task.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    length = seconds * 1_000_000
    slot = F.floor(micros / length)
    base = requests.withColumns({"_us": micros, "_slot": slot})
    both = base.withColumn("_at", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)))
    trailing = Window.partitionBy(client, "_at").orderBy("_us").rangeBetween(-length, 0)
    return (
        both.withColumn("in_window", F.count(F.lit(1)).over(trailing))
        .where(F.col("_at") == F.col("_slot"))
        .withColumn("limited", F.col("in_window") >= limit)
        .drop("_us", "_slot", "_at")
    )


def search_sessions(log: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Searches per user and session; a session ends after a gap without searches."""
    return (
        log.groupBy(user, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("searches"))
        .select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "searches")
    )
