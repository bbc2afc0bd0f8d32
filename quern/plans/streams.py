"""Streaming views of the rollout telemetry (Spark's windows and keyed state)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.joins import as_of_join
from quern.plans.base import Book, table
from quern.streaming import telemetry as S

book = Book()
QUERIES, SQL = book.queries, book.sql
LATE = "100 days"  # the table is one delivery in no order: nothing is late


def events(spark, d):
    return S.event_stream(spark, f"{d}/events.parquet")


@book.query("ss01_tumbling", "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    w = S.run_to_table(S.tumbling(events(spark, d), "1 day", LATE), "complete")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@book.query("ss02_sliding", "SELECT start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 hours, ts), time_bucket(INTERVAL 6 hours, ts) - INTERVAL 6 hours]) AS start FROM events) GROUP BY 1")
def sliding(spark, d):
    w = S.run_to_table(S.sliding(events(spark, d), "12 hours", "6 hours", LATE), "complete")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@book.query("ss03_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 hours THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    w = S.run_to_table(S.sessions(events(spark, d), "8 hours", LATE), "complete")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@book.query("ss04_dedup", "SELECT count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS ids FROM (SELECT DISTINCT event_id FROM events)")
def dedup(spark, d):
    w = S.run_to_table(S.distinct_users(events(spark, d), LATE))
    k = w.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return k.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"))


@book.query("sx01_stateful_buffer", "SELECT user_id, count(*)::BIGINT AS pushed, least(32, count(*))::BIGINT AS held, (list_sort(list({'t': ts, 'e': event_id})))[greatest(1, count(*) - 31)].e AS oldest FROM events GROUP BY 1")
def stateful_buffer(spark, d):
    return S.run_to_table(S.bounded_buffer(events(spark, d), 32), "update", ("user_id",))


@book.query("jn19_as_of", "SELECT o_orderkey, (SELECT max(event_id) FROM events e WHERE e.user_id = o.u AND e.ts = (SELECT max(ts) FROM events f WHERE f.user_id = o.u AND f.ts <= o.t)) AS event_id FROM (SELECT o_orderkey, o_custkey % 20 + 1 AS u, o_orderdate + INTERVAL 30 years AS t FROM orders) o")
def as_of(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20 + 1).alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 YEARS")).alias("at"))
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return as_of_join(o, e, "at", "ts", ["user_id"]).select("o_orderkey", "event_id")
