"""The bounded buffer over users whose events come in many Arrow chunks and batches."""

import datetime
import random

import pytest

from quern.streaming import telemetry

START = datetime.datetime(2024, 1, 1)


def rows_of(n, seed):
    r = random.Random(seed)
    rows = [(i, START + datetime.timedelta(minutes=r.randrange(n)), 1 if i % 3 else 2) for i in range(n)]
    r.shuffle(rows)
    return rows


def latest(rows, user, size):
    return sorted((ts, e) for e, ts, u in rows if u == user)[-size:]


@pytest.fixture
def small_chunks(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10")
    yield
    spark.conf.set(key, old)


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").toPandas()
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(path)


def test_chunks_in_any_order_give_the_latest_events(spark, small_chunks, tmp_path):
    rows = rows_of(2_000, 1)
    write(spark, rows, f"{tmp_path}/events.parquet")
    out = telemetry.run_to_table(telemetry.bounded_buffer(telemetry.event_stream(spark, f"{tmp_path}/events.parquet"), 32), "update").collect()
    got = {r.user_id: (r.pushed, r.held, r.oldest) for r in out}
    assert got == {u: (sum(x[2] == u for x in rows), 32, latest(rows, u, 32)[0][1]) for u in (1, 2)}


def test_an_earlier_event_of_a_later_batch_is_no_newer(spark, small_chunks, tmp_path):
    rows = rows_of(600, 2)
    for k in range(3):
        write(spark, rows[k::3], f"{tmp_path}/events{k}.parquet")
    schema = spark.read.parquet(f"{tmp_path}/events0.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = telemetry.run_to_table(telemetry.bounded_buffer(stream.withColumn("ts", stream.ts.cast("timestamp")), 32), "update").collect()
    last = {r.user_id: r for r in sorted(out, key=lambda r: r.pushed)}
    assert len(out) == 6 and {u: r.oldest for u, r in last.items()} == {u: latest(rows, u, 32)[0][1] for u in (1, 2)}
