"""Streams over rollout telemetry: watermarked windows, sessions, and a bounded buffer as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import children, drop_path, scratch


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """events.parquet as a stream, its time zone fixed to UTC."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append", key: tuple[str, ...] = ()) -> DataFrame:
    """Drain a stream into a parquet table through foreachBatch and read it. Each batch has a folder of its own, which a
    batch that runs again overwrites: exactly once. In append mode the table is all folders; in complete mode it is the last
    one, which holds the whole result, and older ones are removed; in update mode a row replaces the earlier one of its key
    (the newest folder wins), and without a key every change is kept, with the number of its batch as `epoch`."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")

    def sink(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if mode == "complete" and epoch:
            drop_path(df.sparkSession, f"{out}/epoch={epoch - 1}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    epochs = sorted(int(x[6:]) for x in children(spark, out) if x.startswith("epoch="))
    if not epochs:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/epoch={epochs[-1]}")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out)
    if mode == "append":
        return rows.drop("epoch")
    if not key:
        return rows
    rest = [c for c in stream.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return last.select(*(F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in stream.columns))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str, step: str, late: str) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_users(stream: DataFrame, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def bounded_buffer(stream: DataFrame, size: int) -> DataFrame:
    """For each user a buffer of the `size` latest event ids by (ts, event_id), in whatever order the events come, kept
    as keyed state; a row for each user and batch with how many were pushed so far and the oldest id held."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def push(key, frames, state: GroupState):
        at, held, total = state.get if state.exists else ([], [], 0)
        held = list(zip(at, held))
        for f in frames:  # the Arrow chunks of a batch, in no order
            new = f.sort_values(["at", "event_id"]).tail(size)
            total += len(f)
            held = sorted(held + list(zip(new["at"].tolist(), new["event_id"].tolist())))[-size:]
        state.update(([a for a, _ in held], [e for _, e in held], total))
        yield pd.DataFrame({"user_id": [key[0]], "pushed": [total], "held": [len(held)], "oldest": [held[0][1] if held else None]})

    # Microseconds, as pandas would get wall-clock times; a NULL ts counts as the latest.
    rows = stream.select("user_id", "event_id", F.coalesce(F.unix_micros("ts"), F.lit(2**63 - 1)).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(push, "user_id long, pushed long, held long, oldest long", "at array<long>, held array<long>, total long", "update", GroupStateTimeout.NoTimeout)
