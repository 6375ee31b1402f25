"""Structured Streaming over metric samples: windowed statistics and alerts with cooldown."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where that is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stratalyte-')}"
    return f"{top.rstrip('/')}/streams/{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet (a file or a folder) as a stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def window_stats(events: DataFrame, *, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Count, total and most of each type in tumbling windows; samples later than `delay` are dropped by the watermark."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "event_type", "n", "total", "most")


def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_stats of what is there, run to its end with a checkpoint; the latest row of each window is kept."""
    top = shared_dir(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{top}/out/batch={batch_id}")

    # Complete output: a replayed batch overwrites its own folder, so a restart leaves no row twice.
    q = window_stats(source(spark, sf_dir)).writeStream.outputMode("complete").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    rows = spark.read.parquet(*[f"{top}/out/batch={q.lastProgress['batchId']}"]) if q.lastProgress else spark.read.parquet(f"{top}/out")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total", "most")


def cooldown_alerts(events: DataFrame, *, seconds: int, low: float, high: float) -> DataFrame:
    """user_id, event_id of samples outside [low, high], with `seconds` or more between two of a user; state outlives restarts."""

    def step(key: tuple, frames, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        for df in frames:
            for ts, event_id, value in df.sort_values(["ts", "event_id"])[["ts", "event_id", "value"]].itertuples(index=False):
                at = ts.timestamp()
                if not low <= value <= high and (last is None or at - last >= seconds):
                    last = at
                    out.append((key[0], event_id))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last double", "append", GroupStateTimeout.NoTimeout)
