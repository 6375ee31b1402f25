from pyspark.sql import functions as F

from stratalyte.operators.monitor import cooldown
from stratalyte.streaming import metrics

DIR = "/root/testdata/sf0.001"


def test_cooldown_stream_is_the_batch(spark):
    events = metrics.source(spark, DIR).select("user_id", "ts", "event_id", "value")
    q = metrics.cooldown_alerts(events, seconds=3600, low=5, high=95).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", metrics.shared_dir(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    want = cooldown(batch, 3600, 5, 95).where("fired").select("event_id")
    assert sorted(r["event_id"] for r in spark.table("fired").collect()) == sorted(r["event_id"] for r in want.collect())
