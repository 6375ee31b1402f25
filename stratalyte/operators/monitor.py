"""Metric time series: statistics, alerts, cooldown, moving averages, history, comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.operators.stats import floor_percentile
from stratalyte.plans.registry import query, table

RING = 1000
BY_TIME = ("ts", "event_id")


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], init: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]], fields: dict[str, str], kinds: list[pa.DataType]) -> DataFrame:
    """A sequential state for each key, over rows in order: `step` takes (state, row) to (state, output fields).

    Rows are dealt by key, sorted and streamed through Python, so a task holds one state and one batch whatever the
    size of a key. All columns of `df` come out, then `fields`."""
    names = df.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if (key := tuple(row[k] for k in keys)) != last:
                    last, state = key, init()
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [*names, *fields])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} {k}" for n, k in fields.items())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(of, schema)


@query("metric_statistics", f"""
with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events), v as (select * from r where k <= {RING}),
q as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from v)
select v.event_type, count(*)::bigint as n, max(case when k = 1 then v.value end) as current, round(avg(v.value), 6) as mean, min(v.value) as least, max(v.value) as most, round(coalesce(stddev_samp(v.value), 0), 6) as std,
  any_value(p95) as p95, any_value(p99) as p99 from v join (select event_type, max(case when i = floor(0.95 * (n - 1)) then value end) as p95, max(case when i = floor(0.99 * (n - 1)) then value end) as p99 from q group by event_type) p on p.event_type = v.event_type group by v.event_type""")  # fmt: skip
def metric_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Over the last 1000 samples of each metric: the ring's size is the feature."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    v = table(spark, d, "events").select("event_type", "value", F.row_number().over(w).alias("k")).where(F.col("k") <= RING)
    s = v.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("current"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))
    return s.join(floor_percentile(v, ["event_type"], "value", {"p95": 0.95, "p99": 0.99}), "event_type")


@query("alerts", """
with a as (select event_id, user_id, event_type, value > 90 as high, lag(value > 90) over (partition by user_id, event_type order by ts, event_id) as before from events)
select event_id, user_id, event_type from a where high and not coalesce(before, false)""")  # fmt: skip
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Samples that go above 90 where the one before did not: an alert fires once an excursion."""
    high = F.col("value") > 90
    w = Window.partitionBy("user_id", "event_type").orderBy(*BY_TIME)
    a = table(spark, d, "events").select("event_id", "user_id", "event_type", high.alias("high"), F.coalesce(F.lag(high).over(w), F.lit(False)).alias("before"))
    return a.where("high and not before").select("event_id", "user_id", "event_type")


def cooldown(df: DataFrame, seconds: int, low: float, high: float) -> DataFrame:
    """fired: the sample is outside [low, high] and the last firing of its key is `seconds` or more away."""

    def step(last, row):
        at = row["ts"].timestamp()
        fires = row["value"] is not None and not low <= row["value"] <= high and (last is None or at - last >= seconds)
        return (at if fires else last), (fires,)

    return fold_sorted(df, ["user_id"], list(BY_TIME), lambda: None, step, {"fired": "boolean"}, [pa.bool_()])


@query("cooldown_rules", """
with recursive e as (select user_id, epoch(ts) as t, event_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (select user_id, i, event_id, case when not value between 5 and 95 then t end as last, not value between 5 and 95 as fired from e where i = 1
  union all select e.user_id, e.i, e.event_id, case when not value between 5 and 95 and (f.last is null or t - f.last >= 3600) then t else f.last end, not value between 5 and 95 and (f.last is null or t - f.last >= 3600) from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select user_id, count(*)::bigint as samples, count(*) filter (where fired)::bigint as fired from f group by user_id""")  # fmt: skip
def cooldown_rules(spark: SparkSession, d: str) -> DataFrame:
    c = cooldown(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), 3600, 5, 95)
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if("fired").alias("fired"))


@query("moving_average", """
with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (select user_id, i, event_id, value as slow, value as fast from e where i = 1 union all select e.user_id, e.i, e.event_id, 0.95 * f.slow + 0.05 * e.value, 0.9 * f.fast + 0.1 * e.value from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select event_id, round(slow + 1e-9, 5) as slow, round(fast + 1e-9, 5) as fast from f""")  # fmt: skip
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """Exponential means with weights 0.95 and 0.9, started at the first sample."""

    def step(s, row):
        v = row["value"]
        s = (v, v) if s is None else (0.95 * s[0] + 0.05 * v, 0.9 * s[1] + 0.1 * v)
        return s, s

    e = table(spark, d, "events").where("value is not null").select("user_id", "ts", "event_id", "value")
    m = fold_sorted(e, ["user_id"], list(BY_TIME), lambda: None, step, {"slow": "double", "fast": "double"}, [pa.float64()] * 2)
    return m.select("event_id", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("slow", "fast")))


@query("adaptation_trigger", """
with e as (select user_id, event_id, value, max(value) over w as best, count(*) over w as n, row_number() over (partition by user_id order by ts, event_id) as i from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row))
select event_id, (i >= 3 and value < best * 0.8) as triggered, round(0.4 * value / 100 + 0.3 * best / 100 + 0.3 * n / 5, 6) as effectiveness from e""")  # fmt: skip
def adaptation_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Degraded by a fifth or more against the best of the last five, once there are three; and a weighted score."""
    base = Window.partitionBy("user_id").orderBy(*BY_TIME)
    w = base.rowsBetween(-4, 0)
    e = table(spark, d, "events").select("event_id", "value", F.max("value").over(w).alias("best"), F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(base).alias("i"))
    return e.select("event_id", ((F.col("i") >= 3) & (F.col("value") < F.col("best") * 0.8)).alias("triggered"), F.round(0.4 * F.col("value") / 100 + 0.3 * F.col("best") / 100 + 0.3 * F.col("n") / 5, 6).alias("effectiveness"))


@query("history", """
with r as (select user_id, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id, (33 - k)::int as slot, event_id, value from r where k <= 32""")  # fmt: skip
def history(spark: SparkSession, d: str) -> DataFrame:
    """The last 32 samples of each user, oldest in the least slot: a ring of that size."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", F.row_number().over(w).alias("k"), "event_id", "value").where("k <= 32").select("user_id", (33 - F.col("k")).alias("slot"), "event_id", "value")


@query("success_rate", "select event_type, count(*)::bigint as n, round(avg((value >= 50)::int), 6) as success_rate, round(greatest(0, 1 - count(*) filter (where value < 10) / 100.0), 6)::double as reliability from events group by event_type")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") >= 50).cast("int")), 6).alias("success_rate"), F.round(F.greatest(F.lit(0.0), 1 - F.count_if(F.col("value") < 10) / 100.0), 6).alias("reliability"))


@query("monitor_summary", """
select count(*)::bigint as samples, count(distinct user_id)::bigint as workers, count(distinct event_type)::bigint as metrics, count(*) filter (where value > 90)::bigint as over_limit, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::bigint as seconds from events""")  # fmt: skip
def monitor_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("user_id").alias("workers"), F.countDistinct("event_type").alias("metrics"), F.count_if(F.col("value") > 90).alias("over_limit"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))


@query("throughput_log", """
with h as (select date_trunc('hour', ts) as hour, count(*) as n, sum(value) as v from events group by 1)
select hour, n::bigint as n, round(v, 4) as total, (n - lag(n) over (order by hour))::bigint as change, sum(n) over (order by hour)::bigint as so_far from h""")  # fmt: skip
def throughput_log(spark: SparkSession, d: str) -> DataFrame:
    """Counts an hour with changes and running totals; the window runs over hours, not samples."""
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    w = Window.orderBy("hour")
    return h.select("hour", "n", "total", (F.col("n") - F.lag("n").over(w)).alias("change"), F.sum("n").over(w).alias("so_far"))


@query("run_comparison", """
with r as (select user_id, event_type, avg(value) as v from events group by 1, 2), b as (select event_type, avg(v) as base from r group by 1)
select user_id, r.event_type, round(base / nullif(v, 0), 6) as speedup, round((v - base) / nullif(base, 0) * 100, 4) as change_percent, coalesce(base / nullif(v, 0) > 1.1, false) as significant from r join b on b.event_type = r.event_type""")  # fmt: skip
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Each user's mean against the mean over users: speedup, change, and whether it is over 1.1."""
    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    b = r.groupBy("event_type").agg(F.avg("v").alias("base"))
    speed = F.try_divide(F.col("base"), F.col("v"))
    return r.join(b, "event_type").select("user_id", "event_type", F.round(speed, 6).alias("speedup"), F.round(F.try_divide(F.col("v") - F.col("base"), F.col("base")) * 100, 4).alias("change_percent"), F.coalesce(speed > 1.1, F.lit(False)).alias("significant"))


@query("error_log", """
with s as (select case when value < 25 then 'low' when value < 50 then 'medium' when value < 90 then 'high' else 'critical' end as severity, event_type as category from events)
select severity, category, count(*)::bigint as n, sum(count(*)) over (partition by severity)::bigint as of_severity from s group by 1, 2""")  # fmt: skip
def error_log(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    s = table(spark, d, "events").groupBy(F.when(v < 25, "low").when(v < 50, "medium").when(v < 90, "high").otherwise("critical").alias("severity"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("of_severity", F.sum("n").over(Window.partitionBy("severity")))


@query("safety", """
with s as (select user_id, avg((value < 90)::int) as health, greatest(0, 1 - count(*) filter (where value < 10) / 100.0) as reliability, avg((value >= 50)::int) as recovery from events group by user_id)
select user_id, round(0.4 * health + 0.4 * reliability + 0.2 * recovery, 6)::double as score, round(0.4 * health + 0.4 * reliability + 0.2 * recovery, 6) >= 0.7 as safe from s""")  # fmt: skip
def safety(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    share = lambda c: F.avg(c.cast("int"))
    score = F.round(0.4 * share(v < 90) + 0.4 * F.greatest(F.lit(0.0), 1 - F.count_if(v < 10) / 100.0) + 0.2 * share(v >= 50), 6)
    return table(spark, d, "events").groupBy("user_id").agg(score.alias("score")).select("user_id", "score", (F.col("score") >= 0.7).alias("safe"))


@query("backoff_and_degradation", """
select l_orderkey, l_linenumber, least(100 * power(2, l_linenumber - 1), 3000)::bigint as backoff_ms, case when l_quantity < 5 or ceil((50 - l_quantity) / 10) > 4 then -1 else ceil((50 - l_quantity) / 10) end::bigint as steps from lineitem""")  # fmt: skip
def backoff_and_degradation(spark: SparkSession, d: str) -> DataFrame:
    """Doubling waits with a most; steps from 50 down to a level, -1 where it is too low or too far."""
    q = F.col("l_quantity")
    steps = F.ceil((50 - q) / 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least(100 * F.expr("shiftleft(1L, l_linenumber - 1)"), F.lit(3000)).alias("backoff_ms"), F.when((q < 5) | (steps > 4), F.lit(-1).cast("long")).otherwise(steps).alias("steps"))


@query("streaming_metric_windows", """
select time_bucket(interval '10 minutes', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total, max(value) as most from events group by 1, 2""")  # fmt: skip
def streaming_metric_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows as a stream makes them: read, watermarked, aggregated and written until the input is used up."""
    from stratalyte.streaming.metrics import windowed_metrics

    return windowed_metrics(spark, d)
