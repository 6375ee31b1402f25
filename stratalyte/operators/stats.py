"""Byte and signal statistics: entropy in its forms, moments, autocorrelation, percentiles, feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.functions.byteview import BYTES_SQL, byte_profile, hist_entropy, hist_unique, in_batches, pieces, text_bytes
from stratalyte.plans.registry import query, table

R = 6


def _profile(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return byte_profile(table(spark, d, "documents"), extra=extra)


def entropy_columns(p: DataFrame) -> DataFrame:
    """h: bits a byte; uniq; unif: h over log2(uniq); potential; the three kinds of content; the predicted ratio."""
    p = p.withColumns({"h": hist_entropy(F.col("hist"), F.col("n")), "uniq": hist_unique(F.col("hist"))})
    p = p.withColumn("unif", F.when(F.col("uniq") > 1, F.col("h") / F.log2("uniq")).otherwise(0.0))
    h, unif, var = F.col("h"), F.col("unif"), F.col("block_var")
    p = p.withColumns({
        "is_random": (h > 7.5) & (unif > 0.9),
        "is_text": h.between(4.0, 6.5) & F.col("uniq").between(20, 100),
        "is_structured": (var > 1.0) & (unif < 0.7),
        "potential": h / 8 * (1 - unif) / (1 + var),
    })
    factor = F.when(F.col("is_text"), 0.7).when(F.col("is_structured"), 0.5).otherwise(0.8)
    return p.withColumn("ratio", F.when(F.col("is_random"), 0.95).otherwise(h / 8 * factor))


_ENTROPY_SQL = f"""
with {BYTES_SQL},
mids as (select doc_id, unnest(range(0, n, 64)) as m, n from totals),
local as (select m.doc_id, m.m, b.b, count(*) as c from mids m join bytes b on b.doc_id = m.doc_id and b.pos >= m.m - 64 and b.pos < m.m + 64 group by 1, 2, 3),
lent as (select doc_id, m, -sum(c / t * log2(c / t)) as lh from (select *, sum(c) over (partition by doc_id, m) as t from local) q group by doc_id, m),
bvar as (select l.doc_id, case when count(*) > 1 then avg(power(lh - h, 2)) else 0 end as v from lent l join ent using (doc_id) group by l.doc_id),
m as (
  select d.doc_id, coalesce(n, 0) as n, coalesce(h, 0) as h, coalesce(uniq, 0) as uniq, coalesce(v, 0) as v,
         case when uniq > 1 then h / log2(uniq) else 0 end as unif
  from documents d left join totals using (doc_id) left join ent using (doc_id) left join bvar using (doc_id)),
k as (select *, h > 7.5 and unif > 0.9 as is_random, h between 4 and 6.5 and uniq between 20 and 100 as is_text, v > 1 and unif < 0.7 as is_structured from m)
"""


@query("content_entropy", _ENTROPY_SQL + """
select doc_id, n::bigint as n_bytes, round(h, 6) as entropy, round(h / 8, 6) as entropy_norm, uniq::bigint as unique_symbols, round(unif, 6) as uniformity,
       case when is_random then 'random' when is_text then 'text' when is_structured then 'structured' else 'general' end as class,
       round(case when is_random then 0.95 when is_text then h / 8 * 0.7 when is_structured then h / 8 * 0.5 else h / 8 * 0.8 end, 6) as predicted_ratio
from k""")  # fmt: skip
def content_entropy(spark: SparkSession, d: str) -> DataFrame:
    p = entropy_columns(_profile(spark, d, "block_var"))
    kind = F.when(F.col("is_random"), "random").when(F.col("is_text"), "text").when(F.col("is_structured"), "structured").otherwise("general")
    return p.select("doc_id", F.col("n").alias("n_bytes"), F.round("h", R).alias("entropy"), F.round(F.col("h") / 8, R).alias("entropy_norm"), F.col("uniq").alias("unique_symbols"), F.round("unif", R).alias("uniformity"), kind.alias("class"), F.round("ratio", R).alias("predicted_ratio"))


@query("entropy_variance", _ENTROPY_SQL + "select doc_id, round(v, 6) as block_variance, round(h / 8 * (1 - unif) / (1 + v), 6) as potential from k")
def entropy_variance(spark: SparkSession, d: str) -> DataFrame:
    p = entropy_columns(_profile(spark, d, "block_var"))
    return p.select("doc_id", F.round("block_var", R).alias("block_variance"), F.round("potential", R).alias("potential"))


@query("byte_histogram", f"with {BYTES_SQL} select doc_id, b as byte, c::bigint as n, round(-(c / n) * log2(c / n), 6) as contribution from hist join totals using (doc_id)")
def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d).select("doc_id", "n", F.posexplode("hist").alias("byte", "c")).where("c > 0")
    return p.select("doc_id", "byte", F.col("c").alias("n"), F.round(-(F.col("c") / F.col("n")) * F.log2(F.col("c") / F.col("n")), R).alias("contribution"))


@query("conditional_entropy", f"""
with {BYTES_SQL},
pairs as (select a.doc_id, a.b as x, b.b as y, count(*) as c from bytes a join bytes b on b.doc_id = a.doc_id and b.pos = a.pos + 8 group by 1, 2, 3),
tot as (select *, sum(c) over (partition by doc_id) as t, sum(c) over (partition by doc_id, x) as cx from pairs),
e as (select doc_id, -sum(c / t * log2(c / cx)) as h from tot group by doc_id)
select doc_id, round(coalesce(h, 0), 6) + 0 as conditional_entropy from documents left join e using (doc_id)""")  # fmt: skip
def conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "cond").select("doc_id", F.round("cond", R).alias("conditional_entropy"))


@query("local_entropy", f"""
with {BYTES_SQL}, l as (
  select doc_id, b, count(*) as c from bytes join totals using (doc_id) where pos >= n // 2 - 32 and pos < n // 2 + 32 group by doc_id, b),
e as (select doc_id, -sum(c / t * log2(c / t)) as h from (select *, sum(c) over (partition by doc_id) as t from l) q group by doc_id)
select doc_id, round(coalesce(h, 0), 6) + 0 as local_entropy from documents left join e using (doc_id)""")  # fmt: skip
def local_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the 64 bytes around the middle; only those bytes leave the table, and their counts are made for many texts at once."""
    raw = F.col("text").cast("binary")
    mid = F.floor(F.octet_length("text") / 2)
    lo = F.greatest(mid - 32, F.lit(0))
    near = F.substring(raw, (lo + 1).cast("int"), (mid + 32 - lo).cast("int"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole)):
            flat, starts = text_bytes(b.column(1))
            n = np.diff(starts)
            h = np.bincount(np.repeat(np.arange(len(n)), n) * 256 + flat, minlength=len(n) * 256).reshape(-1, 256)
            p = h / np.maximum(n, 1)[:, None]
            e = -(p * np.log2(np.where(h > 0, p, 1.0))).sum(1) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e)], ["doc_id", "e"])

    docs = table(spark, d, "documents")
    return in_batches(docs.select("doc_id", near.alias("near")), of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, e double").select("doc_id", F.round("e", R).alias("local_entropy"))


def moments(p: DataFrame) -> DataFrame:
    """mean, var (population), sparsity, redundancy and lag-one autocorrelation of the bytes, from sums alone."""
    n = F.col("n")
    p = p.withColumn("mean", F.when(n > 0, F.col("sum") / n).otherwise(0.0))
    p = p.withColumn("var", F.when(n > 0, F.col("sumsq") / n - F.col("mean") * F.col("mean")).otherwise(0.0))
    # sum over i of (b[i-1] - mean)(b[i] - mean)
    cross = F.col("lagged") - F.col("mean") * (2 * F.col("sum") - F.col("first") - F.col("last")) + (n - 1) * F.col("mean") * F.col("mean")
    return p.withColumns({
        "sparsity": F.when(n > 0, F.get("hist", F.lit(0)) / n).otherwise(0.0),
        "redundancy": F.when(n > 1, F.col("same") / (n - 1)).otherwise(0.0),
        "autocorr": F.when((n > 1) & (F.col("var") > 1e-9), cross / ((n - 1) * F.col("var"))).otherwise(0.0),
        "h": hist_entropy(F.col("hist"), n),
    })


MOMENTS_SQL = f"""
with {BYTES_SQL},
mv as (select doc_id, avg(b) as mean, var_pop(b) as var, avg((b = 0)::int) as sparsity from bytes group by doc_id),
adj as (select *, lag(b) over (partition by doc_id order by pos) as p from bytes),
ac as (select a.doc_id, avg((b = p)::int) as redundancy, case when any_value(var) > 1e-9 then avg((p - mean) * (b - mean)) / any_value(var) else 0 end as autocorr
       from adj a join mv using (doc_id) where p is not null group by a.doc_id),
mom as (select d.doc_id, coalesce(n, 0) as n, coalesce(h, 0) as h, coalesce(mean, 0) as mean, coalesce(var, 0) as var, coalesce(sparsity, 0) as sparsity, coalesce(redundancy, 0) as redundancy, coalesce(autocorr, 0) as autocorr
        from documents d left join totals using (doc_id) left join ent using (doc_id) left join mv using (doc_id) left join ac using (doc_id))
"""


@query("byte_moments", MOMENTS_SQL + "select doc_id, round(mean, 6) as mean, round(var, 4) as variance, round(sparsity, 6) as sparsity, round(redundancy, 6) as redundancy, round(autocorr, 6) as autocorrelation, round(1 - (h / 8 * 0.7 + (1 - redundancy) * 0.3), 6) as compressibility from mom")
def byte_moments(spark: SparkSession, d: str) -> DataFrame:
    p = moments(_profile(spark, d))
    return p.select("doc_id", F.round("mean", R).alias("mean"), F.round("var", 4).alias("variance"), F.round("sparsity", R).alias("sparsity"), F.round("redundancy", R).alias("redundancy"), F.round("autocorr", R).alias("autocorrelation"), F.round(1 - (F.col("h") / 8 * 0.7 + (1 - F.col("redundancy")) * 0.3), R).alias("compressibility"))


@query("entropy_running_average", _ENTROPY_SQL + "select doc_id, round(avg(h) over w, 6) as running_entropy, round(avg(unif) over w, 6) as running_uniformity from k join documents using (doc_id) window w as (partition by source order by doc_id rows unbounded preceding)")
def entropy_running_average(spark: SparkSession, d: str) -> DataFrame:
    """Running means of the metrics over each source's documents."""
    docs = table(spark, d, "documents")
    p = entropy_columns(byte_profile(docs, extra=("block_var",), carry=("source",)))
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("doc_id", F.round(F.avg("h").over(w), R).alias("running_entropy"), F.round(F.avg("unif").over(w), R).alias("running_uniformity"))


@query("sample_statistics", """
select event_type, count(*)::bigint as n, round(min(value), 6) as min_value, round(max(value), 6) as max_value, round(avg(value), 6) as mean_value, round(median(value), 6) as median_value,
       round(stddev_pop(value), 6) as std_pop, round(coalesce(stddev_samp(value), 0), 6) as std_samp, round(coalesce(var_samp(value), 0), 4) as var_samp, round(var_pop(value), 4) as var_pop, round(sum(value), 4) as total
from events group by event_type""")  # fmt: skip
def sample_statistics(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(v), R).alias("min_value"), F.round(F.max(v), R).alias("max_value"), F.round(F.avg(v), R).alias("mean_value"), F.round(F.median(v), R).alias("median_value"),
        F.round(F.stddev_pop(v), R).alias("std_pop"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), R).alias("std_samp"), F.round(F.coalesce(F.var_samp(v), F.lit(0.0)), 4).alias("var_samp"), F.round(F.var_pop(v), 4).alias("var_pop"), F.round(F.sum(v), 4).alias("total"),
    )


def floor_percentile(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[floor(p * (n - 1))] of each group: ranks of distinct values from their counts, so equal values never meet in one row."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    cum = counts.withColumns({"_to": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    at = lambda p: F.floor(F.lit(p) * (F.col("_n") - 1))
    return cum.groupBy(*keys).agg(*(F.min(F.when(F.col("_to") > at(p), F.col(value))).alias(name) for name, p in shares.items()))


@query("floor_percentiles", """
with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(case when i = floor(0.5 * (n - 1)) then value end) as p50, max(case when i = floor(0.95 * (n - 1)) then value end) as p95, max(case when i = floor(0.99 * (n - 1)) then value end) as p99 from r group by event_type""")  # fmt: skip
def floor_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return floor_percentile(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("signal_autocorrelation", """
with e as (select user_id, value, lag(value, 1) over w as a, lag(value, 2) over w as b, avg(value) over (partition by user_id) as m from events window w as (partition by user_id order by ts, event_id))
select user_id, round(coalesce(sum((a - m) * (value - m)) / nullif(sum(power(value - m, 2)), 0), 0), 6) as autocorr_1, round(coalesce(sum((b - m) * (value - m)) / nullif(sum(power(value - m, 2)), 0), 0), 6) as autocorr_2 from e group by user_id""")  # fmt: skip
def signal_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "value", F.lag("value", 1).over(w).alias("a"), F.lag("value", 2).over(w).alias("b"), F.avg("value").over(Window.partitionBy("user_id")).alias("m"))
    e = e.select("user_id", (F.col("value") - F.col("m")).alias("x"), (F.col("a") - F.col("m")).alias("y1"), (F.col("b") - F.col("m")).alias("y2"))
    ratio = lambda y: F.round(F.coalesce(F.try_divide(F.sum(F.col(y) * F.col("x")), F.sum(F.col("x") * F.col("x"))), F.lit(0.0)), R)
    return e.groupBy("user_id").agg(ratio("y1").alias("autocorr_1"), ratio("y2").alias("autocorr_2"))


@query("temporal_features", """
with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
select user_id, round(coalesce(regr_slope(value, i), 0), 6) as slope, round(abs(coalesce(regr_slope(value, i), 0)) / (var_pop(value) + 1e-6), 6) as trend from e group by user_id having count(*) > 1""")  # fmt: skip
def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "value", (F.row_number().over(w) - 1).alias("i"))
    slope = F.coalesce(F.regr_slope("value", "i"), F.lit(0.0))
    return e.groupBy("user_id").agg(F.round(slope, R).alias("slope"), F.round(F.abs(slope) / (F.var_pop("value") + 1e-6), R).alias("trend"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


@query("zscore", "select event_id, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) as z from events window w as (partition by event_type)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """Moments are aggregated first and joined, so a frequent type is never sorted or held in one task."""
    e = table(spark, d, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return e.join(s, "event_type").select("event_id", F.round(F.try_divide(F.col("value") - F.col("m"), F.col("sd")), R).alias("z"))


@query("float_basic_statistics", """
select vec_id, round(list_avg(e), 6) as mean, round(list_var_pop(e), 6) as variance, round(len(list_filter(e, lambda x: abs(x) < 1e-6)) / len(e), 6) as sparsity from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings) q""")  # fmt: skip
def float_basic_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    v = table(spark, d, "embeddings").select("vec_id", e.alias("e"), F.size(e).alias("n"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("s"))
    mean = F.col("s") / F.col("n")
    return v.select("vec_id", F.round(mean, R).alias("mean"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.col("n"), R).alias("variance"), F.round(F.size(F.filter("e", lambda x: F.abs(x) < 1e-6)) / F.col("n"), R).alias("sparsity"))


@query("feature_vector", MOMENTS_SQL + """
, f as (select doc_id, [h / 8, mean / 255, var / 65025, sparsity, redundancy, h / 8 * mean / 255, h / 8 * redundancy, sparsity * redundancy] as v from mom)
select doc_id, (generate_subscripts(v, 1) - 1)::int as i, round(unnest(v), 6) as feature from f""")  # fmt: skip
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """Normalised features, then cross products of them."""
    p = moments(_profile(spark, d))
    h, m, v, s, r = F.col("h") / 8, F.col("mean") / 255, F.col("var") / 65025, F.col("sparsity"), F.col("redundancy")
    return p.select("doc_id", F.posexplode(F.array(*(F.round(x, R) for x in (h, m, v, s, r, h * m, h * r, s * r)))).alias("i", "feature"))
