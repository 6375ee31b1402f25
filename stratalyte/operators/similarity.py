"""Similarity store, signal coding and layer statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.functions.sums import nearest, running_sum, whole_sum
from stratalyte.operators.vectors import dot, total, vectors
from stratalyte.plans.registry import query, table

BY_TIME = ("ts", "event_id")


@query("cosine_similarity", "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings) select x.vec_id, y.vec_id as other, round(list_cosine_similarity(x.a, y.a), 6) as similarity, list_cosine_similarity(x.a, y.a) > 0.7 as close from e x join e y on y.vec_id = x.vec_id + 1")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to its successor; zero where a norm is zero."""
    x = vectors(spark, d).select("vec_id", "a")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("a").alias("b"))
    s = F.coalesce(F.try_divide(dot(F.col("a"), F.col("b")), F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))), F.lit(0.0))
    return x.join(y, "vec_id").select("vec_id", "other", F.round(s, 6).alias("similarity"), (s > 0.7).alias("close"))


@query("exact_store_lookup", "with h as (select doc_id, md5(text) as k from documents where text is not null), g as (select k, min(doc_id) as stored, count(*) as n from h group by k) select doc_id, stored, n::bigint as copies, doc_id <> stored as found from h join g using (k)")
def exact_store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries with equal digests: the first is stored, later ones find it."""
    h = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    g = h.groupBy("k").agg(F.min("doc_id").alias("stored"), F.count(F.lit(1)).alias("copies"))
    return h.join(g, "k").select("doc_id", "stored", "copies", (F.col("doc_id") != F.col("stored")).alias("found"))


_STORE = "s as (select user_id, event_type, count(*) as uses, max(ts) as last, (select max(ts) from events) as now, sum(value) > 1000 as persistent from events group by 1, 2), k as (select *, round((0.4 * uses / 100.0 + 0.4 * exp(-(floor(epoch(now)) - floor(epoch(last))) / 86400.0) + 0.2 * persistent::int)::double, 9) as score from s)"


def store_scores(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_type, persistent and the decayed score of use, recency and persistence; benefits are added up in the order of the rows."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    s = running_sum(e, ["user_id", "event_type"], "value", "ts").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last"), (whole_sum() > 1000).alias("persistent"))
    age = F.unix_timestamp("now") - F.unix_timestamp("last")
    return s.join(F.broadcast(now)).withColumn("score", nearest(F.col("uses") * 4 / 10 / 100 + 0.4 * F.exp(-age / 86400.0) + 0.2 * F.col("persistent").cast("int"), 9))


@query("store_eviction", f"with {_STORE}, r as (select *, row_number() over (order by score, user_id, event_type) as i from k where not persistent) select user_id, event_type, round(score, 6) as score, i <= 10 as evicted, persistent from r union all select user_id, event_type, round(score, 6), false, true from k where persistent")
def store_eviction(spark: SparkSession, d: str) -> DataFrame:
    """The ten lowest that are not persistent go (the number is the feature); what has no benefit known is neither."""
    s = store_scores(spark, d).where("persistent is not null")
    out = s.where("not persistent").orderBy(*[F.asc_nulls_last(c) for c in ("score", "user_id", "event_type")]).limit(10).select(F.col("user_id").alias("u"), F.col("event_type").alias("e"), F.lit(True).alias("gone"))
    same = F.col("user_id").eqNullSafe(F.col("u")) & F.col("event_type").eqNullSafe(F.col("e"))
    return s.join(F.broadcast(out), same, "left").select("user_id", "event_type", nearest(F.col("score"), 6).alias("score"), F.coalesce("gone", F.lit(False)).alias("evicted"), "persistent")


@query("round_robin_clusters", "select vec_id, vec_id % 8 as cluster, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) + 0 as total from embeddings")
def round_robin_clusters(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", (F.col("vec_id") % 8).alias("cluster"), (F.round(total(F.col("a")), 6) + 0.0).alias("total"))


@query("vector_fusion", "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings) select vec_id, i::int as i, round(0.5 * a[i + 1] + 0.3 * a[64 - i] + 0.2 * abs(a[i + 1]), 6) + 0 as fused from e, (select unnest(range(64)) as i) r")
def vector_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of three vectors: a, its reverse and its magnitudes."""
    f = F.zip_with("a", "b", lambda x, y: 0.5 * x + 0.3 * y + 0.2 * F.abs(x))
    return vectors(spark, d).select("vec_id", F.posexplode(f).alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + 0.0).alias("fused"))


@query("signal_coding", """
with e as (select user_id, event_id, value, value - lag(value, 1, 0) over w as d, row_number() over w - 1 as i from events window w as (partition by user_id order by ts, event_id))
select event_id, round(d * 10) / 10 + 0 as predictive, i % 2 = 0 as kept, least(32767, greatest(-32768, trunc(d * 1000)))::int as residual from e""")  # fmt: skip
def signal_coding(spark: SparkSession, d: str) -> DataFrame:
    """First differences, quantised; every second sample kept; differences in thousandths as 16 bits, saturated."""
    w = Window.partitionBy("user_id").orderBy(*BY_TIME)
    e = table(spark, d, "events").select("event_id", (F.col("value") - F.lag("value", 1, 0.0).over(w)).alias("d"), (F.row_number().over(w) - 1).alias("i"))
    return e.select("event_id", (F.round(F.col("d") * 10) / 10 + 0.0).alias("predictive"), (F.col("i") % 2 == 0).alias("kept"), F.least(F.lit(32767), F.greatest(F.lit(-32768), (F.col("d") * 1000).cast("int"))).alias("residual"))


@query("recovered_quality", """
with p as (select l_returnflag, l_extendedprice as a, round(l_extendedprice / 10) * 10 as b from lineitem)
select l_returnflag, round(avg(power(a - b, 2)), 6) as mse, round(avg(abs(a - b)), 6) as mae, round(20 * log10(max(a) / sqrt(avg(power(a - b, 2)))), 6) as psnr, round(10 * log10(avg(a * a) / avg(power(a - b, 2))), 6) as snr, round(max(abs(a - b)), 6) as furthest, round(avg(abs(a - b) / greatest(abs(a), 1e-10)), 8) as relative from p group by 1""")  # fmt: skip
def recovered_quality(spark: SparkSession, d: str) -> DataFrame:
    """Errors between values and their rounded recovery: squared, absolute, peak and signal to noise, relative."""
    p = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("a"), (F.round(F.col("l_extendedprice") / 10) * 10).alias("b"))
    a, e = F.col("a"), F.abs(F.col("a") - F.col("b"))
    mse = F.avg(e * e)
    return p.groupBy("l_returnflag").agg(F.round(mse, 6).alias("mse"), F.round(F.avg(e), 6).alias("mae"), F.round(20 * F.log10(F.max(a) / F.sqrt(mse)), 6).alias("psnr"), F.round(10 * F.log10(F.avg(a * a) / mse), 6).alias("snr"), F.round(F.max(e), 6).alias("furthest"), F.round(F.avg(e / F.greatest(F.abs(a), F.lit(1e-10))), 8).alias("relative"))


@query("pooling", "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), r as (select vec_id, (generate_subscripts(a, 1) - 1) as i, unnest(a) as x from e) select vec_id, (i // 16)::int as y, (i % 8 // 2)::int as x, max(r.x) as most, round(avg(r.x), 6) + 0 as mean from r group by vec_id, i // 16, i % 8 // 2")
def pooling(spark: SparkSession, d: str) -> DataFrame:
    """Two by two pooling of each vector as an 8 x 8 image, in the array."""
    a = F.col("a")
    cell = lambda y, x: F.array(*(F.get(a, (y * 2 + i) * 8 + x * 2 + j) for i in (0, 1) for j in (0, 1)))
    rows = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.array_max(cell(y, x)).alias("most"), (total(cell(y, x)) / 4).alias("mean")) for y in range(4) for x in range(4)))
    return vectors(spark, d).select("vec_id", F.inline(rows)).select("vec_id", "y", "x", "most", (F.round("mean", 6) + 0.0).alias("mean"))


@query("batch_norm", "with r as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as i, unnest(embedding)::double as x from embeddings), m as (select i, avg(x) as m, var_pop(x) as v from r group by i) select vec_id, r.i, round((x - m) / sqrt(v + 1e-5), 5) + 0 as y from r join m on m.i = r.i")
def batch_norm(spark: SparkSession, d: str) -> DataFrame:
    """Per channel over all vectors: 64 channel moments, broadcast."""
    r = vectors(spark, d).select("vec_id", F.posexplode("a").alias("i", "x"))
    m = r.groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))  # a row for each channel
    return r.join(F.broadcast(m), "i").select("vec_id", "i", (F.round((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + 1e-5), 5) + 0.0).alias("y"))


@query("numeric_stability", """
with v as (select l_returnflag, case when l_linenumber = 7 then 'nan'::double when l_quantity = 50 then l_extendedprice * 1e300 * 1e10 when l_quantity = 1 then l_extendedprice * 1e-310 else l_extendedprice end as x from lineitem)
select l_returnflag, count(*) filter (where isnan(x))::bigint as nans, count(*) filter (where isinf(x))::bigint as infs, count(*) filter (where x <> 0 and not isnan(x) and abs(x) < 2.2250738585072014e-308)::bigint as denormals,
  round(sqrt(avg(x * x) filter (where isfinite(x))), 4) as rms, case when count(*) filter (where not isfinite(x)) > count(*) * 0.1 then 'unstable' when count(*) filter (where not isfinite(x)) > 0 then 'warning' else 'stable' end as class from v group by 1""")  # fmt: skip
def numeric_stability(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    x = F.when(F.col("l_linenumber") == 7, float("nan")).when(q == 50, p * 1e300 * 1e10).when(q == 1, p * 1e-310).otherwise(p)
    v = table(spark, d, "lineitem").select("l_returnflag", x.alias("x"))
    nan, inf = F.isnan("x"), F.abs("x") == float("inf")
    bad = F.count_if(nan | inf)
    return v.groupBy("l_returnflag").agg(F.count_if(nan).alias("nans"), F.count_if(inf).alias("infs"), F.count_if((F.col("x") != 0) & ~nan & (F.abs("x") < 2.2250738585072014e-308)).alias("denormals"), F.round(F.sqrt(F.avg(F.when(~nan & ~inf, F.col("x") * F.col("x")))), 4).alias("rms"), F.when(bad > F.count(F.lit(1)) * 0.1, "unstable").when(bad > 0, "warning").otherwise("stable").alias("class"))


@query("compression_figures", "select doc_id, round((1 - n_chars / nullif(octet_length(encode(text)), 0)::double) * 100, 6) + 0 as saved_percent, round(n_chars * 8 / nullif(octet_length(encode(text)), 0)::double, 6) as bits_per_byte from documents")
def compression_figures(spark: SparkSession, d: str) -> DataFrame:
    """Percent saved and bits a byte, with characters taken as the coded size."""
    r = F.try_divide(F.col("n_chars"), F.octet_length("text"))
    return table(spark, d, "documents").select("doc_id", (F.round((1 - r) * 100, 6) + 0.0).alias("saved_percent"), F.round(r * 8, 6).alias("bits_per_byte"))


@query("system_score", "with s as (select event_type, avg(value) as v, count(*) as n from events group by 1) select event_type, round(25 * least(1, v / 100) + 20 * least(1, n / 1000.0) + 20 * 0.5 + 15 * (1 - least(1, v / 100)) + 15 + 5, 6)::double as score, least(1, v / 100) >= 0.5 as meets from s")
def system_score(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    v = F.least(F.lit(1.0), F.col("v") / 100)
    return s.select("event_type", F.round(25 * v + 20 * F.least(F.lit(1.0), F.col("n") / 1000.0) + 20 * 0.5 + 15 * (1 - v) + 15 + 5, 6).alias("score"), (v >= 0.5).alias("meets"))


@query("synthetic_content", "select i::bigint as i, case i % 4 when 0 then 'text' when 1 then 'code' when 2 then 'structured' else 'repetitive' end as kind, case i % 4 when 0 then repeat('The quick brown fox jumps over the lazy dog. ', (i % 7 + 1)::int) when 1 then repeat('int f(int x) { return x; }' || chr(10), (i % 5 + 1)::int) when 2 then '{\"id\": ' || i || ', \"ok\": true}' else repeat(chr(97 + (i % 16)::int), 64) end as content from range(1000) r(i)")
def synthetic_content(spark: SparkSession, d: str) -> DataFrame:
    """A generator: a thousand rows in four kinds."""
    i = F.col("id")
    kind = F.when(i % 4 == 0, "text").when(i % 4 == 1, "code").when(i % 4 == 2, "structured").otherwise("repetitive")
    fox, code = F.lit("The quick brown fox jumps over the lazy dog. "), F.lit("int f(int x) { return x; }\n")
    content = F.when(i % 4 == 0, F.repeat(fox, (i % 7 + 1).cast("int"))).when(i % 4 == 1, F.repeat(code, (i % 5 + 1).cast("int"))).when(i % 4 == 2, F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "ok": true}'))).otherwise(F.repeat(F.char(97 + i % 16), F.lit(64)))
    return spark.range(1000).select(i.alias("i"), kind.alias("kind"), content.alias("content"))
