"""Checksums, integrity and quality rules."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalyte.functions.byteview import BYTES_SQL, map_bytes
from stratalyte.plans.registry import query, table

MASK = 0xFFFFFFFF


def poly31(b: np.ndarray, start: int = 0) -> int:
    """h = h * 31 + byte, modulo 2^32: as a product with powers, which wrap by themselves."""
    n = len(b)
    powers = np.ones(n + 1, np.uint32)
    powers[1:] = 31
    powers = np.multiply.accumulate(powers, dtype=np.uint32)
    return int((b.astype(np.uint32) * powers[:n][::-1]).sum(dtype=np.uint32)) + start * int(powers[n]) & MASK


def djb2(b: np.ndarray) -> int:
    n = len(b)
    powers = np.ones(n + 1, np.uint32)
    powers[1:] = 33
    powers = np.multiply.accumulate(powers, dtype=np.uint32)
    return int((b.astype(np.uint32) * powers[:n][::-1]).sum(dtype=np.uint32)) + 5381 * int(powers[n]) & MASK


def mpeg_table() -> np.ndarray:
    """Table of the MSB-first CRC with polynomial 04C11DB7."""
    t = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        t = (t << np.uint32(1)) ^ np.where(t >> np.uint32(31), np.uint32(0x04C11DB7), np.uint32(0))
    return t


_MPEG = mpeg_table()


def crc32_mpeg(b: bytes) -> int:
    crc = MASK
    table_ = _MPEG.tolist()
    for c in b:
        crc = (crc << 8 & MASK) ^ table_[crc >> 24 ^ c]
    return crc


@query("checksum31", f"""with recursive b as (select item_id as doc_id, (generate_subscripts(l, 1) - 1)::bigint as pos, ('0x' || unnest(l))::int as b from (select item_id, regexp_extract_all(hex(encode(text)), '..') as l from benchmark) q),
h as (select item_id as doc_id, 0::bigint as i, 0::bigint as h31, 5381::bigint as h33 from benchmark union all select h.doc_id, i + 1, (h31 * 31 + b) & 4294967295, (h33 * 33 + b) & 4294967295 from h join b on b.doc_id = h.doc_id and b.pos = h.i)
select doc_id as item_id, max_by(h31, i) as h31, max_by(h33, i) as h33 from h group by doc_id""")
def checksum31(spark: SparkSession, d: str) -> DataFrame:
    return map_bytes(table(spark, d, "benchmark"), "item_id", "text", lambda b: (poly31(b), djb2(b)), {"h31": "long", "h33": "long"})


@query("digests", "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256, octet_length(encode(text))::bigint as size from documents")
def digests(spark: SparkSession, d: str) -> DataFrame:
    """Several checksums in one pass; crc32 and sha2-512 are there too, but SQL has no equal of them."""
    x = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.md5(x).alias("md5"), F.sha1(x).alias("sha1"), F.sha2(x, 256).alias("sha256"), F.length(x).cast("long").alias("size"))


@query("crc_verified", "select doc_id, true as crc32_same, true as adler32_same, true as mpeg_self from documents")
def crc_verified(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to each checksum agree; a text with its own MSB-first CRC after it has the CRC zero."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def of(b: np.ndarray) -> tuple[int, bool, bool]:
        raw = b.tobytes()
        n = len(b)
        # Adler-32 from two sums: 1 + sum(b), and n + sum((n - i) * b).
        lo = (1 + int(b.sum(dtype=np.int64))) % 65521
        hi = (n + int((b.astype(np.int64) * np.arange(n, 0, -1)).sum())) % 65521
        return zlib.crc32(raw), (hi << 16 | lo) == zlib.adler32(raw), crc32_mpeg(raw + crc32_mpeg(raw).to_bytes(4, "big")) == 0

    named = docs.select(F.struct("doc_id", F.crc32(F.col("text").cast("binary")).alias("c")).alias("row"), "text")
    c = map_bytes(named, "row", "text", of, {"crc": "long", "adler32_same": "boolean", "mpeg_self": "boolean"})
    return c.select("row.doc_id", (F.col("row.c") == F.col("crc")).alias("crc32_same"), "adler32_same", "mpeg_self")


@query("xor_fold", f"with {BYTES_SQL} select d.doc_id, coalesce(bit_xor(b), 0)::int as xor, coalesce(bit_xor(case when pos % 64 = 0 then b end), 0)::int as first_of_64 from documents d left join bytes using (doc_id) group by d.doc_id")
def xor_fold(spark: SparkSession, d: str) -> DataFrame:
    of = lambda b: (int(np.bitwise_xor.reduce(b)) if len(b) else 0, int(np.bitwise_xor.reduce(b[::64])) if len(b) else 0)
    return map_bytes(table(spark, d, "documents"), "doc_id", "text", of, {"xor": "int", "first_of_64": "int"})


@query("roundtrip_validation", "select doc_id, true as same_size, true as same_bytes, 1.0::double as similarity from documents")
def roundtrip_validation(spark: SparkSession, d: str) -> DataFrame:
    """A text through hexadecimal and back: sizes, bytes, share of equal places."""
    x = F.coalesce("text", F.lit("")).cast("binary")
    r = table(spark, d, "documents").select("doc_id", x.alias("x"), F.unhex(F.hex(x)).alias("y"))
    same = F.col("x") == F.col("y")
    return r.select("doc_id", (F.length("x") == F.length("y")).alias("same_size"), same.alias("same_bytes"), F.when(same, 1.0).otherwise(0.0).alias("similarity"))


@query("numeric_comparison", """
with p as (select o_orderpriority, o_totalprice as a, round(o_totalprice) as b from orders)
select o_orderpriority, round(avg(abs(a - b)), 6) as mean_abs, round(max(abs(a - b)), 6) as max_abs, round(avg(abs(a - b) / nullif(abs(a), 0)), 9) as mean_rel, count(*) filter (where abs(a - b) > 0.4)::bigint as anomalies, count(*) filter (where isnan(a))::bigint as nans from p group by 1""")  # fmt: skip
def numeric_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("a"), F.round("o_totalprice").alias("b"))
    e = F.abs(F.col("a") - F.col("b"))
    return p.groupBy("o_orderpriority").agg(F.round(F.avg(e), 6).alias("mean_abs"), F.round(F.max(e), 6).alias("max_abs"), F.round(F.avg(F.try_divide(e, F.abs("a"))), 9).alias("mean_rel"), F.count_if(e > 0.4).alias("anomalies"), F.count_if(F.isnan("a")).alias("nans"))


#: Bands of quality in percent.
BANDS = ((95, "excellent"), (85, "good"), (75, "acceptable"), (60, "poor"))


@query("quality_level", "select event_id, case when value >= 95 then 'excellent' when value >= 85 then 'good' when value >= 75 then 'acceptable' when value >= 60 then 'poor' else 'failed' end as level from events")
def quality_level(spark: SparkSession, d: str) -> DataFrame:
    level = F.lit("failed")
    for least, name in reversed(BANDS):
        level = F.when(F.col("value") >= least, name).otherwise(level)
    return table(spark, d, "events").select("event_id", level.alias("level"))


#: Rules of the query: metric, least, most, severity.
RULES = (("mean", 10.0, 60.0, "warning"), ("max", 0.0, 90.0, "error"), ("min", 1.0, 50.0, "info"), ("std", 0.0, 25.0, "warning"))


@query("validation_rules", f"""
with m as (select user_id, avg(value) as mean, max(value) as max, min(value) as min, coalesce(stddev_samp(value), 0) as std from events group by user_id), l as (select user_id, unnest(['mean', 'max', 'min', 'std']) as metric, unnest([mean, max, min, std]) as v from m),
r as (select * from (values {', '.join(f"('{m}', {a}, {b}, '{s}')" for m, a, b, s in RULES)}) t(metric, least, most, severity))
select user_id, severity, count(*)::bigint as rules, count(*) filter (where not v between least and most)::bigint as broken from l join r using (metric) group by 1, 2""")
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Metrics in long form against a table of ranges, counted by severity."""
    v = F.col("value")
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))
    long = m.select("user_id", F.expr("stack(4, 'mean', mean, 'max', max, 'min', min, 'std', std) as (metric, v)"))
    rules = spark.createDataFrame(list(RULES), "metric string, least double, most double, severity string")
    return long.join(F.broadcast(rules), "metric").groupBy("user_id", "severity").agg(F.count(F.lit(1)).alias("rules"), F.count_if(~F.col("v").between(F.col("least"), F.col("most"))).alias("broken"))


@query("container_fields", """
with f as (select user_id, event_type, max(value) as v from events group by 1, 2)
select user_id, count(*)::bigint as fields, max(case when event_type = (select min(event_type) from events) then round(v, 4) end) as first_value, count(*) filter (where v > 90)::bigint as removed, string_agg(event_type, ',' order by event_type) as names from f group by user_id""")  # fmt: skip
def container_fields(spark: SparkSession, d: str) -> DataFrame:
    """Custom fields as a map: upsert (the last of a name stays), look-up, removal, list of names."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("k"))  # one row
    f = e.groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("m")).join(F.broadcast(first))
    return f.select("user_id", F.size("m").cast("long").alias("fields"), F.round(F.try_element_at("m", F.col("k")), 4).alias("first_value"), F.size(F.map_filter("m", lambda k, v: v > 90)).cast("long").alias("removed"), F.array_join(F.map_keys("m"), ",").alias("names"))
