"""Patterns and n-grams of bytes: mining, search, scores, candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.functions.byteview import BYTES_SQL, byte_profile, map_bytes
from stratalyte.plans.registry import query, table

TOP = 16
PATTERN_BUFFER = 4096
_NEXT = "nx as (select doc_id, pos, b, lead(b) over (partition by doc_id order by pos) as nb from bytes)"


def top_pairs(b: np.ndarray, k: int = TOP) -> tuple[list[int], list[int]]:
    """Codes and counts of the most frequent byte pairs, ties to the least code."""
    code, n = np.unique(b[:-1].astype(np.int64) * 256 + b[1:], return_counts=True) if len(b) > 1 else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((code, -n))[:k]
    return code[order].tolist(), n[order].tolist()


@query("top_byte_pairs", f"""with {BYTES_SQL}, {_NEXT}, c as (select doc_id, b * 256 + nb as pair, count(*) as n from nx where nb is not null group by 1, 2)
select doc_id, pair::bigint as pair, n::bigint as n, (row_number() over (partition by doc_id order by n desc, pair))::int as rank from c qualify rank <= {TOP}""")
def top_byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The 16 most frequent pairs of each whole text (the number is the feature)."""
    p = map_bytes(table(spark, d, "documents"), "doc_id", "text", top_pairs, {"pairs": "array<long>", "counts": "array<long>"})
    return p.select("doc_id", F.posexplode(F.arrays_zip("pairs", "counts")).alias("i", "x")).select("doc_id", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"), (F.col("i") + 1).alias("rank"))


@query("repetition", f"""with {BYTES_SQL}, {_NEXT},
g2 as (select doc_id, pos, max(pos) over (partition by doc_id, b, nb) - pos as gap from nx where nb is not null), r2 as (select doc_id, count(*) filter (where gap >= 2) as again2 from g2 group by doc_id),
q4 as (select doc_id, pos, b, lead(b, 1) over w as b1, lead(b, 2) over w as b2, lead(b, 3) over w as b3 from bytes window w as (partition by doc_id order by pos)),
g4 as (select doc_id, max(pos) over (partition by doc_id, b, b1, b2, b3) > pos as later from q4 where b3 is not null and pos % 4 = 0), r4 as (select doc_id, avg(later::int) as ratio from g4 group by doc_id)
select d.doc_id, round(coalesce(ratio, 0), 6) as block_ratio, least(100, coalesce(again2, 0))::bigint as pair_repeats from documents d left join r2 using (doc_id) left join r4 using (doc_id)""")
def repetition(spark: SparkSession, d: str) -> DataFrame:
    """Share of aligned four-byte blocks that come again, and repeated pairs up to a hundred."""
    docs = table(spark, d, "documents")
    r = byte_profile(docs, extra=("repeats",))
    blocks = F.greatest(F.floor(F.col("n") / 4), F.lit(0))
    return r.select("doc_id", F.round(F.coalesce(F.try_divide(F.col("blocks4"), blocks), F.lit(0.0)), 6).alias("block_ratio"), F.least(F.col("again2"), F.lit(100)).alias("pair_repeats"))


def pattern_table(df: DataFrame, key: str, text: str, *, length: int = 4, samples: int = 50) -> DataFrame:
    """Patterns at evenly spaced places of each text: frequency, first and last place, mean distance, score."""
    n = F.length(text)
    step = F.greatest(F.floor(n / samples), F.lit(1))
    at = df.where(n >= length).select(key, F.col(text).alias("t"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), (n - length).cast("long"), step)).alias("pos"))
    at = at.select(key, "n", "pos", F.substring("t", (F.col("pos") + 1).cast("int"), F.lit(length)).alias("pattern"))
    g = at.groupBy(key, "pattern").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("n").alias("n"))
    mean = F.when(F.col("freq") > 1, (F.col("last") - F.col("first")) / (F.col("freq") - 1)).otherwise(0.0)
    recency = 1 / (1 + (F.col("n") - F.col("last")) / 100)
    score = F.log(F.col("freq") + 1) / 10 * 0.4 + recency * 0.3 + length / 8 * 0.2 + 0.1
    return g.select(key, "pattern", "freq", "first", "last", F.round(mean, 6).alias("mean_distance"), F.round(score, 6).alias("score"))


@query("pattern_scores", """
with a as (select doc_id, text, length(text) as n, unnest(range(0, length(text) - 3, greatest(1, length(text) // 50))) as pos from documents where length(text) >= 4),
g as (select doc_id, substr(text, pos + 1, 4) as pattern, count(*) as freq, min(pos) as first, max(pos) as last, max(n) as n from a group by 1, 2)
select doc_id, pattern, freq::bigint as freq, first, last, round(case when freq > 1 then (last - first) / (freq - 1) else 0 end::double, 6) as mean_distance,
  round((ln(freq + 1) / 10 * 0.4 + 1 / (1 + (n - last) / 100) * 0.3 + 0.5 * 0.2 + 0.1)::double, 6) as score from g""")  # fmt: skip
def pattern_scores(spark: SparkSession, d: str) -> DataFrame:
    return pattern_table(table(spark, d, "documents"), "doc_id", "text")


@query("pattern_summary", """
with a as (select doc_id, text, unnest(range(0, length(text) - 3, greatest(1, length(text) // 50))) as pos from documents where length(text) >= 4),
g as (select doc_id, substr(text, pos + 1, 4) as pattern, count(*) as freq from a group by 1, 2)
select doc_id, count(*)::bigint as patterns, sum(freq)::bigint as samples, max(freq)::bigint as most, round(avg(freq), 6) as mean_frequency from g group by doc_id""")  # fmt: skip
def pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    g = pattern_table(table(spark, d, "documents"), "doc_id", "text")
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("patterns"), F.sum("freq").alias("samples"), F.max("freq").alias("most"), F.round(F.avg("freq"), 6).alias("mean_frequency"))


def find_all(data: np.ndarray, needle: bytes) -> np.ndarray:
    """Every place, overlapping ones too, where the needle starts."""
    if not needle or len(data) < len(needle):
        return np.zeros(0, np.int64)
    hit = np.ones(len(data) - len(needle) + 1, bool)
    for i, c in enumerate(needle):
        hit &= data[i : len(data) - len(needle) + 1 + i] == c
    return np.flatnonzero(hit)


@query("exact_search", f"""with {BYTES_SQL}, {_NEXT}, h as (select doc_id, pos from nx where b = 101 and nb = 101 or b = 101 and nb = 110)
select d.doc_id, count(pos)::bigint as matches, coalesce(min(pos), -1)::bigint as first, coalesce(max(pos), -1)::bigint as last, coalesce(sum(pos), 0)::bigint as total from documents d left join h using (doc_id) group by d.doc_id""")
def exact_search(spark: SparkSession, d: str) -> DataFrame:
    """All places of `ee` (which may overlap) and `en`."""

    def found(b: np.ndarray) -> tuple[int, int, int, int]:
        at = np.concatenate([find_all(b, b"ee"), find_all(b, b"en")])
        return (len(at), int(at.min()), int(at.max()), int(at.sum())) if len(at) else (0, -1, -1, 0)

    return map_bytes(table(spark, d, "documents"), "doc_id", "text", found, {"matches": "long", "first": "long", "last": "long", "total": "long"})


@query("benchmark_search", """
select item_id, count(*)::bigint as documents, min(doc_id) as first_doc from benchmark b join documents d on contains(d.text, b.text) group by item_id""")
def benchmark_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a benchmark text as it is. Texts meet on hashes of words at each place, then are compared."""
    size = 6
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    gram = lambda a, i: F.xxhash64(F.slice(a, i, size))
    bench = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"), words("text").alias("w"))
    # The first and last words of an item may be part of a longer word in a document: the second to the seventh are whole.
    keys = bench.where(F.size("w") >= size + 2).select("item_id", "needle", gram("w", 2).alias("k"))
    short = bench.where(F.size("w") < size + 2).select("item_id", "needle")
    docs = table(spark, d, "documents").select("doc_id", "text", words("text").alias("w"))
    grams = docs.where(F.size("w") >= size).select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: gram(F.col("w"), i)))).alias("k"))
    hits = grams.join(F.broadcast(keys), "k").where(F.contains("text", "needle")).select("item_id", "doc_id").distinct()
    few = docs.join(F.broadcast(short), F.contains("text", "needle")).select("item_id", "doc_id")
    return hits.unionByName(few).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@query("lru_eviction", """
with l as (select user_id, event_type, max(ts) as last_access, count(*) as uses from events group by 1, 2)
select user_id, event_type, uses::bigint as uses, (row_number() over (order by last_access desc, user_id, event_type) <= 20) as kept from l""")  # fmt: skip
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Entries by latest use; the cache's capacity (20) is the feature. Only the kept ones are ranked."""
    entries = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("uses"))
    kept = entries.orderBy(F.desc("last_access"), "user_id", "event_type").limit(20).select("user_id", "event_type", F.lit(True).alias("kept"))
    return entries.join(F.broadcast(kept), ["user_id", "event_type"], "left").select("user_id", "event_type", "uses", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("prediction_candidates", f"""with {BYTES_SQL}, l as (select doc_id, b, count(*) as c, max(pos) as last from bytes group by 1, 2),
s as (select l.doc_id, b, c, c / n as freq, exp(-(n - 1 - last) / 64.0) as recency, h / 8 as ent from l join totals using (doc_id) join ent using (doc_id)),
r as (select *, row_number() over (partition by doc_id order by c desc, b) as k from s),
f as (select doc_id, b, k, round((0.3 * (1 - ent) + 0.25 * freq + 0.3 * 0 + 0.15 * recency)::double, 6) as score from r where k <= {TOP})
select doc_id, b as byte, k::int as rank, score, (row_number() over (partition by doc_id order by score desc, b) = 1) as best from f""")
def prediction_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 16 most frequent bytes of each text, scored by entropy, frequency and recency; the best is marked."""

    def top(b: np.ndarray) -> tuple[list[int], list[int], list[int], int, float]:
        n = np.bincount(b, minlength=256)
        last = np.full(256, -1)
        last[b] = np.arange(len(b))
        order = np.lexsort((np.arange(256), -n))[: min(TOP, int((n > 0).sum()))]
        p = n[n > 0] / max(1, len(b))
        return order.tolist(), n[order].tolist(), last[order].tolist(), len(b), float(-(p * np.log2(p)).sum())

    p = map_bytes(table(spark, d, "documents"), "doc_id", "text", top, {"byte": "array<int>", "c": "array<long>", "last": "array<long>", "n": "long", "h": "double"})
    x = p.select("doc_id", "n", "h", F.posexplode(F.arrays_zip("byte", "c", "last")).alias("k", "x"))
    score = 0.3 * (1 - F.col("h") / 8) + 0.25 * F.col("x.c") / F.col("n") + 0.15 * F.exp(-(F.col("n") - 1 - F.col("x.last")) / 64.0)
    s = x.select("doc_id", F.col("x.byte").alias("byte"), (F.col("k") + 1).alias("rank"), F.round(score, 6).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "byte")
    return s.withColumn("best", F.row_number().over(w) == 1)


@query("prediction_scores", f"""with {BYTES_SQL}, l as (select doc_id, b, count(*) as c, max(pos) as last, count(*) filter (where pos >= n - {PATTERN_BUFFER}) / least(n, {PATTERN_BUFFER}) as pattern from bytes join totals using (doc_id) group by doc_id, b, n),
s as (select l.doc_id, b, c, pattern, c / n as freq, exp(-(n - 1 - last) / 64.0) as recency, h / 8 as ent from l join totals using (doc_id) join ent using (doc_id)),
r as (select *, row_number() over (partition by doc_id order by c desc, b) as k from s),
f as (select doc_id, b, k, round((0.3 * (1 - ent) + 0.25 * freq + 0.3 * pattern + 0.15 * recency)::double, 6) as score from r where k <= {TOP})
select doc_id, b as byte, k::int as rank, score, (row_number() over (partition by doc_id order by score desc, b) = 1) as best from f""")
def prediction_scores(spark: SparkSession, d: str) -> DataFrame:
    """`prediction_candidates` with the fourth factor, the byte's share of the pattern buffer: the last 4096 bytes (the size is the feature)."""

    def top(b: np.ndarray) -> tuple[list[int], list[int], list[int], list[int], int, float]:
        n = np.bincount(b, minlength=256)
        late = np.bincount(b[-PATTERN_BUFFER:], minlength=256)
        last = np.full(256, -1)
        last[b] = np.arange(len(b))
        order = np.lexsort((np.arange(256), -n))[: min(TOP, int((n > 0).sum()))]
        p = n[n > 0] / max(1, len(b))
        return order.tolist(), n[order].tolist(), last[order].tolist(), late[order].tolist(), len(b), float(-(p * np.log2(p)).sum())

    p = map_bytes(table(spark, d, "documents"), "doc_id", "text", top, {"byte": "array<int>", "c": "array<long>", "last": "array<long>", "late": "array<long>", "n": "long", "h": "double"})
    x = p.select("doc_id", "n", "h", F.posexplode(F.arrays_zip("byte", "c", "last", "late")).alias("k", "x"))
    score = 0.3 * (1 - F.col("h") / 8) + 0.25 * F.col("x.c") / F.col("n") + 0.3 * F.col("x.late") / F.least("n", F.lit(PATTERN_BUFFER)) + 0.15 * F.exp(-(F.col("n") - 1 - F.col("x.last")) / 64.0)
    s = x.select("doc_id", F.col("x.byte").alias("byte"), (F.col("k") + 1).alias("rank"), F.round(score, 6).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "byte")
    return s.withColumn("best", F.row_number().over(w) == 1)


@query("prediction_feedback", """
with p as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as guess from events)
select user_id, count(*)::bigint as guesses, count(*) filter (where guess = event_type)::bigint as correct, round(avg((guess = event_type)::int), 6) as accuracy from p where guess is not null group by user_id""")  # fmt: skip
def prediction_feedback(spark: SparkSession, d: str) -> DataFrame:
    """How often the last event of a user foretells the next."""
    p = table(spark, d, "events").select("user_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("guess")).where("guess is not null")
    right = F.col("guess") == F.col("event_type")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("guesses"), F.count_if(right).alias("correct"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


@query("coherence", f"""with {BYTES_SQL}, {_NEXT}, c as (select doc_id, avg((abs(nb - b) < 10)::int) as coherence, count(*) filter (where b in (91, 40) and nb between 48 and 57) as refs from nx where nb is not null group by doc_id),
m as (select d.doc_id, coalesce(coherence, 0) as coherence, coalesce(refs, 0) as refs, coalesce(h, 0) / 8 as density from documents d left join c using (doc_id) left join ent using (doc_id))
select doc_id, round(coherence, 6) as coherence, refs::bigint as cross_references, case when round(coherence + density * 2, 9) < 1 then 'surface' when round(coherence + density * 2, 9) < 1.5 then 'semantic' when round(coherence + density * 2, 9) < 2 then 'conceptual' when round(coherence + density * 2, 9) < 2.5 then 'contextual' else 'comprehensive' end as understanding from m""")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    """Share of small steps between neighbouring bytes, bracketed numbers, and a level by thresholds."""

    def of(b: np.ndarray) -> tuple[float, int, float]:
        v = b.astype(np.int64)
        p = np.bincount(b, minlength=256)
        p = p[p > 0] / max(1, len(b))
        digit = (v[1:] >= 48) & (v[1:] <= 57)
        return (float((np.abs(np.diff(v)) < 10).mean()) if len(v) > 1 else 0.0, int((((v[:-1] == 91) | (v[:-1] == 40)) & digit).sum()), float(-(p * np.log2(p)).sum()) / 8)

    m = map_bytes(table(spark, d, "documents"), "doc_id", "text", of, {"coherence": "double", "cross_references": "long", "density": "double"})
    total = F.round(F.col("coherence") + F.col("density") * 2, 9)
    level = F.when(total < 1, "surface").when(total < 1.5, "semantic").when(total < 2, "conceptual").when(total < 2.5, "contextual").otherwise("comprehensive")
    return m.select("doc_id", F.round("coherence", 6).alias("coherence"), "cross_references", level.alias("understanding"))


@query("error_recurrence", "select event_id, (count(*) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) > 3) as recurrent from events")
def error_recurrence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", (F.count(F.lit(1)).over(w) > 3).alias("recurrent"))
