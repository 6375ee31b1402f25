"""Sequence windows, blocks, stream splits, segments and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.plans.registry import query, table

SIZE, OVERLAP = 100, 25


def tokens_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, w (the words), n."""
    w = F.filter(F.split(text, r"[ \n]"), lambda x: x != "")
    return df.select(key, w.alias("w")).withColumn("n", F.size("w"))


_TOKENS = "t as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\n]'), lambda x: x <> '') as w from documents where text is not null), n as (select doc_id, w, len(w) as n from t)"


def sliding(df: DataFrame, size: int, overlap: int, ratio: float = 0.0) -> DataFrame:
    """win_id, start, end and the overlaps with the windows before and after; the last window is clipped."""
    advance = max(1, int(size * (1 - ratio)) if ratio > 0 else size - overlap)
    x = df.where("n > 0").select("*", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(advance))).alias("win_id", "start"))
    end = F.least(F.col("start") + size, F.col("n"))
    last = F.col("start") + advance >= F.col("n")
    return x.withColumns({"end": end, "overlap_before": F.when(F.col("win_id") > 0, F.least(F.lit(size - advance), end - F.col("start"))).otherwise(0), "overlap_after": F.when(last, 0).otherwise(F.greatest(F.lit(0), end - F.col("start") - advance))})


@query("sliding_windows", f"""with {_TOKENS}, s as (select doc_id, w, n, unnest(range(0, n, 75)) as start from n where n > 0)
select doc_id, (start // 75)::int as win_id, start::int as start, least(start + 100, n)::int as end, case when start > 0 then least(25, least(start + 100, n) - start) else 0 end::int as overlap_before, case when start + 75 >= n then 0 else greatest(0, least(start + 100, n) - start - 75) end::int as overlap_after,
  md5(array_to_string(w[start + 1:least(start + 100, n)], ' ')) as md5 from s""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    s = sliding(tokens_of(table(spark, d, "documents"), "doc_id"), SIZE, OVERLAP)
    words = F.slice("w", F.col("start") + 1, F.col("end") - F.col("start"))
    return s.select("doc_id", "win_id", "start", "end", "overlap_before", "overlap_after", F.md5(F.array_join(words, " ").cast("binary")).alias("md5"))


@query("window_statistics", f"""with {_TOKENS}, s as (select doc_id, n, unnest(range(0, n, 75)) as start from n where n > 0)
select doc_id, count(*)::bigint as windows, any_value(n)::bigint as tokens, sum(least(start + 100, n) - start)::bigint as window_tokens, round(any_value(n) / sum(least(start + 100, n) - start), 6)::double as efficiency from s group by doc_id""")
def window_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = sliding(tokens_of(table(spark, d, "documents"), "doc_id").drop("w"), SIZE, OVERLAP)
    total = F.sum(F.col("end") - F.col("start"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.first("n").cast("long").alias("tokens"), total.alias("window_tokens"), F.round(F.first("n") / total, 6).alias("efficiency"))


@query("window_at", f"with {_TOKENS} select doc_id, (n // 2)::int as at, array_to_string(w[n // 2 + 1:n // 2 + 8], ' ') as words, round(least(1, n / 2000), 6)::double as progress from n")
def window_at(spark: SparkSession, d: str) -> DataFrame:
    """Eight words from the middle on, and progress towards 2000 words."""
    t = tokens_of(table(spark, d, "documents").where("text is not null"), "doc_id")
    mid = F.floor(F.col("n") / 2).cast("int")
    return t.select("doc_id", mid.alias("at"), F.array_join(F.slice("w", mid + 1, F.lit(8)), " ").alias("words"), F.round(F.least(F.lit(1.0), F.col("n") / 2000), 6).alias("progress"))


@query("window_sizes", f"with {_TOKENS} select doc_id, least(500, greatest(50, floor(n * 0.75)::bigint))::bigint as optimal, case when n < 100 then greatest(50, n) else 100 end::bigint as adaptive, (50 <= 100 and 100 <= 500 and 25 < 100) as valid from n")
def window_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size for three quarters of a memory of 12 bytes a token, size that shrinks at the end, and a check of the settings."""
    n = F.col("n").cast("long")
    low, high = F.lit(50).cast("long"), F.lit(500).cast("long")
    best = F.least(high, F.greatest(low, F.floor(n * 12 * 0.75 / 12)))
    return tokens_of(table(spark, d, "documents").where("text is not null"), "doc_id").select("doc_id", best.alias("optimal"), F.when(n < SIZE, F.greatest(low, n)).otherwise(F.lit(SIZE).cast("long")).alias("adaptive"), F.lit(50 <= SIZE <= 500 and OVERLAP < SIZE).alias("valid"))


@query("padded_blocks", f"with {_TOKENS}, s as (select doc_id, n, unnest(range(0, n, 64)) as start from n where n > 0) select doc_id, (start // 64)::int as block, greatest(0, start + 64 - n)::int as padding from s")
def padded_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 64 words, the last padded with zeros: the padding of each."""
    t = tokens_of(table(spark, d, "documents"), "doc_id").where("n > 0")
    return t.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(64))).alias("block", "start")).select("doc_id", "block", F.greatest(F.lit(0), F.col("start") + 64 - F.col("n")).alias("padding"))


def split_streams(n: Column, streams: int) -> Column:
    """array<struct<stream, start, length>>: the first n % streams streams have one more."""
    each, rest = F.floor(n / streams).cast("int"), (n % streams).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(streams - 1)), lambda s: F.struct(s.alias("stream"), (s * each + F.least(s, rest)).alias("start"), (each + F.when(s < rest, 1).otherwise(0)).alias("length")))


@query("stream_split", "select doc_id, s as stream, (s * (n_chars // 4) + least(s, n_chars % 4))::int as start, (n_chars // 4 + (s < n_chars % 4)::int)::int as length from documents, (values (0), (1), (2), (3)) v(s)")
def stream_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(split_streams(F.col("n_chars"), 4)))


@query("block_schedule", "select doc_id, b as block, (b * (greatest(1000 // 64, 1) * 64))::bigint as start, least(greatest(1000 // 64, 1) * 64, n_chars - b * (greatest(1000 // 64, 1) * 64))::bigint as length from (select doc_id, n_chars, unnest(range(0, (n_chars + 959) // 960))::int as b from documents where n_chars > 0) q")
def block_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a whole number of segments times streams (16 x 4), the last one the rest."""
    size = max(1000 // 64, 1) * 64
    t = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "n_chars", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(size).cast("long"))).alias("block", "start"))
    return t.select("doc_id", "block", "start", F.least(F.lit(size), F.col("n_chars") - F.col("start")).cast("long").alias("length"))


@query("segments", f"with {_TOKENS}, s as (select doc_id, n, unnest(range(0, n, greatest(1, (n + 15) // 16))) as start from n where n > 0) select doc_id, (row_number() over (partition by doc_id order by start))::int as segment, start::int as start, least(start + greatest(1, (n + 15) // 16), n)::int as end, (4 * start // n)::int as level from s")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """At most 16 segments that hold the whole text, and the quarter each starts in."""
    t = tokens_of(table(spark, d, "documents"), "doc_id").where("n > 0")
    size = F.greatest(F.lit(1), F.ceil(F.col("n") / 16).cast("int"))
    x = t.select("doc_id", "n", size.alias("size"), F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, size)).alias("i", "start"))
    return x.select("doc_id", (F.col("i") + 1).alias("segment"), "start", F.least(F.col("start") + F.col("size"), F.col("n")).alias("end"), F.floor(4 * F.col("start") / F.col("n")).cast("int").alias("level"))


@query("structure", r"""
select doc_id, (len(regexp_extract_all(text, '\n')) + 1)::bigint as paragraphs, len(regexp_extract_all(text, '[.!?]'))::bigint as sentences, len(regexp_extract_all(text, '\n[#A-Z]'))::bigint as sections,
  case when len(regexp_extract_all(text, '[.!?]')) < 5 then 'simple' when len(regexp_extract_all(text, '[.!?]')) < 50 then 'moderate' else 'complex' end as complexity from documents where text is not null""")  # fmt: skip
def structure(spark: SparkSession, d: str) -> DataFrame:
    n = lambda r: F.regexp_count("text", F.lit(r)).cast("long")
    s = n("[.!?]")
    return table(spark, d, "documents").where("text is not null").select("doc_id", (n("\n") + 1).alias("paragraphs"), s.alias("sentences"), n("\n[#A-Z]").alias("sections"), F.when(s < 5, "simple").when(s < 50, "moderate").otherwise("complex").alias("complexity"))


@query("sections_in_order", r"""
with l as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null), x as (select doc_id, generate_subscripts(a, 1) - 1 as i, unnest(a) as line, len(a) as n from l)
select doc_id, i::int as line_no, (coalesce(lag(line) over w, '') = '' or i = 0) as starts_section, length(line)::int as chars, (4 * i // n)::int as quarter from x window w as (partition by doc_id order by i)""")  # fmt: skip
def sections_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines with whether an empty line (or nothing) stands before, and the quarter they stand in; no window is needed: a line sees its array."""
    lines = F.split("text", "\n", -1)
    t = table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("a"))
    rows = F.transform("a", lambda x, i: F.struct(i.alias("line_no"), ((i == 0) | (F.get("a", i - 1) == "")).alias("starts_section"), F.length(x).alias("chars"), F.floor(4 * i / F.size("a")).cast("int").alias("quarter")))
    return t.select("doc_id", F.inline(rows))


def pad_pairs(pairs: Column, n: Column, kind: str) -> Column:
    """The byte pairs (hex) padded to n: with zeros, by repeating, or by turns back and forth."""
    size = F.size(pairs)
    if kind == "zero":
        return F.concat(pairs, F.array_repeat(F.lit("00"), F.greatest(F.lit(0), n - size)))
    unit = pairs if kind == "repeat" else F.concat(F.reverse(pairs), pairs)
    whole = F.flatten(F.array_repeat(unit, F.ceil(n / size).cast("int")))
    return F.slice(F.concat(pairs, whole), 1, n)


@query("padding", """
with p as (select item_id, regexp_extract_all(hex(encode(text)), '..') as a from benchmark where length(text) > 0), q as (select item_id, a, len(a) as k, ((len(a) * 5 // 2) + 7)::int as n from p)
select item_id, n, md5(array_to_string(list_concat(a, list_transform(range(n - k), lambda i: '00')), '')) as zero, md5(array_to_string(list_transform(range(n), lambda i: a[i % k + 1]), '')) as repeated,
  md5(array_to_string(list_transform(range(n), lambda i: case when i < k then a[i + 1] when ((i - k) // k) % 2 = 0 then a[k - (i - k) % k] else a[(i - k) % k + 1] end), '')) as reflected from q""")  # fmt: skip
def padding(spark: SparkSession, d: str) -> DataFrame:
    """Each text padded to two and a half times its bytes and seven more, three ways."""
    p = table(spark, d, "benchmark").where("length(text) > 0").select("item_id", F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("(..)"), 1).alias("a"))
    p = p.withColumn("n", (F.floor(F.size("a") * 5 / 2) + 7).cast("int"))
    md5 = lambda kind: F.md5(F.array_join(pad_pairs(F.col("a"), F.col("n"), kind), "").cast("binary"))
    return p.select("item_id", "n", md5("zero").alias("zero"), md5("repeat").alias("repeated"), md5("reflect").alias("reflected"))


@query("recent_symbols", "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc, role, text) <= 4")
def recent_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The last four turns of each conversation, as a ring of that size keeps them."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("k")).where("k <= 4").drop("k")
