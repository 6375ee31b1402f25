"""The registered queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm
from .common import table
from .decontaminate import find_leaks
from .langid import identify
from .linededup import dedup_lines
from .packing import pack
from .quality import quality
from .simhash import near_duplicates
from .tokenfile import roundtrip
from .urlfilter import judge
from .vptree import nearest, usable


def op1_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "documents"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed")
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs: those whose path ends in the number of a labelled document; blocked if it is poor or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    numbered = pages.select("url", F.regexp_extract("url", r"://[^/?#]+/[a-z]+/(\d{1,18})", 1).alias("n")).where("n <> ''").select("url", F.col("n").cast("long").alias("doc_id"))
    labelled = numbered.join(labels.select("doc_id", "quality", "toxic"), "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("blocked"))
    return judge(pages, labelled)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(base, base.where("id % 50 = 0"), k=5)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), order=3)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokenfile": op1_tokenfile,
    "op2_linededup": op2_linededup,
    "op3_urlfilter": op3_urlfilter,
    "op4_decontaminate": op4_decontaminate,
    "op5_neighbours": op5_neighbours,
    "op6_lm": op6_lm,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
}

_OP2 = r"""
with lines as (
  select doc_id, li, line, length(line) - length(replace(line, ' ', '')) + 1 >= 50 as lng
  from (select doc_id, generate_subscripts(l, 1) as li, unnest(l) as line
        from (select doc_id, list_filter(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), lambda x: x <> '') as l from documents)) q),
units as (
  select doc_id, li, lng, generate_subscripts(p, 1) as ui, unnest(p) as u
  from (select doc_id, li, lng, case when lng then list_filter(string_split_regex(regexp_replace(line, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1)), lambda x: x <> '') else [line] end as p from lines) q),
hashed as (
  select *, ('0x' || substr(md5(u), 1, 8))::bigint as h, row_number() over (partition by doc_id order by li, ui) as i from units),
hardened as (
  select *, coalesce(i = 1 or (ui = 1 and (lng or lag(lng) over w)), true) as hard,
         (lag(h, 1) over w * 31 + lag(h, 2) over w * 7) % 4 = 0 as rolled
  from hashed window w as (partition by doc_id order by i)),
cands as (
  select *, coalesce(rolled and not hard and not lag(hard) over w and not lead(hard) over w, false) as cand
  from hardened window w as (partition by doc_id order by i)),
starts as (
  select *, hard or (cand and not coalesce(lag(cand) over w, false)) as s from cands window w as (partition by doc_id order by i)),
numbered as (select *, sum(s::int) over (partition by doc_id order by i) as k from starts),
chunks as (select doc_id, k, string_agg(u, '' order by i) as t, count(*) as n from numbered group by doc_id, k),
eligible as (
  select doc_id, k, t from chunks where n >= 2 or length(t) - length(replace(t, ' ', '')) + 1 >= 50),
ranked as (
  select doc_id, k, row_number() over (partition by t order by doc_id, k) as r from eligible),
kept as (
  select c.doc_id, coalesce(string_agg(case when coalesce(r.r, 1) = 1 then c.t end, '' order by c.k), '') as t, count(*) filter (where r.r > 1) as n
  from chunks c left join ranked r on r.doc_id = c.doc_id and r.k = c.k group by c.doc_id)
select d.doc_id, coalesce(k.n, 0)::bigint as n_removed, length(coalesce(k.t, d.text))::bigint as kept_chars, md5(coalesce(k.t, d.text)) as kept_md5
from documents d left join kept k on k.doc_id = d.doc_id
"""

_OP5 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLES: dict[str, str] = {"op2_linededup": _OP2, "op5_neighbours": _OP5}
