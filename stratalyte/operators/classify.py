"""Content classification, suitability and selection rules over byte statistics of whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.functions.byteview import BYTES_SQL, byte_profile, hist_count, hist_entropy, hist_sum, hist_unique
from stratalyte.functions.sums import nearest, running_sum, whole_sum
from stratalyte.operators.stats import MOMENTS_SQL, moments
from stratalyte.operators.text import CLASSES_SQL, CODE_MARKS, character_classes
from stratalyte.plans.registry import query, table

#: The marker sets and shares of the three structured formats.
JSON_MARKS, XML_MARKS, CSV_MARKS = "{}[]:,", "<>/=\"'", ",;\t|"
JSON_SHARE, XML_SHARE = 0.1, 0.05

codes = lambda marks: ", ".join(str(ord(c)) for c in marks)  # noqa: E731  the byte values, for SQL


def chain(rules: list[tuple[Column, object]], last: object) -> Column:
    """The value of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(last))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def content_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Byte profile, classes, format markers, primary type and suitabilities of each text."""
    tagged = df.withColumn("tag", F.coalesce(F.regexp_count(text, F.lit("<[A-Za-z/]")) > 0, F.lit(False)))
    p = character_classes(byte_profile(tagged, key, text, extra=("repeats",), carry=("tag",)))
    h, n = F.col("hist"), F.col("n")
    p = p.withColumns({"h": hist_entropy(h, n), "text_share": share(F.col("printable"), n), "full": n - F.get(h, F.lit(0))})
    p = p.withColumns({
        "json": share(hist_count(h, JSON_MARKS), F.col("full")) > JSON_SHARE,
        "xml": F.col("tag") & (share(hist_count(h, XML_MARKS), F.col("full")) > XML_SHARE),
        "csv": (hist_count(h, "\r\n") > 1) & (hist_count(h, CSV_MARKS) > hist_count(h, "\r\n")),
        "regularity": share(F.least(F.col("again2"), F.lit(100)), n),
    })
    textual = [(F.col("json"), "json"), (F.col("xml"), "xml"), (F.col("csv"), "csv"), (F.col("words") / F.col("lines") > 3, "natural_language")]
    kind = F.when(F.col("text_share") > 0.8, chain(textual, "source_code")).otherwise(chain([(F.col("h") > 7.5, "compressed"), (F.col("h") > 7.0, "random")], "binary"))
    p = p.withColumn("kind", kind)
    e = F.col("h")
    structured = F.col("json") | F.col("xml") | F.col("csv")
    bonus = lambda cond, v: F.when(cond, v).otherwise(0.0)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    p = p.withColumns({
        "structured": structured,
        "is_text": F.col("kind").isin("natural_language", "source_code") | (F.col("text_share") > 0.7),
        "transformer": clamp(0.5 + bonus(structured, 0.3) + bonus(e.between(4.0, 6.5), 0.2) + bonus(F.col("regularity") > 0.1, 0.1) - bonus(e > 7.5, 0.3)),
    })
    p = p.withColumn("lstm", clamp(0.5 + bonus(F.col("is_text"), 0.3) + bonus(F.col("regularity") > 0.05, 0.2) + bonus(e.between(3.0, 7.0), 0.2) - bonus(e > 7.8, 0.4)))
    mean = (F.col("transformer") + F.col("lstm")) / 2
    return p.withColumn("hybrid", F.when((F.round(F.abs(F.col("transformer") - F.col("lstm")), 6) < 0.3) & (F.round(mean, 6) > 0.4), F.least(F.lit(1.0), mean + 0.2)).otherwise(mean * 0.8))


def _content_sql(source: str, key: str, text: str) -> str:
    return CLASSES_SQL.replace("documents", "src").replace("with ", f"with src as (select {key} as doc_id, {text} as text from {source}),", 1) + f"""
, marks as (
  select doc_id, sum(c) filter (where b in ({codes(JSON_MARKS)})) as j, sum(c) filter (where b in ({codes(XML_MARKS)})) as x, sum(c) filter (where b in ({codes(CSV_MARKS)})) as s, sum(c) filter (where b in (10, 13)) as nl, sum(c) filter (where b <> 0) as f
  from hist group by doc_id),
pair as (select doc_id, pos, max(pos) over (partition by doc_id, b, nb) - pos as gap from (select doc_id, pos, b, lead(b) over (partition by doc_id order by pos) as nb from bytes) q where nb is not null),
rep as (select doc_id, least(100, count(*) filter (where gap >= 2)) as again2 from pair group by doc_id),
f as (
  select c.*, coalesce(printable / nullif(n, 0), 0) as text_share, coalesce(j / f, 0) > {JSON_SHARE} as json, regexp_matches(coalesce(text, ''), '<[A-Za-z/]') and coalesce(x / f, 0) > {XML_SHARE} as xml,
         coalesce(nl, 0) > 1 and coalesce(s, 0) > coalesce(nl, 0) as csv, coalesce(again2 / nullif(n, 0), 0) as regularity
  from classes c join src using (doc_id) left join marks using (doc_id) left join rep using (doc_id)),
k as (
  select *, json or xml or csv as structured, case when text_share > 0.8 then case when json then 'json' when xml then 'xml' when csv then 'csv' when words / lines > 3 then 'natural_language' else 'source_code' end
         when h > 7.5 then 'compressed' when h > 7.0 then 'random' else 'binary' end as kind from f),
t as (select *, kind in ('natural_language', 'source_code') or text_share > 0.7 as is_text,
  greatest(0, least(1, 0.5 + case when structured then 0.3 else 0 end + case when h between 4 and 6.5 then 0.2 else 0 end + case when regularity > 0.1 then 0.1 else 0 end - case when h > 7.5 then 0.3 else 0 end)) as transformer from k),
u as (select *, greatest(0, least(1, 0.5 + case when is_text then 0.3 else 0 end + case when regularity > 0.05 then 0.2 else 0 end + case when h between 3 and 7 then 0.2 else 0 end - case when h > 7.8 then 0.4 else 0 end)) as lstm from t)
select doc_id as {key}, kind, is_text, structured, kind = 'binary' or text_share < 0.3 as is_binary, kind = 'compressed' or h > 7.5 as is_compressed, kind = 'random' or h > 7.8 as is_random,
  round(transformer::double, 4) as transformer, round(lstm::double, 4) as lstm,
  round((case when abs(transformer - lstm) < 0.3 and (transformer + lstm) / 2 > 0.4 then least(1, (transformer + lstm) / 2 + 0.2) else (transformer + lstm) / 2 * 0.8 end)::double, 4) as hybrid from u"""


def _content(spark: SparkSession, d: str, source: str, key: str, text: str) -> DataFrame:
    c = content_table(table(spark, d, source), key, text)
    kind, h, t = F.col("kind"), F.col("h"), F.col("text_share")
    return c.select(key, "kind", "is_text", "structured", ((kind == "binary") | (t < 0.3)).alias("is_binary"), ((kind == "compressed") | (h > 7.5)).alias("is_compressed"), ((kind == "random") | (h > 7.8)).alias("is_random"), *(F.round(x, 4).alias(x) for x in ("transformer", "lstm", "hybrid")))


@query("content_type", _content_sql("documents", "doc_id", "text"))
def content_type(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, "documents", "doc_id", "text")


@query("content_type_markup", _content_sql("pages", "page_id", "html"))
def content_type_markup(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, "pages", "page_id", "html")


@query("content_type_json", _content_sql("events", "event_id", "props"))
def content_type_json(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, "events", "event_id", "props")


@query("routing", f"""with {BYTES_SQL}, odd as (select distinct doc_id from bytes where b < 32 and b not in (0, 9, 10, 13))
select d.doc_id, case when o.doc_id is null then 'transformer' else 'lstm' end as algorithm, case when o.doc_id is null then 'lstm' else 'rle' end as fallback, case when o.doc_id is null then 0.8 else 0.7 end::double as confidence from documents d left join odd o on o.doc_id = d.doc_id""")
def routing(spark: SparkSession, d: str) -> DataFrame:
    """Text goes to one coder, anything with a control byte to the other."""
    p = byte_profile(table(spark, d, "documents"))
    text = hist_sum(F.col("hist"), lambda i: (i < 32) & ~i.isin(0, 9, 10, 13)) == 0
    pick = lambda a, b: F.when(text, a).otherwise(b)
    return p.select("doc_id", pick("transformer", "lstm").alias("algorithm"), pick("lstm", "rle").alias("fallback"), pick(0.8, 0.7).alias("confidence"))


def selector_types(p: DataFrame) -> DataFrame:
    """kind and certainty by printable and white-space shares, autocorrelation and sparsity."""
    n = F.col("n")
    p = character_classes(moments(p))
    p = p.withColumns({"plain": share(F.col("printable"), n), "blank": share(hist_count(F.col("hist"), " \n\r\t"), n), "odd": n - F.col("printable") - F.get("hist", F.lit(0)), "ac": F.round("autocorr", 9)})
    text = (F.col("odd") == 0) & (F.col("plain") > 0.8)
    return p.withColumns({
        "kind": chain([(text & (F.col("blank") > 0.1), "text"), (text, "structured"), (F.col("ac") > 0.5, "sequential"), (F.col("sparsity") > 0.5, "sparse")], "binary"),
        "certainty": chain([(text, F.col("plain")), (F.col("ac") > 0.5, F.col("ac")), (F.col("sparsity") > 0.5, F.col("sparsity"))], 0.5),
    })


#: Relative cost of each algorithm, in milliseconds a byte times 2^20 / 1000.
ALGORITHMS = {"rle": 1.0, "transformer": 100.0, "lstm": 80.0}
_SELECTOR_SQL = MOMENTS_SQL + """
, pr as (select doc_id, sum(c) filter (where b between 32 and 126 or b in (9, 10, 13)) as p, sum(c) filter (where b in (32, 9, 10, 13)) as w, sum(c) filter (where not (b between 32 and 126 or b in (0, 9, 10, 13))) as o from hist group by doc_id),
ty as (
  select m.*, round(m.autocorr, 9) as ac, coalesce(p / m.n, 0) as plain, coalesce(o, 0) = 0 and coalesce(p / m.n, 0) > 0.8 as txt, coalesce(w / m.n, 0) as blank from mom m left join pr using (doc_id)),
kd as (select *, case when txt and blank > 0.1 then 'text' when txt then 'structured' when ac > 0.5 then 'sequential' when sparsity > 0.5 then 'sparse' else 'binary' end as kind,
  case when txt then plain when ac > 0.5 then ac when sparsity > 0.5 then sparsity else 0.5 end as certainty from ty),
pred as (
  select doc_id, n, kind, a, case a when 'rle' then 1 - redundancy * 0.5 when 'transformer' then case when kind in ('text', 'structured') then 0.15 else 0.3 end else case when kind = 'sequential' or ac > 0.5 then 0.2 else 0.4 end end as ratio,
    case a when 'rle' then redundancy when 'transformer' then case when kind in ('text', 'structured') then 0.9 else 0.3 end else case when kind = 'sequential' or ac > 0.5 then 0.8 else 0.4 end end as suitability,
    case a when 'rle' then 0.8 when 'transformer' then 0.7 else 0.6 end as confidence, floor(n / 1048576 * case a when 'rle' then 1 when 'transformer' then 100 else 80 end * 1000)::bigint as time_ms
  from kd, (values ('rle'), ('transformer'), ('lstm')) v(a))
"""


@query("selector_type", _SELECTOR_SQL + "select doc_id, kind, round(certainty::double, 6) as certainty from kd")
def selector_type(spark: SparkSession, d: str) -> DataFrame:
    return selector_types(byte_profile(table(spark, d, "documents"))).select("doc_id", "kind", F.round("certainty", 6).alias("certainty"))


def predictions(p: DataFrame) -> DataFrame:
    """A row for each text and algorithm: predicted ratio, suitability, confidence, time."""
    textual, serial = F.col("kind").isin("text", "structured"), (F.col("kind") == "sequential") | (F.col("ac") > 0.5)
    one = lambda name, ratio, fit, sure: F.struct(F.lit(name).alias("algorithm"), ratio.alias("ratio"), fit.alias("suitability"), F.lit(sure).alias("confidence"), F.floor(F.col("n") / 1048576 * ALGORITHMS[name] * 1000).alias("time_ms"))
    pick = lambda cond, a, b: F.when(cond, a).otherwise(b)
    rows = F.array(
        one("rle", 1 - F.col("redundancy") * 0.5, F.col("redundancy"), 0.8),
        one("transformer", pick(textual, 0.15, 0.3), pick(textual, 0.9, 0.3), 0.7),
        one("lstm", pick(serial, 0.2, 0.4), pick(serial, 0.8, 0.4), 0.6),
    )
    return p.select("doc_id", F.inline(rows))


@query("selector_ranking", _SELECTOR_SQL + """
select doc_id, a as algorithm, round(ratio::double, 6) as ratio, round(suitability::double, 6) as suitability, confidence::double as confidence, time_ms,
  row_number() over (partition by doc_id order by round((suitability * confidence)::double, 9) desc, a)::int as rank from pred""")  # fmt: skip
def selector_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All algorithms of each text, best first; three rows a text, so the window is small."""
    r = predictions(selector_types(byte_profile(table(spark, d, "documents"))))
    w = Window.partitionBy("doc_id").orderBy(F.round(F.col("suitability") * F.col("confidence"), 9).desc(), "algorithm")
    return r.select("doc_id", "algorithm", F.round("ratio", 6).alias("ratio"), F.round("suitability", 6).alias("suitability"), "confidence", "time_ms", F.row_number().over(w).alias("rank"))


@query("selector_objective", _SELECTOR_SQL + """
, s as (select doc_id, a, ((ratio / 10 + (1 - time_ms / 100000.0) / 10 + suitability) / 3 * case when time_ms > 1000 then 0.5 else 1 end * case when ratio < 0.15 then 0.1 else 1 end * confidence)::double as score from pred)
select doc_id, max_by(a, round(score, 9)) as best, round(max(score), 6) as score from s group by doc_id""")  # fmt: skip
def selector_objective(spark: SparkSession, d: str) -> DataFrame:
    """Balanced objective with penalties for time and ratio, times confidence; the best of each text."""
    r = predictions(selector_types(byte_profile(table(spark, d, "documents"))))
    penalty = F.when(F.col("time_ms") > 1000, 0.5).otherwise(1.0) * F.when(F.col("ratio") < 0.15, 0.1).otherwise(1.0)
    score = (F.col("ratio") / 10 + (1 - F.col("time_ms") / 100000.0) / 10 + F.col("suitability")) / 3 * penalty * F.col("confidence")
    return r.withColumn("s", score).groupBy("doc_id").agg(F.max_by("algorithm", F.round("s", 9)).alias("best"), F.round(F.max("s"), 6).alias("score"))


#: The character sets whose shares score a file's pattern.
HIERARCHY, TABULAR, ALGORITHMIC = "\t{}()[]", ",\t|", "=+-*/<>&|^!;"
STRUCTURE = ",:\"'{}[]<>"


@query("file_pattern", f"""
with {BYTES_SQL}, nx as (select doc_id, pos, b, lead(b, 1) over w as b1, lead(b, 2) over w as b2, lead(b, 3) over w as b3 from bytes window w as (partition by doc_id order by pos)),
g4 as (select doc_id, pos, max(pos) over (partition by doc_id, b, b1, b2, b3) - pos as gap from nx where b3 is not null),
r as (select doc_id, count(*) filter (where gap >= 4) as again4 from g4 group by doc_id),
sq as (select doc_id, count(*) filter (where b between 48 and 57 and b1 in (58, 45, 47)) as sequential from nx group by doc_id),
s as (
  select t.doc_id, coalesce(any_value(again4), 0) / (any_value(t.n) / 8) as repetitive, coalesce(sum(c) filter (where b in ({codes(HIERARCHY)})), 0) / any_value(t.n) as hierarchical, any_value(sequential) / any_value(t.n) as sequential,
    coalesce(sum(c) filter (where b in ({codes(TABULAR)})), 0) / any_value(t.n) as tabular, coalesce(sum(c) filter (where b between 65 and 90 or b between 97 and 122 or b in (32, 46, 44, 33)), 0) / any_value(t.n) as linguistic,
    coalesce(sum(c) filter (where b in ({codes(ALGORITHMIC)})), 0) / any_value(t.n) as algorithmic
  from totals t join hist using (doc_id) left join r using (doc_id) left join sq using (doc_id) group by t.doc_id)
select doc_id, round(repetitive::double, 6) as repetitive, round(hierarchical::double, 6) as hierarchical, round(sequential::double, 6) as sequential, round(tabular::double, 6) as tabular, round(linguistic::double, 6) as linguistic, round(algorithmic::double, 6) as algorithmic,
  case when (repetitive > 0.1)::int + (hierarchical > 0.1)::int + (sequential > 0.1)::int + (tabular > 0.1)::int + (linguistic > 0.1)::int + (algorithmic > 0.1)::int >= 3 then 'hybrid'
    when repetitive = greatest(repetitive, hierarchical, sequential, tabular, linguistic, algorithmic) then 'repetitive' when hierarchical = greatest(hierarchical, sequential, tabular, linguistic, algorithmic) then 'hierarchical'
    when sequential = greatest(sequential, tabular, linguistic, algorithmic) then 'sequential' when tabular = greatest(tabular, linguistic, algorithmic) then 'tabular' when linguistic >= algorithmic then 'linguistic' else 'algorithmic' end as pattern from s""")  # fmt: skip
def file_pattern(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    h, n = F.col("hist"), F.col("n")
    p = byte_profile(docs.withColumn("marks", F.regexp_count("text", F.lit("[0-9][:/-]"))), extra=("repeats",), carry=("marks",)).where("n > 0")
    scores = {
        "repetitive": F.col("again4") / (n / 8),
        "hierarchical": hist_count(h, HIERARCHY) / n,
        "sequential": F.col("marks") / n,
        "tabular": hist_count(h, TABULAR) / n,
        "linguistic": (hist_sum(h, lambda i: i.between(65, 90) | i.between(97, 122)) + hist_count(h, " .,!")) / n,
        "algorithmic": hist_count(h, ALGORITHMIC) / n,
    }
    p = p.select("doc_id", *(c.alias(k) for k, c in scores.items()))
    high = reduce(lambda a, b: a + b, [(F.col(k) > 0.1).cast("int") for k in scores])
    top = F.greatest(*scores)
    first = chain([(F.col(k) == top, k) for k in scores], "random")
    return p.select("doc_id", *(F.round(k, 6).alias(k) for k in scores), F.when(high >= 3, "hybrid").otherwise(first).alias("pattern"))


@query("content_scores", f"""
with {BYTES_SQL}, nx as (select doc_id, pos, b, lag(b) over w as p, lead(b, 1) over w as b1, lead(b, 2) over w as b2, lead(b, 3) over w as b3 from bytes window w as (partition by doc_id order by pos)),
al as (select doc_id, count(*) filter (where b1 is not null and (b in (35, 42, 45) or (b = 61 and b1 = 61))) as doc, count(*) filter (where b between 48 and 57 and b1 between 48 and 57 and b2 between 48 and 57 and b3 between 48 and 57) as log,
  count(*) filter (where b = 61 and (p between 48 and 57 or p between 65 and 90 or p between 97 and 122) and (b1 between 48 and 57 or b1 between 65 and 90 or b1 between 97 and 122)) as conf from nx group by doc_id),
s as (
  select t.doc_id, any_value(t.n) as n, coalesce(sum(c) filter (where b between 32 and 126 or b between 9 and 13), 0) as txt, coalesce(sum(c) filter (where b in ({codes(CODE_MARKS)})), 0) as code, coalesce(sum(c) filter (where b < 32 and b not in (9, 10, 13)), 0) as bin,
    coalesce(sum(c) filter (where b in ({codes(STRUCTURE)})), 0) as str, any_value(doc) as doc, any_value(log) as log, any_value(conf) as conf from totals t join hist using (doc_id) join al using (doc_id) group by t.doc_id)
select doc_id, round((txt / n)::double, 6) as text, round((code / n)::double, 6) as code, round((bin / n)::double, 6) as binary, round((str / n)::double, 6) as structured, round((doc / n)::double, 6) as documentation, round((log / n)::double, 6) as log, round((conf / n)::double, 6) as config,
  (txt / n > 0.4)::int + (code / n > 0.4)::int + (bin / n > 0.4)::int + (str / n > 0.4)::int >= 2 as mixed, (txt / n > 0.7)::int + (code / n > 0.6)::int + (bin / n > 0.5)::int + (str / n > 0.75)::int as evidence from s""")  # fmt: skip
def content_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shares of indicator bytes; texts of length zero have none and give no row."""
    docs = table(spark, d, "documents")
    counts = {"doc": r"[#*-](?=(?s:.))|=(?==)", "log": r"(?=[0-9]{4})", "conf": r"(?<=[A-Za-z0-9])=(?=[A-Za-z0-9])"}
    counted = docs.withColumns({k: F.regexp_count("text", F.lit(r)) for k, r in counts.items()})
    p = byte_profile(counted, carry=tuple(counts)).where("n > 0")
    h, n = F.col("hist"), F.col("n")
    scores = {
        "text": hist_sum(h, lambda i: i.between(32, 126) | i.between(9, 13)) / n,
        "code": hist_count(h, CODE_MARKS) / n,
        "binary": hist_sum(h, lambda i: (i < 32) & ~i.isin(9, 10, 13)) / n,
        "structured": hist_count(h, STRUCTURE) / n,
        "documentation": F.col("doc") / n,
        "log": F.col("log") / n,
        "config": F.col("conf") / n,
    }
    p = p.select("doc_id", *(c.alias(k) for k, c in scores.items()))
    over = lambda marks: reduce(lambda a, b: a + b, [(F.col(k) > v).cast("int") for k, v in marks.items()])
    main = ("text", "code", "binary", "structured")
    return p.select("doc_id", *(F.round(k, 6).alias(k) for k in scores), (over(dict.fromkeys(main, 0.4)) >= 2).alias("mixed"), over(dict(zip(main, (0.7, 0.6, 0.5, 0.75)))).alias("evidence"))


@query("regularity", f"""with {BYTES_SQL}
select t.doc_id, round(((coalesce(sum(c) filter (where b = 44), 0) > any_value(n) // 100)::int + (coalesce(sum(c) filter (where b in (123, 125)), 0) > any_value(n) // 200)::int + (coalesce(sum(c) filter (where b in (60, 62)), 0) > any_value(n) // 100)::int) / 3, 6)::double as regularity from totals t join hist using (doc_id) group by t.doc_id""")
def regularity(spark: SparkSession, d: str) -> DataFrame:
    p = byte_profile(table(spark, d, "documents")).where("n > 0")
    over = lambda marks, part: (hist_count(F.col("hist"), marks) > F.floor(F.col("n") / part)).cast("int")
    return p.select("doc_id", F.round((over(",", 100) + over("{}", 200) + over("<>", 100)) / 3, 6).alias("regularity"))


#: Window and memory multipliers by complexity class and strategy, with base, least and most.
WINDOW_FACTORS = {"low": 0.7, "medium": 1.0, "high": 1.4, "variable": 1.8}
MEMORY_FACTORS = {"low": 0.6, "medium": 1.0, "high": 1.6, "variable": 2.0}
STRATEGIES = {"conservative": (0.8, 0.9), "balanced": (1.0, 1.0), "aggressive": (1.3, 1.2), "content_aware": (1.1, 1.15)}
WINDOW, MEMORY = (16384, 1024, 65536), (2048, 512, 8192)


def _table_sql(values: dict[str, float], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


@query("complexity_recommendation", f"""with {BYTES_SQL}, c as (
  select doc_id, case when h / 8 < 0.3 or uniq < 16 then 'low' when h / 8 < 0.6 or uniq < 64 then 'medium' when h / 8 < 0.8 or uniq < 128 then 'high' else 'variable' end as complexity from totals join ent using (doc_id)),
s as (select * from (values {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in STRATEGIES.items())}) v(strategy, wf, mf))
select doc_id, complexity, strategy, least(65536, greatest(1024, floor(round(16384 * ({_table_sql(WINDOW_FACTORS, 'complexity')}) * wf, 6))))::bigint as window_size, least(8192, greatest(512, floor(round(2048 * ({_table_sql(MEMORY_FACTORS, 'complexity')}) * mf, 6))))::bigint as memory_size from c, s""")
def complexity_recommendation(spark: SparkSession, d: str) -> DataFrame:
    p = byte_profile(table(spark, d, "documents")).where("n > 0")
    e, u = hist_entropy(F.col("hist"), F.col("n")) / 8, hist_unique(F.col("hist"))
    p = p.select("doc_id", chain([((e < 0.3) | (u < 16), "low"), ((e < 0.6) | (u < 64), "medium"), ((e < 0.8) | (u < 128), "high")], "variable").alias("complexity"))
    rows = p.select("doc_id", "complexity", F.inline(F.array(*(F.struct(F.lit(k).alias("strategy"), F.lit(a).alias("wf"), F.lit(b).alias("mf")) for k, (a, b) in STRATEGIES.items()))))
    by = lambda t: F.element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), F.col("complexity"))
    size = lambda spec, t, f: F.least(F.lit(spec[2]), F.greatest(F.lit(spec[1]), F.floor(F.round(spec[0] * by(t) * F.col(f), 6))))
    return rows.select("doc_id", "complexity", "strategy", size(WINDOW, WINDOW_FACTORS, "wf").alias("window_size"), size(MEMORY, MEMORY_FACTORS, "mf").alias("memory_size"))


@query("size_rules", """
select doc_id, n_chars, case when n <= 256 then 'tiny' when n <= 1024 then 'small' when n <= 4096 then 'medium' when n <= 16384 then 'large' else 'very_large' end as category,
  case when n < 1024 then 'lstm_fast' when n < 102400 then 'default' when n < 10485760 then 'default' else 'enwik8' end as profile, case when n < 1024 then 'lstm_fast' when n < 102400 then 'lstm' when n < 10485760 then 'enwik8' else 'enwik9' end as quality_profile,
  16384 as text_block, case when n < 1048576 then 8192 else 65536 end as binary_block, (n * 3 // 4 + 64)::bigint as transformer_size, (n + 64 + n // 4)::bigint as lstm_size, case when n <= 16384 then 'small_file' else 'lstm' end as codec
from (select doc_id, n_chars, coalesce(octet_length(encode(text)), 0) as n from documents) q""")  # fmt: skip
def size_rules(spark: SparkSession, d: str) -> DataFrame:
    """Category, profiles, block sizes, size estimates and codec by size alone."""
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    steps = lambda limits, last, op: chain([(n <= v if op == "<=" else n < v, name) for v, name in limits], last)
    kb = 1024
    return table(spark, d, "documents").select(
        "doc_id", "n_chars",
        steps([(256, "tiny"), (1024, "small"), (4096, "medium"), (16384, "large")], "very_large", "<=").alias("category"),
        steps([(kb, "lstm_fast"), (10240 * kb, "default")], "enwik8", "<").alias("profile"),
        steps([(kb, "lstm_fast"), (100 * kb, "lstm"), (10240 * kb, "enwik8")], "enwik9", "<").alias("quality_profile"),
        F.lit(16384).alias("text_block"), F.when(n < 1048576, 8192).otherwise(65536).alias("binary_block"),
        (F.floor(n * 3 / 4) + 64).alias("transformer_size"), (n + 64 + F.floor(n / 4)).alias("lstm_size"), F.when(n <= 16384, "small_file").otherwise("lstm").alias("codec"),
    )


@query("memory_pressure", """
select o_orderkey, case when c_acctbal <= 0 then 'high' when o_totalprice / (c_acctbal * 100) < 0.5 then 'none' when o_totalprice / (c_acctbal * 100) < 0.7 then 'low' when o_totalprice / (c_acctbal * 100) < 0.9 then 'medium' else 'high' end as pressure
from orders join customer on c_custkey = o_custkey""")  # fmt: skip
def memory_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Class of required over available; nothing available is high pressure."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ratio = F.try_divide(F.col("o_totalprice"), F.col("c_acctbal") * 100)
    return j.select("o_orderkey", chain([(F.col("c_acctbal") <= 0, "high"), (ratio < 0.5, "none"), (ratio < 0.7, "low"), (ratio < 0.9, "medium")], "high").alias("pressure"))


@query("access_pattern", """
with a as (select l_suppkey as k, (l_orderkey * 64 + l_linenumber * 16) as at, row_number() over w as i, (l_orderkey * 64 + l_linenumber * 16) - lag(l_orderkey * 64 + l_linenumber * 16) over w as d from lineitem window w as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber)),
f as (select k, d as d0 from a where i = 2),
r as (select a.k, count(*) as n, count(*) filter (where d > 0 and d <= 128) / count(*) as fwd, count(*) filter (where d < 0 and d >= -128) / count(*) as rev, count(*) filter (where abs(d - d0) <= 8) / count(*) as str, any_value(d0) as d0 from a join f on f.k = a.k where d is not null group by a.k)
select k as l_suppkey, n::bigint as deltas, case when fwd > 0.7 then 'sequential' when rev > 0.7 then 'reverse' when str > 0.6 and abs(d0) > 1 then 'strided' when fwd + rev > 0.4 then 'mixed' else 'random' end as pattern,
  round((case when fwd > 0.7 then fwd when rev > 0.7 then rev when str > 0.6 and abs(d0) > 1 then str when fwd + rev > 0.4 then fwd + rev else 1 - greatest(fwd, rev, str) end)::double, 6) as confidence from r""")  # fmt: skip
def access_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Pattern of address steps, for each supplier's line items in shipping order."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    at = F.col("l_orderkey") * 64 + F.col("l_linenumber") * 16
    a = table(spark, d, "lineitem").select("l_suppkey", (at - F.lag(at).over(w)).alias("d"), F.row_number().over(w).alias("i"))
    a = a.where("d is not null")
    first = a.where("i = 2").select("l_suppkey", F.col("d").alias("d0"))
    part = lambda c: F.count_if(c) / F.count(F.lit(1))
    step = F.col("d")
    r = a.join(first, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("deltas"), part((step > 0) & (step <= 128)).alias("f"), part((step < 0) & (step >= -128)).alias("r"), part(F.abs(step - F.col("d0")) <= 8).alias("s"), F.first("d0").alias("d0"))
    f, b, s = F.col("f"), F.col("r"), F.col("s")
    rules = [(f > 0.7, "sequential", f), (b > 0.7, "reverse", b), ((s > 0.6) & (F.abs("d0") > 1), "strided", s), (f + b > 0.4, "mixed", f + b)]
    return r.select("l_suppkey", "deltas", chain([(c, name) for c, name, _ in rules], "random").alias("pattern"), F.round(reduce(lambda rest, x: F.when(x[0], x[2]).otherwise(rest), reversed(rules), 1 - F.greatest(f, b, s)), 6).alias("confidence"))


@query("bottleneck", """
with s as (select user_id, event_type, sum(value) as t from events group by 1, 2), r as (select *, sum(t) over (partition by user_id) as total, row_number() over (partition by user_id order by t desc, event_type) as k from s)
select user_id, max(case when k = 1 then event_type end) as primary_stage, max(case when k = 2 then event_type end) as secondary_stage, round(max(case when k = 1 then t / nullif(total, 0) end), 6) as share from r group by user_id""")  # fmt: skip
def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    """The stages (event types) that take most of each worker's total; sums are added up in the order of the rows, and the total by falling sums."""
    s = running_sum(table(spark, d, "events"), ["user_id", "event_type"], "value").groupBy("user_id", "event_type").agg(whole_sum().alias("t"))
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("t"), F.asc_nulls_last("event_type"))
    r = s.withColumns({"total": F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "k": F.row_number().over(w)})
    at = lambda k, c: F.max(F.when(F.col("k") == k, c))
    return r.groupBy("user_id").agg(at(1, F.col("event_type")).alias("primary_stage"), at(2, F.col("event_type")).alias("secondary_stage"), nearest(at(1, F.try_divide(F.col("t"), F.col("total"))), 6).alias("share"))


@query("working_set", """
with f as (select l_partkey, count(*) as n from lineitem group by l_partkey), m as (select avg(n) as a from f)
select n > a as hot, count(*)::bigint as items, sum(n)::bigint as accesses, round(sum(n) / (select sum(n) from f), 6)::double as share from f, m group by n > a""")  # fmt: skip
def working_set(spark: SparkSession, d: str) -> DataFrame:
    """Hot and cold parts, by accesses above or below the mean."""
    f = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    m = f.agg(F.avg("n").alias("a"), F.sum("n").alias("all"))  # one row
    return f.join(F.broadcast(m)).groupBy((F.col("n") > F.col("a")).alias("hot")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("accesses"), F.round(F.sum("n") / F.first("all"), 6).alias("share"))
