"""Operators over probability distributions: rows (ctx, symbol, p). Entropies are in nats; p of 1e-10 or less is skipped.

The distributions of the queries are those of event types in each user's samples (ctx: user, symbol: type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.plans.registry import query, table

FLOOR = 1e-10
_P = """
s as (select user_id as ctx, event_type as symbol, count(*)::double as c, avg(value) / 20 as logit from events group by 1, 2),
p as (select ctx, symbol, c, logit, c / sum(c) over (partition by ctx) as p from s)"""


def distribution(spark: SparkSession, d: str) -> DataFrame:
    """ctx, symbol, c, logit, p; contexts have few symbols, so windows over them are small."""
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("ctx"), F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).cast("double").alias("c"), (F.avg("value") / 20).alias("logit"))
    return normalise(s, F.col("c"))


def normalise(df: DataFrame, weight: Column) -> DataFrame:
    """p: the weight over its context's sum; uniform where that sum is next to nothing."""
    w = Window.partitionBy("ctx")
    z = F.sum(weight).over(w)
    return df.withColumn("p", F.when(z > FLOOR, weight / z).otherwise(1 / F.count(F.lit(1)).over(w)))


def softmax(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    t = temperature if temperature > 0 else 1.0
    return normalise(df, F.exp((F.col("logit") - F.max("logit").over(Window.partitionBy("ctx"))) / t))


@query("tempered_softmax", f"with {_P}, e as (select ctx, symbol, exp((logit - max(logit) over (partition by ctx)) / 0.7) as e from p) select ctx, symbol, round(e / sum(e) over (partition by ctx), 8) as p from e")
def tempered_softmax(spark: SparkSession, d: str) -> DataFrame:
    return softmax(distribution(spark, d), 0.7).select("ctx", "symbol", F.round("p", 8).alias("p"))


_ORDER = ("p desc", "symbol")


def ranked(df: DataFrame) -> DataFrame:
    """rank by p (ties to the least symbol), place among distinct values, and cumulative p."""
    w = Window.partitionBy("ctx").orderBy(F.desc("p"), "symbol")
    return df.withColumns({"k": F.row_number().over(w), "place": F.rank().over(Window.partitionBy("ctx").orderBy(F.desc("p"))), "cum": F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def top_k(df: DataFrame, k: int) -> DataFrame:
    """Symbols with p of the k-th or more, ties kept, renormalised."""
    kept = ranked(df).where(F.col("place") <= k)
    return normalise(kept, F.col("p"))


def top_p(df: DataFrame, share: float) -> DataFrame:
    """The least prefix that holds `share`, renormalised."""
    return normalise(ranked(df).where(F.round(F.col("cum") - F.col("p"), 12) < share), F.col("p"))


@query("top_k_filter", f"with {_P}, r as (select *, rank() over (partition by ctx order by p desc) as place from p) select ctx, symbol, round(p / sum(p) over (partition by ctx), 8) as p from r where place <= 2")
def top_k_filter(spark: SparkSession, d: str) -> DataFrame:
    return top_k(distribution(spark, d), 2).select("ctx", "symbol", F.round("p", 8).alias("p"))


@query("top_p_filter", f"with {_P}, r as (select *, sum(p) over (partition by ctx order by p desc, symbol rows unbounded preceding) as cum from p), k as (select * from r where round(cum - p, 12) < 0.7) select ctx, symbol, round(p / sum(p) over (partition by ctx), 8) as p from k")
def top_p_filter(spark: SparkSession, d: str) -> DataFrame:
    return top_p(distribution(spark, d), 0.7).select("ctx", "symbol", F.round("p", 8).alias("p"))


_STATS = f"""with {_P}, r as (select *, row_number() over (partition by ctx order by p desc, symbol) as k, row_number() over (partition by ctx order by p, symbol) as up, count(*) over (partition by ctx) as n from p),
st as (select ctx, any_value(n) as n, -sum(case when p > 1e-10 then p * ln(p) end) as h, max(p) as most, max(case when k = 1 then symbol end) as best, coalesce(max(case when k = 2 then p end), 0) as second, avg(power(p - 1.0 / n, 2)) as spread, sum((2 * up - n - 1) * p) / nullif(max(n) - 1, 0) as gini from r group by ctx)"""


def statistics(df: DataFrame) -> DataFrame:
    """n, h, most, best, second, spread, gini of each context."""
    w = Window.partitionBy("ctx")
    r = ranked(df).withColumns({"up": F.row_number().over(w.orderBy("p", "symbol")), "n": F.count(F.lit(1)).over(w)})
    n, p = F.col("n"), F.col("p")
    return r.groupBy("ctx").agg(
        F.max(n).alias("n"), F.sum(F.when(p > FLOOR, -p * F.log(p))).alias("h"), F.max(p).alias("most"), F.max(F.when(F.col("k") == 1, F.col("symbol"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("k") == 2, p)), F.lit(0.0)).alias("second"), F.avg(F.pow(p - 1 / n, F.lit(2))).alias("spread"), F.try_divide(F.sum((2 * F.col("up") - n - 1) * p), F.max(n) - 1).alias("gini"),
    )


@query("distribution_statistics", _STATS + " select ctx, n::bigint as n, round(h, 6) as entropy, round(most, 6) as most, best, round(spread + 1e-10, 6) as spread, round(gini, 6) as gini, round(exp(h), 5) as effective_vocabulary from st")
def distribution_statistics(spark: SparkSession, d: str) -> DataFrame:
    return statistics(distribution(spark, d)).select("ctx", "n", *(F.round(c, 6).alias(a) for c, a in (("h", "entropy"), ("most", "most"))), "best", F.round(F.col("spread") + 1e-10, 6).alias("spread"), F.round("gini", 6).alias("gini"), F.round(F.exp("h"), 5).alias("effective_vocabulary"))


@query("confidence", _STATS + """
, c as (select *, (most - second) / most as rel, most - second as margin, (most - second) / (most + second) as gap, greatest(0, least(1, 1 - h / nullif(ln(n), 0))) as sure, 1 / (1 + exp(-ln(most / (1 - most)) / 1.5)) as calibrated from st where n > 1)
select ctx, round(rel, 6) as relative, round(margin, 6) as margin, round(gap, 6) as gap, round(sure, 6) as entropy_confidence, round(calibrated, 6) as calibrated, round(0.3 * rel + 0.2 * gap + 0.3 * sure + 0.2 * calibrated, 6) as combined from c""")  # fmt: skip
def confidence(spark: SparkSession, d: str) -> DataFrame:
    s = statistics(distribution(spark, d)).where("n > 1")
    m, t = F.col("most"), F.col("second")
    s = s.withColumns({"rel": (m - t) / m, "margin": m - t, "gap": (m - t) / (m + t), "sure": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("h") / F.log("n"))), "cal": 1 / (1 + F.exp(-F.log(m / (1 - m)) / 1.5))})
    mix = 0.3 * F.col("rel") + 0.2 * F.col("gap") + 0.3 * F.col("sure") + 0.2 * F.col("cal")
    return s.select("ctx", *(F.round(c, 6).alias(a) for c, a in ((F.col("rel"), "relative"), (F.col("margin"), "margin"), (F.col("gap"), "gap"), (F.col("sure"), "entropy_confidence"), (F.col("cal"), "calibrated"), (mix, "combined"))))


@query("perplexity", f"with {_P} select e.user_id as ctx, round(-avg(ln(greatest(p, 1e-10))), 6) as cross_entropy, round(exp(-avg(ln(greatest(p, 1e-10)))), 5) as perplexity from events e join p on p.ctx = e.user_id and p.symbol = e.event_type group by e.user_id")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy of each user's samples under their distribution: from counts, so samples are not joined."""
    q = distribution(spark, d)
    mean = F.sum(F.col("c") * -F.log(F.greatest("p", F.lit(FLOOR)))) / F.sum("c")
    return q.groupBy("ctx").agg(F.round(mean, 6).alias("cross_entropy"), F.round(F.exp(mean), 5).alias("perplexity"))


def draw(df: DataFrame, r: Column) -> DataFrame:
    """The first symbol (in symbol order) whose cumulative p reaches r, else the last."""
    cum = F.sum("p").over(Window.partitionBy("ctx").orderBy("symbol"))
    x = df.withColumns({"cum": F.round(cum, 12), "r": r})
    return x.groupBy("ctx").agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("r"), F.col("symbol"))), F.max("symbol")).alias("symbol"))


_DRAW = "select ctx, coalesce(min(case when round(cum, 12) >= r then symbol end), max(symbol)) as symbol from {} group by ctx"
_R = "(ctx * 37 % 100) / 100.0"


@query("multinomial_draw", f"with {_P}, c as (select *, sum(p) over (partition by ctx order by symbol) as cum, {_R} as r from p) " + _DRAW.format("c"))
def multinomial_draw(spark: SparkSession, d: str) -> DataFrame:
    """r comes from the context, so a draw can be repeated."""
    return draw(distribution(spark, d), F.col("ctx") * 37 % 100 / 100.0)


@query("sampling_strategies", f"""with {_P}, st as (select ctx, -sum(p * ln(p)) as h from p group by ctx), g as (select ctx, max_by(symbol, -k) as greedy from (select *, row_number() over (partition by ctx order by p desc, symbol) as k from p) q where k = 1 group by ctx),
kf as (select * from (select *, rank() over (partition by ctx order by p desc) as place from p) q where place <= 2), kn as (select ctx, symbol, p / sum(p) over (partition by ctx) as p from kf), kc as (select *, sum(p) over (partition by ctx order by symbol) as cum, {_R} as r from kn), kd as ({_DRAW.format('kc')}),
pf as (select * from (select *, sum(p) over (partition by ctx order by p desc, symbol rows unbounded preceding) as cu from p) q where round(cu - p, 12) < 0.7), pn as (select ctx, symbol, p / sum(p) over (partition by ctx) as p from pf), pc as (select *, sum(p) over (partition by ctx order by symbol) as cum, {_R} as r from pn), pd as ({_DRAW.format('pc')})
select g.ctx, greedy, kd.symbol as top_k, pd.symbol as top_p, case when round(h, 9) < 1.5 then greedy else kd.symbol end as adaptive from g join st using (ctx) join kd using (ctx) join pd using (ctx)""")
def sampling_strategies(spark: SparkSession, d: str) -> DataFrame:
    q = distribution(spark, d)
    r = F.col("ctx") * 37 % 100 / 100.0
    s = statistics(q).select("ctx", "h", F.col("best").alias("greedy"))
    out = s.join(draw(top_k(q, 2), r).withColumnRenamed("symbol", "top_k"), "ctx").join(draw(top_p(q, 0.7), r).withColumnRenamed("symbol", "top_p"), "ctx")
    return out.select("ctx", "greedy", "top_k", "top_p", F.when(F.round("h", 9) < 1.5, F.col("greedy")).otherwise(F.col("top_k")).alias("adaptive"))


@query("threshold_selection", _STATS + " select ctx, best, most > 0.25 as sure from st")
def threshold_selection(spark: SparkSession, d: str) -> DataFrame:
    return statistics(distribution(spark, d)).select("ctx", "best", (F.col("most") > 0.25).alias("sure"))


@query("beam_step", f"""with {_P}, a as (select ctx, symbol as s1, ln(p) as l1 from (select *, row_number() over (partition by ctx order by p desc, symbol) as k from p) q where k <= 3),
b as (select a.ctx, s1, symbol as s2, round(l1 + ln(p), 9) as score from a join p on p.ctx = a.ctx) select ctx, s1, s2, round(score, 6) as score, (row_number() over (partition by ctx order by score desc, s1, s2))::int as rank from b qualify rank <= 3""")
def beam_step(spark: SparkSession, d: str) -> DataFrame:
    """One step of a beam of three: parents by symbols of their own context (both bounded), best three kept."""
    q = distribution(spark, d)
    parents = ranked(q).where("k <= 3").select("ctx", F.col("symbol").alias("s1"), F.log("p").alias("l1"))
    b = parents.join(q.select("ctx", F.col("symbol").alias("s2"), F.log("p").alias("l2")), "ctx").select("ctx", "s1", "s2", F.round(F.col("l1") + F.col("l2"), 9).alias("score"))
    w = Window.partitionBy("ctx").orderBy(F.desc("score"), "s1", "s2")
    return b.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("ctx", "s1", "s2", F.round("score", 6).alias("score"), "rank")


@query("ensemble", f"with {_P}, m as (select ctx, symbol, p, exp(logit) / sum(exp(logit)) over (partition by ctx) as q from p) select ctx, symbol, round(greatest(0, least(1, (0.6 * p + 0.4 * q) / 1.0)), 8) as p from m")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of two distributions."""
    q = distribution(spark, d).withColumn("first", F.col("p"))
    m = softmax(q).withColumn("mix", (0.6 * F.col("first") + 0.4 * F.col("p")) / 1.0)
    return m.select("ctx", "symbol", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mix"))), 8).alias("p"))
