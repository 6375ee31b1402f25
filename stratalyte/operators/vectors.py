"""Array algebra over embeddings: element-wise, reductions, shapes, products, gather and scatter, norms, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.plans.registry import query, table

SQRT_2_OVER_PI = 0.7978845608028654
_E = "e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as a, list_reverse(list_transform(embedding, lambda x: x::double)) as b from embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, a (double) and b, its reverse."""
    a = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", "label", a.alias("a"), F.reverse(a).alias("b"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also where lambdas inside use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(a: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(a, lambda v: let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), shares)))


#: Element-wise functions of x (from a) and y (from b): Column form and the same in SQL.
BINARY = {
    "add": (lambda x, y: x + y, "x + y"),
    "sub": (lambda x, y: x - y, "x - y"),
    "mul": (lambda x, y: x * y, "x * y"),
    "div": (lambda x, y: F.try_divide(x, y), "x / nullif(y, 0)"),
    "lesser": (lambda x, y: F.least(x, y), "least(x, y)"),
    "greater": (lambda x, y: F.greatest(x, y), "greatest(x, y)"),
    "selected": (lambda x, y: F.when(x > 0, x).otherwise(y), "case when x > 0 then x else y end"),
    "masked": (lambda x, y: F.when(y > 0, F.lit(0.0)).otherwise(x), "case when y > 0 then 0 else x end"),
    "lerp": (lambda x, y: x + (y - x) * 0.25, "x + (y - x) * 0.25"),
    "gated_swish": (lambda x, y: x / (1 + F.exp(-x)) * y, "x / (1 + exp(-x)) * y"),
    "geglu": (lambda x, y: 0.5 * x * (1 + F.tanh(SQRT_2_OVER_PI * (x + 0.044715 * x * x * x))) * y, f"0.5 * x * (1 + tanh({SQRT_2_OVER_PI} * (x + 0.044715 * x * x * x))) * y"),
}
UNARY = {
    "negated": (lambda x: -x, "-x"),
    "reciprocal": (lambda x: F.try_divide(F.lit(1.0), x), "1 / nullif(x, 0)"),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), "1 / (1 + exp(-x))"),
    "tanh": (F.tanh, "tanh(x)"),
    "relu": (lambda x: F.greatest(F.lit(0.0), x), "greatest(0, x)"),
    "squared_relu": (lambda x: F.greatest(F.lit(0.0), x) * F.greatest(F.lit(0.0), x), "greatest(0, x) * greatest(0, x)"),
    "swish": (lambda x: x / (1 + F.exp(-x)), "x / (1 + exp(-x))"),
    "snake": (lambda x: x + F.sin(x) * F.sin(x), "x + sin(x) * sin(x)"),
    "gelu": (lambda x: 0.5 * x * (1 + F.tanh(SQRT_2_OVER_PI * (x + 0.044715 * x * x * x))), f"0.5 * x * (1 + tanh({SQRT_2_OVER_PI} * (x + 0.044715 * x * x * x)))"),
    "expd": (F.exp, "exp(x)"),
    "logged": (lambda x: F.log(F.abs(x) + 1), "ln(abs(x) + 1)"),
    "clamped": (lambda x: F.least(F.lit(0.1), F.greatest(F.lit(-0.1), x)), "least(0.1, greatest(-0.1, x))"),
    "as_int": (lambda x: (x * 1000).cast("int").cast("double"), "trunc(x * 1000)"),
}


@query("vector_elementwise", f"with {_E}, r as (select vec_id, (generate_subscripts(a, 1) - 1)::int as i, unnest(a) as x, unnest(b) as y from e) select vec_id, i, " + ", ".join(f"round(({s})::double, 6) + 0 as {n}" for n, (_, s) in {**BINARY, **UNARY}.items()) + " from r")
def vector_elementwise(spark: SparkSession, d: str) -> DataFrame:
    r = vectors(spark, d).select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "v"))
    x, y = F.col("v.a"), F.col("v.b")
    tidy = lambda c, n: (F.round(c, 6) + 0.0).alias(n)  # noqa: E731  no negative zero
    return r.select("vec_id", "i", *(tidy(f(x, y), n) for n, (f, _) in BINARY.items()), *(tidy(f(x), n) for n, (f, _) in UNARY.items()))


@query("vector_reduce", f"""with {_E}, m as (select *, list_avg(a) as mean, list_max(a) as most, list_min(a) as least from e)
select vec_id, round(list_sum(a), 6) as total, round(list_sum(list_transform(a, lambda x: x * x)), 6) as squares, round(mean, 6) as mean, most, least, (list_position(a, most) - 1)::int as argmax,
  round(most + ln(list_sum(list_transform(a, lambda x: exp(x - most)))), 6) as logsumexp, round(list_sum(list_transform(a, lambda x: abs(x))), 6) as l1, (len(list_filter(a, lambda x: not isfinite(x))) = 0) as finite from m""")
def vector_reduce(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    a = F.col("a")
    most = F.array_max(a)
    return v.select("vec_id", F.round(total(a), 6).alias("total"), F.round(dot(a, a), 6).alias("squares"), F.round(total(a) / F.size(a), 6).alias("mean"), most.alias("most"), F.array_min(a).alias("least"), (F.array_position(a, most) - 1).cast("int").alias("argmax"),
                    F.round(most + F.log(total(F.transform(a, lambda x: F.exp(x - most)))), 6).alias("logsumexp"), F.round(total(F.transform(a, F.abs)), 6).alias("l1"), F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@query("vector_cumulative", f"with {_E}, r as (select vec_id, (generate_subscripts(a, 1) - 1)::int as i, unnest(a) as x from e) select vec_id, i, round(sum(x) over (partition by vec_id order by i), 6) + 0 as running, round(avg(x) over (partition by vec_id order by i), 6) + 0 as running_mean from r")
def vector_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Running sums, built in the array: no window, no shuffle."""
    sums = F.aggregate("a", F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) + x)))
    r = vectors(spark, d).select("vec_id", F.posexplode(sums).alias("i", "x"))
    return r.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("running"), (F.round(F.col("x") / (F.col("i") + 1), 6) + 0.0).alias("running_mean"))


@query("vector_shapes", f"""with {_E}, s as (select vec_id, a[1:16] || b[1:16] as joined, a[9:24] as cut, list_concat(a[1:4], list_transform(range(4), lambda i: 0::double)) as padded, a[2:64] || [0::double] as shifted,
  list_transform(range(64), lambda i: a[(i % 8) * 8 + i // 8 + 1]) as transposed, list_concat(a[1:3], a[1:3]) as twice from e)
select vec_id, md5(array_to_string(list_transform(joined, lambda x: (x * 1000)::int), ',')) as joined, md5(array_to_string(list_transform(cut, lambda x: (x * 1000)::int), ',')) as cut, md5(array_to_string(list_transform(padded, lambda x: (x * 1000)::int), ',')) as padded,
  md5(array_to_string(list_transform(shifted, lambda x: (x * 1000)::int), ',')) as shifted, md5(array_to_string(list_transform(transposed, lambda x: (x * 1000)::int), ',')) as transposed, md5(array_to_string(list_transform(twice, lambda x: (x * 1000)::int), ',')) as twice from s""")
def vector_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Concatenation, slices, padding, shift, transposition as an 8 x 8 matrix, repetition; each as a digest."""
    a, b = F.col("a"), F.col("b")
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: F.bround(x * 1000, 0).cast("int").cast("string")), ",").cast("binary"))
    shapes = {
        "joined": F.concat(F.slice(a, 1, 16), F.slice(b, 1, 16)),
        "cut": F.slice(a, 9, 16),
        "padded": F.concat(F.slice(a, 1, 4), F.array_repeat(F.lit(0.0), 4)),
        "shifted": F.concat(F.slice(a, 2, 63), F.array(F.lit(0.0))),
        "transposed": F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(a, (i % 8) * 8 + F.floor(i / 8).cast("int"))),
        "twice": F.flatten(F.array_repeat(F.slice(a, 1, 3), 2)),
    }
    return vectors(spark, d).select("vec_id", *(digest(c).alias(n) for n, c in shapes.items()))


@query("vector_norms", f"""with {_E}, m as (select vec_id, a, list_avg(a) as mean, list_var_pop(a) as var, sqrt(list_avg(list_transform(a, lambda x: x * x)) + 1e-5) as rms from e), r as (select vec_id, (generate_subscripts(a, 1) - 1)::int as i, unnest(a) as x, mean, var, rms, a from m)
select vec_id, i, round((x - mean) / sqrt(var + 1e-5), 5) + 0 as layer, round(x / rms, 5) + 0 as rms, round((x - list_avg(a[i // 16 * 16 + 1:i // 16 * 16 + 16])) / sqrt(list_var_pop(a[i // 16 * 16 + 1:i // 16 * 16 + 16]) + 1e-5), 5) + 0 as grouped from r""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Layer, root-mean-square and group (of 16) normalisation."""
    def moments(part: Column) -> Column:
        mean = total(part) / F.size(part)
        return F.struct(mean.alias("mean"), F.sqrt(dot(part, part) / F.size(part) - mean * mean + 1e-5).alias("sd"))

    a = F.col("a")
    centred = lambda x, m: (x - m["mean"]) / m["sd"]
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 16).cast("int") - 1), lambda g: moments(F.slice(a, g * 16 + 1, F.lit(16))))
    known = F.struct(moments(a).alias("all"), F.sqrt(dot(a, a) / F.size(a) + 1e-5).alias("rms"), groups.alias("groups"))
    rows = let(known, lambda k: F.transform(a, lambda x, i: F.struct(i.alias("i"), centred(x, k["all"]).alias("layer"), (x / k["rms"]).alias("rms"), centred(x, F.get(k["groups"], F.floor(i / 16).cast("int"))).alias("grouped"))))
    r = vectors(spark, d).select("vec_id", F.inline(rows))
    return r.select("vec_id", "i", *((F.round(c, 5) + 0.0).alias(c) for c in ("layer", "rms", "grouped")))


@query("vector_softmax", f"with {_E}, m as (select vec_id, a, list_max(a) as most from e), s as (select vec_id, a, most, list_sum(list_transform(a, lambda x: exp(x - most))) as z from m), r as (select vec_id, (generate_subscripts(a, 1) - 1)::int as i, unnest(a) as x, most, z from s) select vec_id, i, round(exp(x - most) / z, 8) as p, round(ln(exp(x - most) / z), 6) as log_p from r")
def vector_softmax(spark: SparkSession, d: str) -> DataFrame:
    r = vectors(spark, d).select("vec_id", F.posexplode(softmax(F.col("a"))).alias("i", "p"))
    return r.select("vec_id", "i", F.round("p", 8).alias("p"), F.round(F.log("p"), 6).alias("log_p"))


@query("matmul", f"""with {_E}, m as (select vec_id, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda j: a[(k // 8) * 8 + j + 1] * b[j * 8 + k % 8 + 1]))) as c from e)
select vec_id, (generate_subscripts(c, 1) - 1)::int as i, round(unnest(c), 6) + 0 as x from m""")
def matmul(spark: SparkSession, d: str) -> DataFrame:
    """a as an 8 x 8 matrix times b as one, row by row in the arrays."""
    a, b = F.col("a"), F.col("b")
    cell = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, j: s + F.get(a, F.floor(k / 8).cast("int") * 8 + j) * F.get(b, j * 8 + k % 8))
    m = vectors(spark, d).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), cell)).alias("i", "x"))
    return m.select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query("gather_scatter", f"""with {_E}, r as (select label, (generate_subscripts(a, 1) - 1)::int as i, unnest(a) as x from e), s as (select label, i, sum(x) as total, count(*) as n from r group by 1, 2)
select label, i, round(total, 4) + 0 as scattered, round(total / n, 6) + 0 as mean, n::bigint as n from s""")
def gather_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Scatter-add of vectors to their label's row."""
    r = vectors(spark, d).select("label", F.posexplode("a").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n"))
    return r.select("label", "i", (F.round("t", 4) + 0.0).alias("scattered"), (F.round(F.col("t") / F.col("n"), 6) + 0.0).alias("mean"), "n")


@query("embedding_lookup", "select doc_id, e.vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) + 0 as total from documents d join embeddings e on e.vec_id = d.doc_id % 100")
def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Gather by index is an equi-join."""
    v = vectors(spark, d).select("vec_id", (F.round(total(F.col("a")), 6) + 0.0).alias("total"))
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("vec_id")).join(v, "vec_id").select("doc_id", "vec_id", "total")


@query("vector_topk", f"with {_E}, r as (select vec_id, (generate_subscripts(a, 1) - 1)::int as i, unnest(a) as x from e) select vec_id, (row_number() over (partition by vec_id order by x desc, i))::int as rank, i, x from r qualify rank <= 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five greatest components and their places (k is the feature), sorted in the array."""
    pairs = F.transform("a", lambda x, i: F.struct((-x).alias("key"), i.alias("i"), x.alias("x")))
    r = vectors(spark, d).select("vec_id", F.posexplode(F.slice(F.array_sort(pairs), 1, 5)).alias("k", "v"))
    return r.select("vec_id", (F.col("k") + 1).alias("rank"), F.col("v.i").alias("i"), F.col("v.x").alias("x"))


@query("attention", f"""with {_E}, t as (select vec_id, r::int as r, a[r * 8 + 1:r * 8 + 8] as q, b[r * 8 + 1:r * 8 + 8] as k from e, (select unnest(range(8)) as r) x),
s as (select x.vec_id, x.r, y.r as c, list_dot_product(x.q, y.k) / sqrt(8) as w, y.q as v from t x join t y on y.vec_id = x.vec_id), p as (select *, exp(w - max(w) over (partition by vec_id, r)) as e from s), z as (select *, e / sum(e) over (partition by vec_id, r) as p from p)
select vec_id, r, round(sum(p * v[1]), 6) + 0 as first, round(sum(p * v[8]), 6) + 0 as last, round(max(p), 6) as sharpest, count(*) filter (where p > 0.12 or r = c)::bigint as kept from z group by vec_id, r""")
def attention(spark: SparkSession, d: str) -> DataFrame:
    """Scaled dot-product attention inside each vector taken as eight tokens of eight: eight by eight pairs a row, in arrays."""
    a, b = F.col("a"), F.col("b")
    part = lambda x, r: F.slice(x, r * 8 + 1, F.lit(8))
    rows = F.sequence(F.lit(0), F.lit(7))
    t = vectors(spark, d).select("vec_id", "a", "b", F.explode(rows).alias("r"))
    t = t.withColumn("p", softmax(F.transform(rows, lambda c: dot(part(a, F.col("r")), part(b, c)) / F.sqrt(F.lit(8.0)))))
    mix = lambda j: F.aggregate(F.transform("p", lambda p, c: p * F.get(a, c * 8 + j)), F.lit(0.0), lambda s, x: s + x)
    kept = F.size(F.filter(F.transform("p", lambda p, c: (p > 0.12) | (c == F.col("r"))), lambda x: x)).cast("long")
    return t.select("vec_id", "r", (F.round(mix(0), 6) + 0.0).alias("first"), (F.round(mix(7), 6) + 0.0).alias("last"), F.round(F.array_max("p"), 6).alias("sharpest"), kept.alias("kept"))


@query("affinity", """
with c as (select conv_id, turn, role from conversations)
select a.conv_id, a.turn, round(sum(1 / (1 + abs(a.turn - b.turn) / 32) * case when a.role = b.role then 1 else 0.1 end)::double, 6) as affinity from c a join c b on b.conv_id = a.conv_id and abs(a.turn - b.turn) between 1 and 8 group by a.conv_id, a.turn, a.role""")  # fmt: skip
def affinity(spark: SparkSession, d: str) -> DataFrame:
    """Distance-decayed affinity of a turn to those up to eight turns away: shifted copies, so pairs grow with rows alone."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    near = c.select("conv_id", F.col("role").alias("r2"), F.col("turn").alias("t2"), F.explode(F.array(*(F.lit(k) for k in range(-8, 9) if k))).alias("k")).select("conv_id", "r2", F.col("k").alias("k"), (F.col("t2") + F.col("k")).alias("turn"))
    w = 1 / (1 + F.abs("k") / 32) * F.when(F.col("role") == F.col("r2"), 1.0).otherwise(0.1)
    return c.join(near, ["conv_id", "turn"]).groupBy("conv_id", "turn", "role").agg(F.round(F.sum(w), 6).alias("affinity")).drop("role")


@query("rotary", f"with {_E}, r as (select vec_id, unnest(range(32))::int as i, a from e) select vec_id, i, round(a[2 * i + 1] * cos(vec_id % 100 / power(10000, i / 32)) - a[2 * i + 2] * sin(vec_id % 100 / power(10000, i / 32)), 5) + 0 as re, round(a[2 * i + 1] * sin(vec_id % 100 / power(10000, i / 32)) + a[2 * i + 2] * cos(vec_id % 100 / power(10000, i / 32)), 5) + 0 as im from r")
def rotary(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of components turned by their position's angles (complex multiplication)."""
    r = vectors(spark, d).select("vec_id", "a", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    angle = (F.col("vec_id") % 100) / F.pow(F.lit(10000.0), F.col("i") / 32)
    x, y = F.get("a", 2 * F.col("i")), F.get("a", 2 * F.col("i") + 1)
    return r.select("vec_id", "i", (F.round(x * F.cos(angle) - y * F.sin(angle), 5) + 0.0).alias("re"), (F.round(x * F.sin(angle) + y * F.cos(angle), 5) + 0.0).alias("im"))


@query("positional_encoding", "select o_orderkey, i::int as i, round(case when i % 2 = 0 then sin(o_orderkey % 512 / power(10000, (i // 2 * 2) / 8)) else cos(o_orderkey % 512 / power(10000, (i // 2 * 2) / 8)) end, 6) + 0 as pe from orders, (select unnest(range(8)) as i) r")
def positional_encoding(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    angle = (F.col("o_orderkey") % 512) / F.pow(F.lit(10000.0), F.floor(F.col("i") / 2) * 2 / 8)
    return o.select("o_orderkey", "i", (F.round(F.when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6) + 0.0).alias("pe"))


@query("allclose", f"with {_E} select vec_id, list_bool_and(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]) <= 0.3 + 0.1 * abs(p[2]))) as close, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6) as furthest from e")
def allclose(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.select("vec_id", F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) <= 0.3 + 0.1 * F.abs(y)), lambda x: x).alias("close"), F.round(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))), 6).alias("furthest"))


@query("pooled_quantised", f"with {_E}, p as (select vec_id, unnest(range(16))::int as i, a from e) select vec_id, i, trunc(tanh(list_avg(a[i * 4 + 1:i * 4 + 4])) * 32767)::int as q from p")
def pooled_quantised(spark: SparkSession, d: str) -> DataFrame:
    """Means of four, squashed and cut to 16 bits."""
    q = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.tanh(total(F.slice("a", i * 4 + 1, F.lit(4))) / 4) * 32767).cast("int"))
    return vectors(spark, d).select("vec_id", F.posexplode(q).alias("i", "q"))


@query("convolution", f"with {_E}, p as (select vec_id, unnest(range(62))::int as i, a from e) select vec_id, i, round(0.25 * a[i + 1] + 0.5 * a[i + 2] + 0.25 * a[i + 3], 6) + 0 as y from p")
def convolution(spark: SparkSession, d: str) -> DataFrame:
    """One-dimensional convolution with (1/4, 1/2, 1/4), without padding."""
    a = F.col("a")
    y = F.transform(F.sequence(F.lit(0), F.lit(61)), lambda i: 0.25 * F.get(a, i) + 0.5 * F.get(a, i + 1) + 0.25 * F.get(a, i + 2))
    return vectors(spark, d).select("vec_id", F.posexplode(y).alias("i", "y")).select("vec_id", "i", (F.round("y", 6) + 0.0).alias("y"))
