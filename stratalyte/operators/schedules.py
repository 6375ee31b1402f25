"""Schedules, fixed-point logarithms, format headers and other scalar helpers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalyte.plans.registry import query, table


def parse_schedule(text: str) -> tuple[list[tuple[float, float]], float | None]:
    """`v0,p1,v1,...[,pD]`: values with the positions from which they hold, and the power of the decay after the last."""
    parts = [x.strip() for x in text.split(",")]
    power = float(parts.pop()[1:]) if parts and re.fullmatch(r"p[\d.]+", parts[-1]) else None
    points = [(0.0, float(parts[0]))] + [(float(p), float(v)) for p, v in zip(parts[1::2], parts[2::2])]
    return points, power


def schedule(text: str, at: Column) -> Column:
    """Piecewise linear between the points, then the last value, or its decay (position / last position)^-power."""
    points, power = parse_schedule(text)
    p, v = points[-1]
    out = F.lit(v) * F.pow(at / p, F.lit(-power)) if power is not None and p > 0 else F.lit(v)
    for (p0, v0), (p1, v1) in reversed(list(zip(points, points[1:]))):
        out = F.when(at < p1, v0 + (v1 - v0) * (at - p0) / (p1 - p0)).otherwise(out)
    return out


SCHEDULE = "1,10,2,p0.5"


@query("schedule", "select o_orderkey, round(case when o_orderkey % 100 < 10 then 1 + (o_orderkey % 100) / 10.0 else 2 * power((o_orderkey % 100) / 10.0, -0.5) end::double, 6) as rate from orders")
def schedule_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(schedule(SCHEDULE, F.col("o_orderkey") % 100), 6).alias("rate"))


def fixed_log2(n: Column) -> Column:
    """log2 in 1/1024, cut down: the whole part from the number of bits, the rest by the leading ten bits."""
    bits = F.length(F.bin(n)) - 1
    lead = F.floor(n * 1024 / F.pow(F.lit(2.0), bits))
    return bits * 1024 + F.floor(F.log2(lead / 1024.0) * 1024 + 1e-9)


@query("fixed_log2", "with v as (select o_orderkey, o_orderkey as n, length(bin(o_orderkey)) - 1 as bits from orders where o_orderkey > 0) select o_orderkey, (bits * 1024 + floor(log2(floor(n * 1024 / power(2, bits)) / 1024.0) * 1024 + 1e-9))::bigint as log2_1024 from v")
def fixed_log2_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey > 0").select("o_orderkey", fixed_log2(F.col("o_orderkey")).cast("long").alias("log2_1024"))


@query("format_detection", "select o_orderkey, case when (h & 32768) = 0 then 'plain' when (h & 15) = 6 then 'lstm' when (h & 15) = 8 then 'transformer' else 'neural' end as format from (select o_orderkey, ((o_orderkey * 2654435761) >> 8 & 65535) as h from orders) q")
def format_detection(spark: SparkSession, d: str) -> DataFrame:
    """Format by header bits: 0x8000 marks a neural one, the low four bits its kind."""
    h = F.shiftright(F.col("o_orderkey") * F.lit(2654435761), 8).bitwiseAND(65535)
    low = h.bitwiseAND(15)
    return table(spark, d, "orders").select("o_orderkey", F.when(h.bitwiseAND(32768) == 0, "plain").when(low == 6, "lstm").when(low == 8, "transformer").otherwise("neural").alias("format"))


#: Ranges of the settings a profile may have.
RANGES = {"seg_len": (1, 1024), "batch": (1, 1024), "hidden": (32, 4096), "lr": (1e-6, 1.0)}


@query("parameter_validation", """
with p as (select p_partkey, p_size as seg_len, p_size * 2 as batch, p_size * 16 as hidden, p_retailprice / 1e4 as lr from part)
select p_partkey, ((seg_len not between 1 and 1024)::int + (batch not between 1 and 1024)::int + (hidden not between 32 and 4096)::int + (lr not between 1e-6 and 1)::int + (hidden % 32 <> 0)::int) as errors, ((batch & (batch - 1)) <> 0)::int as warnings from p""")  # fmt: skip
def parameter_validation(spark: SparkSession, d: str) -> DataFrame:
    """Settings made from a part's figures: out of range or not in steps of 32 is an error, a batch that is no power of two a warning."""
    s = F.col("p_size")
    values = {"seg_len": s, "batch": s * 2, "hidden": s * 16, "lr": F.col("p_retailprice") / 1e4}
    errors = sum(((~values[k].between(a, b)).cast("int") for k, (a, b) in RANGES.items()), (values["hidden"] % 32 != 0).cast("int"))
    return table(spark, d, "part").select("p_partkey", errors.alias("errors"), (values["batch"].bitwiseAND(values["batch"] - 1) != 0).cast("int").alias("warnings"))


class Pcg:
    """A 32-bit permuted congruential generator, with uniform and normal numbers."""

    def __init__(self, seed: int):
        self.state = 0
        self.next()
        self.state = self.state + seed & (1 << 64) - 1
        self.next()

    def next(self) -> int:
        old = self.state
        self.state = old * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        x = (old >> 18 ^ old) >> 27 & 0xFFFFFFFF
        r = old >> 59
        return (x >> r | x << (-r & 31)) & 0xFFFFFFFF

    def uniform(self) -> float:
        return self.next() / 2**32

    def normal(self) -> float:
        u, v = max(self.uniform(), 2**-33), self.uniform()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
