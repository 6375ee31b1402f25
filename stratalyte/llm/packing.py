"""Packing as cutting stock, by column generation.

Every document is cut into pieces of the full length and a rest. Pieces are counted by length class (of 16 tokens
by default). A linear program over patterns, multisets of classes that fit one sequence, asks for the fewest
sequences that take all pieces; columns are priced by a knapsack dynamic program over the dual values until none
improves. Pattern counts are rounded down, and what they leave (bounded by the number of classes, not by the data)
is filled greedily. Pieces are ranked within their class, and a rank tells the pattern, its copy and so the
sequence, with no search at all.

Ranks come from counts of (class, hash bucket), so a class with a third of all pieces is ranked in many tasks.
Only the histogram and the patterns reach the driver; both are bounded by the number of classes.

Defined results: a null or empty text is its end id alone; rows with equal doc_id are packed one by one; a null
doc_id is carried as null; an empty table has no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ragged, tidy
from .tokens import default_tokenizer, encoder

BUCKET_ROWS = 50_000


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most value of any multiset of items within the capacity, and how many of each."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_, values_ = sizes[order], values[order]
    fit = np.searchsorted(sizes_, np.arange(capacity + 1), "right")
    for w in range(1, capacity + 1):
        best[w], took[w] = best[w - 1], -1
        if fit[w]:
            gain = values_[: fit[w]] + best[w - sizes_[: fit[w]]]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], took[w] = gain[k], k
    count = np.zeros(len(sizes), np.int64)
    w = capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            count[order[took[w]]] += 1
            w -= int(sizes_[took[w]])
    return float(best[capacity]), count


def _refined(a: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A step of Newton's iteration for the inverse: takes back the rounding of many updates, with products alone."""
    return inverse @ (2 * np.eye(len(a)) - a @ inverse)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, rounds: int = 500, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional counts of a cover of the demand, within half a sequence or the share `gap` of the least."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    demand = demand + 1e-4 * (1 + np.arange(m) * 0.618 % 1)  # no two ratios are equal, so no round stands still
    centre, bound = None, 0.0
    for k in range(rounds):
        if k % 50 == 49:
            inverse = _refined(basis, inverse)
        x = inverse @ demand
        dual = cost @ inverse
        low = int(dual.argmin())
        if dual[low] < -1e-9:
            column, price = -np.eye(m)[low], 0.0  # more than asked of a class
        else:
            used = float(cost @ x)
            # Prices between the present duals and those of the best bound so far swing less; the present ones decide.
            for prices in ([0.6 * centre + 0.4 * dual] if centre is not None else []) + [dual]:
                value, count = knapsack(np.maximum(prices, 0), sizes, capacity)
                if (least := float(np.maximum(prices, 0) @ demand) / max(value, 1.0)) > bound:
                    bound, centre = least, np.maximum(prices, 0) / max(value, 1.0)
                if (gain := float(count @ dual)) > 1 + 1e-9:
                    break
            if gain <= 1 + 1e-9 or used - bound <= max(0.5, gap * used):
                break
            column, price = count.astype(float), 1.0
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, price
        row = inverse[out] / step[out]
        step[out] -= 1.0
        inverse = inverse - np.outer(step, row)
    x = _refined(basis, inverse) @ demand
    return [(basis[:, k].astype(np.int64), float(x[k])) for k in range(m) if cost[k] > 0 and x[k] > 1e-9]


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold every piece."""
    if not len(sizes):
        return []
    whole = [(p, int(np.floor(x + 1e-9))) for p, x in column_generation(sizes, demand.astype(float), capacity)]
    left = demand.astype(np.int64).copy()
    out = []
    for p, n in sorted(whole, key=lambda t: -t[1]):
        # Never more sequences than the most wanted of its classes still needs.
        need = int(max((-(-left[c] // p[c]) for c in np.flatnonzero(p)), default=0))
        if (n := min(n, need)) > 0:
            out.append((p, n))
            left = np.maximum(left - p * n, 0)
    rest: Counter = Counter()
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        room, p = capacity, np.zeros(len(sizes), np.int64)
        for c in order:
            if k := min(int(left[c]), room // int(sizes[c])):
                p[c] = k
                room -= k * int(sizes[c])
        copies = max(1, int(min(left[c] // p[c] for c in np.flatnonzero(p))))
        rest[tuple(p)] += copies
        left = left - p * copies
    return out + [(np.array(p), n) for p, n in rest.items()]


@dataclass
class Plan:
    """For each class: first rank, pieces a sequence, first sequence of each run of ranks."""

    first: list[np.ndarray]
    each: list[np.ndarray]
    base: list[np.ndarray]

    @classmethod
    def of(cls, n_classes: int, sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> Plan:
        first, each, base = ([[] for _ in range(n_classes + 1)] for _ in range(3))
        given = np.zeros(n_classes + 1, np.int64)
        sequence = 0
        for p, n in patterns:
            for k in np.flatnonzero(p):
                c = int(sizes[k])
                first[c].append(int(given[c]))
                each[c].append(int(p[k]))
                base[c].append(sequence)
                given[c] += int(p[k]) * n
            sequence += n
        return cls(*([np.array(x, np.int64) for x in y] for y in (first, each, base)))

    def sequence(self, cls_: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        for c in np.unique(cls_).tolist():
            at = np.flatnonzero(cls_ == c)
            k = np.searchsorted(self.first[c], rank[at], "right") - 1
            out[at] = self.base[c][k] + (rank[at] - self.first[c][k]) // self.each[c][k]
        return out


def cut(docs: DataFrame, *, length: int, end_id: int, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, and their ids if asked for."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for b in batches:
                doc = b.column("doc_id")
                for lo, ids, at in enc.encode_column(b.column("text"), end_id):
                    size = np.diff(at)
                    n = -(-size // length)
                    row, start = np.repeat(np.arange(len(size)), n), ragged(n) * length
                    first = at[:-1][row] + start
                    taken = np.minimum(size[row] - start, length)
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + taken).tolist())]
                    cols = [doc.take(pa.array(lo + row)), pa.array(start), pa.array(taken), pa.array(crc, pa.int64()), pa.array(size[row])]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, at[-1]).astype(np.int32)), pa.array(ids.view(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:
            enc.forget()  # the worker goes on to other stages

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(tidy(of), ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names))


def pack(docs: DataFrame, *, length: int = 2048, grain: int = 16, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of `cut` with sequence_id and offset."""
    capacity = length // grain
    pieces = materialise(cut(docs, length=length, end_id=end_id, tokenizer=tokenizer, with_ids=with_ids), "pieces")
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    placed = pieces.withColumns({"class": F.ceil(F.col("length") / grain).cast("int"), "bucket": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")})
    counts = materialise(placed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = counts.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()
    sizes = np.array([r["class"] for r in histogram], np.int64)
    plan = Plan.of(capacity, sizes, plan_patterns(sizes, np.array([r["n"] for r in histogram], np.int64), capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32"))
    ranked = placed.withColumn("r", within - 1).join(before, ["class", "bucket"]).withColumn("rank", F.col("r") + F.col("before"))

    @F.arrow_udf("long")
    def sequence_of(c: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.array(plan.sequence(c.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)))

    seated = ranked.withColumn("sequence_id", sequence_of("class", "rank"))
    seat = Window.partitionBy("sequence_id").orderBy("class", "rank")
    return seated.withColumn("offset", F.sum("length").over(seat) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")
