"""Dictionary building by merging pairs of symbols, and coding with the dictionary.

A symbol below 256 is a byte; a larger one is a pair of symbols. Each round counts the pairs next to each other over
all texts, scores the gain in bits, takes the best pairs that share no symbol, and replaces them in every text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyte.functions.byteview import BYTES_SQL, in_batches, map_bytes, pieces, text_bytes
from stratalyte.plans.registry import query, table

WORD_COST_BITS = 7
ROUND_PAIRS = 100


@dataclass
class Dictionary:
    """pairs[i] makes symbol 256 + i; rounds hold how many pairs each round added."""

    pairs: list[tuple[int, int]] = field(default_factory=list)
    rounds: list[int] = field(default_factory=list)

    def expand(self, symbol: int) -> bytes:
        return bytes([symbol]) if symbol < 256 else b"".join(map(self.expand, self.pairs[symbol - 256]))

    def encode(self, data: bytes) -> np.ndarray:
        s = np.frombuffer(data, np.uint8).astype(np.int32)
        at = 0
        for n in self.rounds:
            s = replace_pairs(s, {p: 256 + at + i for i, p in enumerate(self.pairs[at : at + n])})
            at += n
        return s

    def decode(self, symbols: np.ndarray) -> bytes:
        words = {int(x): self.expand(int(x)) for x in np.unique(symbols)}
        return b"".join(words[int(x)] for x in symbols)


def replace_pairs(s: np.ndarray, to: dict[tuple[int, int], int]) -> np.ndarray:
    """Pairs replaced from left to right; where the same symbol stands twice or more, every second place counts."""
    if len(s) < 2 or not to:
        return s
    keys = np.array(sorted((a << 32 | b) for a, b in to), np.int64)
    codes = np.array([to[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in keys], np.int32)
    code = s[:-1].astype(np.int64) << 32 | s[1:]
    at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
    hit = keys[at] == code
    # Pairs of a round share no symbol, so hits overlap only in runs of one symbol: keep those at even places of a run.
    start = hit & ~np.concatenate([[False], hit[:-1]])
    run = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
    hit &= run % 2 == 0
    out = s.copy()
    where = np.flatnonzero(hit)
    out[where] = codes[at[where]]
    keep = np.ones(len(s), bool)
    keep[where + 1] = False
    return out[keep]


def pair_counts(symbols: DataFrame) -> DataFrame:
    """a, b, n over all rows of `symbols` (array<int>), combined in each task before the shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(0)
            v = s.flatten().to_numpy().astype(np.int64)
            ends = s.offsets.to_numpy()[1:-1] - s.offsets[0].as_py() - 1
            ok = np.ones(max(0, len(v) - 1), bool)
            ok[ends[(ends >= 0) & (ends < len(ok))]] = False
            code, n = np.unique((v[:-1] << 32 | v[1:])[ok], return_counts=True) if len(v) > 1 else (v[:0], v[:0])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

    got = symbols.select("s").mapInArrow(of, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return got.select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")


def byte_counts(df: DataFrame, text: str = "text", *, pairs: bool = False) -> DataFrame:
    """symbol, n (or a, b, n): how often each byte (pair of neighbours) stands in all texts. A task sums up all its texts in one array and gives at most 256 (65,536) rows."""
    width = 1 << 16 if pairs else 1 << 8

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in (x for whole in batches for x in pieces(whole)):
            v, starts = text_bytes(b.column(0))
            if pairs and len(v):
                ok = np.ones(len(v), bool)
                ok[starts[1:][starts[1:] > 0] - 1] = False  # the last byte of a text has no neighbour
                v = (v[:-1].astype(np.int64) << 8 | v[1:])[ok[:-1]]
            total += np.bincount(v, minlength=width)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    got = in_batches(df.select(text), of, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    low = F.col("code").bitwiseAND(255).cast("int")
    return got.select(F.shiftright("code", 8).cast("int").alias("a"), low.alias("b"), "n") if pairs else got.select(low.alias("symbol"), "n")


def symbol_counts(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.explode("s").alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def gains(pairs: DataFrame, singles: DataFrame) -> DataFrame:
    """Bits saved by making each pair a symbol: its cost as two symbols less that as one, less the word's own cost."""
    total = singles.agg(F.sum("n").alias("total"))  # one row
    one = lambda name: singles.select(F.col("symbol").alias(name), F.col("n").alias(f"n_{name}"))
    x = pairs.join(F.broadcast(one("a")), "a").join(F.broadcast(one("b")), "b").join(F.broadcast(total))
    bits = lambda n: F.log2("total") - F.log2(n)
    gain = F.col("n") * (bits("n_a") + bits("n_b") - bits("n")) - WORD_COST_BITS
    return x.select("a", "b", "n", F.when(F.col("n") <= 1, -1.0).otherwise(F.round(gain, 6)).alias("gain"))


def build(docs: DataFrame, *, words: int, min_freq: int = 4) -> Dictionary:
    """Rounds of at most 100 pairs until there are `words` of them or nothing is gained.

    Only the best few hundred pairs of a round reach the driver. Texts are coded afresh with the dictionary so far in
    each round, so nothing is cached and a lost executor costs only its tasks."""
    book = Dictionary()
    while len(book.pairs) < words:

        def of(batches: Iterator[pa.RecordBatch], book: Dictionary = book) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([book.encode((t.as_py() or "").encode()) for t in b.column(0)], pa.list_(pa.int32()))], ["s"])

        symbols = docs.select("text").mapInArrow(of, "s array<int>")
        best = gains(pair_counts(symbols), symbol_counts(symbols)).where((F.col("n") >= min_freq) & (F.col("gain") > 0)).orderBy(F.desc("gain"), "a", "b").limit(4 * ROUND_PAIRS).collect()
        used: set[int] = set()
        chosen = []
        for r in best:
            if len(chosen) < min(ROUND_PAIRS, words - len(book.pairs)) and not {r["a"], r["b"]} & used:
                used |= {r["a"], r["b"]}
                chosen.append((r["a"], r["b"]))
        if not chosen:
            break
        book = Dictionary(book.pairs + chosen, [*book.rounds, len(chosen)])
    return book


@query("pair_counts", f"with {BYTES_SQL}, n as (select doc_id, b as a, lead(b) over (partition by doc_id order by pos) as b from bytes) select a, b, count(*)::bigint as n from n where b is not null group by 1, 2")
def pair_count_query(spark: SparkSession, d: str) -> DataFrame:
    return byte_counts(table(spark, d, "documents"), pairs=True)


_SYMBOLS = f"with {BYTES_SQL}, f as (select b, sum(c) as n from hist group by b), t as (select sum(n) as t from f)"


@query("symbol_frequencies", _SYMBOLS + " select b as symbol, n::bigint as n, round(log2(t) - log2(n), 6) as bits, round(sum(n) over (order by n desc, b) / t * 100, 6)::double as cumulative, (row_number() over (order by n desc, b))::int as rank from f, t")
def symbol_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """At most 256 rows: frequency, bit cost, cumulative percent, in the sorted dictionary's order."""
    f = byte_counts(table(spark, d, "documents"))
    w = Window.orderBy(F.desc("n"), "symbol")
    total = F.sum("n").over(Window.partitionBy())
    return f.select("symbol", "n", F.round(F.log2(total) - F.log2("n"), 6).alias("bits"), F.round(F.sum("n").over(w) / total * 100, 6).alias("cumulative"), F.row_number().over(w).alias("rank"))


@query("corpus_entropy_bits", _SYMBOLS + " select round(sum(n * (log2(t) - log2(n))), 2) as bits, sum(n)::bigint as symbols from f, t")
def corpus_entropy_bits(spark: SparkSession, d: str) -> DataFrame:
    f = symbol_frequencies(spark, d)
    t = f.agg(F.sum("n").alias("t"))  # one row
    return f.join(F.broadcast(t)).agg(F.round(F.sum(F.col("n") * (F.log2("t") - F.log2("n"))), 2).alias("bits"), F.sum("n").alias("symbols"))


@query("pair_gains", _SYMBOLS + """, nx as (select doc_id, b as a, lead(b) over (partition by doc_id order by pos) as b from bytes), p as (select a, b, count(*) as n from nx where b is not null group by 1, 2)
select p.a, p.b, p.n::bigint as n, case when p.n <= 1 then -1 else round(p.n * (log2(t) - log2(fa.n) + log2(t) - log2(fb.n) - (log2(t) - log2(p.n))) - 7, 2) + 0 end::double as gain from p join f fa on fa.b = p.a join f fb on fb.b = p.b, t""")  # fmt: skip
def pair_gains(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return gains(byte_counts(docs, pairs=True), byte_counts(docs)).select("a", "b", "n", (F.round("gain", 2) + 0.0).alias("gain"))


@query("dictionary_roundtrip", "select item_id, octet_length(encode(text))::bigint as size, true as ok from benchmark")
def dictionary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of 200 words built from the benchmark texts; every text coded and decoded again."""
    docs = table(spark, d, "benchmark")
    book = build(docs, words=200)

    def check(b: np.ndarray) -> tuple[int, bool]:
        raw = b.tobytes()
        return len(raw), book.decode(book.encode(raw)) == raw

    return map_bytes(docs, "item_id", "text", check, {"size": "long", "ok": "boolean"})
