"""Byte-level statistics of whole texts in one vectorised pass, without a row for each byte.

`byte_profile` gives one row for each text: what any of the byte metrics needs, as plain columns, so that the metrics
themselves are Column expressions. It moves no row between partitions.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAG = 8
BLOCK = 64


def entropy_of(counts: np.ndarray) -> float:
    c = counts[counts > 0]
    p = c / c.sum() if len(c) else c
    return float(-(p * np.log2(p)).sum()) if len(c) else 0.0


def conditional_entropy(b: np.ndarray, lag: int = LAG) -> float:
    """Entropy of a byte given the byte `lag` places before it, in bits."""
    if len(b) <= lag:
        return 0.0
    pair = b[:-lag].astype(np.int64) * 256 + b[lag:]
    joint = np.unique(pair, return_counts=True)[1]
    return entropy_of(joint) - entropy_of(np.bincount(b[:-lag], minlength=256))


_C_LOG_C = np.array([0.0, *(c * np.log2(c) for c in range(1, 2 * BLOCK + 1))])
#: Bytes that are looked at together: what is made of a byte (row, histogram slot, product) takes some 100 times as much memory while a piece is worked on.
CHUNK = 1 << 18
#: Texts that are looked at together: a histogram of 256 longs each.
TEXTS = 1000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that a Python worker is given: it holds two of them. Spark's own limits are 10,000 rows and 64 MB.
BATCH = 4 << 20


def block_variances(flat: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each text the mean squared difference between its entropy and that around each block's middle (bytes from one block before it to one after); 0 for texts of one block."""
    n = np.diff(starts)
    count = -(-n // BLOCK)
    out = np.zeros(len(n))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CHUNK, "right")) - 1)
        b = flat[starts[lo] : starts[hi]]
        first = np.cumsum(count[lo:hi]) - count[lo:hi]
        inner = np.arange(len(b)) - np.repeat(starts[lo:hi] - starts[lo], n[lo:hi])
        block = np.repeat(first, n[lo:hi]) + inner // BLOCK
        total = int(count[lo:hi].sum())
        h = np.bincount(block * 256 + b, minlength=total * 256).reshape(total, 256)
        opens = np.zeros(total, bool)
        opens[first[count[lo:hi] > 0]] = True
        h[1:] += np.where(opens[1:, None], 0, h[:-1])
        size = h.sum(1)
        entropy = np.log2(np.maximum(size, 1)) - _C_LOG_C[h].sum(1) / np.maximum(size, 1)
        text = np.repeat(np.arange(lo, hi), count[lo:hi])
        sums = np.bincount(text - lo, (entropy - whole[text]) ** 2, minlength=hi - lo)
        out[lo:hi] = np.where(count[lo:hi] > 1, sums / np.maximum(count[lo:hi], 1), 0.0)
        lo = hi
    return out


def profiles(flat: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for the texts whose bytes stand one after another in `flat`."""
    n = np.diff(starts)
    texts = len(n)
    row = np.repeat(np.arange(texts), n)
    h = np.bincount(row * 256 + flat, minlength=texts * 256).reshape(texts, 256)
    inner = row[1:] == row[:-1]
    alpha = ((flat >= 65) & (flat <= 90)) | ((flat >= 97) & (flat <= 122))
    begins = alpha.copy()
    begins[1:] &= ~(alpha[:-1] & inner)
    product = flat[1:].astype(np.int64) * flat[:-1]
    count = lambda mask, rows: np.bincount(rows[mask], minlength=texts)
    value = np.arange(256)
    padded = np.append(flat, np.uint8(0))
    return {
        "n": n,
        "hist": h,
        "same": count(inner & (flat[1:] == flat[:-1]), row[1:]),
        "sum": h @ value,
        "sumsq": h @ (value * value),
        "lagged": np.bincount(row[1:][inner], product[inner], minlength=texts).astype(np.int64),
        "first": np.where(n > 0, padded[starts[:-1]], 0),
        "last": np.where(n > 0, padded[np.maximum(starts[1:] - 1, 0)], 0),
        "words": count(begins, row),
    }


SCHEMA = "n long, hist array<long>, same long, sum long, sumsq long, lagged long, first int, last int, words long"
#: Columns that cost more and are made if asked for.
EXTRA = {"cond": "cond double", "block_var": "block_var double", "repeats": "again4 long, blocks4 long, again2 long"}


def repeats(b: np.ndarray) -> tuple[int, int, int]:
    """Positions whose four bytes come again four or more places later; every fourth position whose four bytes come
    again at such a position; positions whose two bytes come again two or more places later."""
    b = b.astype(np.int64)

    def later(gram: np.ndarray, gap: int) -> int:
        if not len(gram):
            return 0
        back = np.unique(gram, return_inverse=True)[1]
        last = np.zeros(back.max() + 1, np.int64)
        last[back] = np.arange(len(gram))  # the last write wins
        return int((last[back] - np.arange(len(gram)) >= gap).sum())

    four = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:] if len(b) > 3 else b[:0]
    return later(four, 4), later(four[::4], 1), later(b[:-1] << 8 | b[1:], 2)


def byte_profile(df: DataFrame, key: str = "doc_id", text: str = "text", *, extra: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """`key`, the columns `carry`, those of SCHEMA and of EXTRA as far as asked for: one row for each row of df, in one pass."""
    kept = [key, *carry]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), SCHEMA, *(EXTRA[x] for x in extra)])
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]
    types = {"first": pa.int32(), "last": pa.int32(), "cond": pa.float64(), "block_var": pa.float64()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                flat, starts = text_bytes(b.column(len(kept)))
                cols = profiles(flat, starts)
                each = lambda fn: [fn(flat[x:y]) for x, y in zip(starts.tolist(), starts[1:].tolist())]  # noqa: E731, B023
                if "cond" in extra:
                    cols["cond"] = np.array(each(conditional_entropy))
                if "block_var" in extra:
                    n, h = cols["n"], cols["hist"]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        p = h / n[:, None]
                        entropy = -np.where(h > 0, p * np.log2(p), 0.0).sum(1)
                    cols["block_var"] = block_variances(flat, starts, entropy)
                if "repeats" in extra:
                    cols |= dict(zip(("again4", "blocks4", "again2"), np.array(each(repeats), np.int64).reshape(-1, 3).T))
                hist = pa.ListArray.from_arrays(pa.array(np.arange(len(starts), dtype=np.int32) * 256), pa.array(cols.pop("hist").reshape(-1)))
                made = [hist if x == "hist" else pa.array(cols[x]).cast(types.get(x, pa.int64())) for x in names[len(kept) :]]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *made], names)

    return in_batches(df.select(*kept, text), of, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts or binaries (null: none) one after another, and where each begins, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    return flat, starts - starts[0]


def release() -> None:
    """Give memory that is free back to the system: Python workers outlive their tasks, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory after each batch it gets and when its task ends."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            release()

    @functools.wraps(of)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(each(batches))
        finally:
            release()

    return tidied


def in_batches(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(tidy(of), schema) in batches of about BATCH bytes, so that memory does not follow the partition. Plans are run after this returns, so the limit stays set in the session, unless it has one of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, str(BATCH))
    return df.mapInArrow(tidy(of), schema)


def pieces(b: pa.RecordBatch, size: int = CHUNK, rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of its last column, and at most `rows` rows; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        hi = min(hi, lo + rows)
        yield b.slice(lo, hi - lo)
        lo = hi


def hist_sum(hist: Column, where) -> Column:
    """Bytes whose value meets where(value)."""
    return F.aggregate(F.transform(hist, lambda c, i: F.when(where(i), c).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def hist_count(hist: Column, values: str) -> Column:
    """Bytes among the characters of `values`."""
    cols = [F.get(hist, F.lit(ord(c))) for c in values]
    return sum(cols[1:], cols[0])


def hist_entropy(hist: Column, n: Column) -> Column:
    term = F.aggregate(hist, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))
    return F.when(n > 0, term).otherwise(0.0)


def hist_unique(hist: Column) -> Column:
    return F.size(F.filter(hist, lambda c: c > 0)).cast("long")


#: DuckDB: a row (doc_id, pos, b) for each byte of documents.text, and counts of each value.
BYTES_SQL = """
bytes as (
  select doc_id, (generate_subscripts(l, 1) - 1)::bigint as pos, ('0x' || unnest(l))::int as b
  from (select doc_id, regexp_extract_all(hex(encode(text)), '..') as l from documents) q),
hist as (select doc_id, b, count(*) as c from bytes group by doc_id, b),
totals as (select doc_id, sum(c)::bigint as n, count(*)::bigint as uniq, sum(b = 0 and c > 0)::bigint as zeros from hist group by doc_id),
ent as (select doc_id, -sum(c / n * log2(c / n)) as h from hist join totals using (doc_id) group by doc_id)
"""


def map_bytes(df: DataFrame, key: str, text: str, fn, fields: dict[str, str]) -> DataFrame:
    """key and `fields` (name to SQL type): what fn(bytes as an array) gives for each whole text, a tuple."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "string": pa.string(), "boolean": pa.bool_()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole)):
            flat, starts = text_bytes(b.column(1))
            rows = [fn(flat[x:y]) for x, y in zip(starts.tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(fields.values()))], [key, *fields])

    return in_batches(df.select(key, text), of, f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in fields.items()))
