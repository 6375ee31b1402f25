"""Token-id files: an adaptive context-mixing range coder over ids.

Three predictions of each id are mixed: order 2 and order 1 each name the id that last followed the same two ids or
the same id, and order 0 gives every id a frequency (one of eight tables, the one nearest to the block's own counts).
The weights of the mixture depend on which predictions there are, whether they agree, and how many ids before were
foretold, and learn from each block's own hits. The mixture's interval of the id narrows a 64-bit range coder: one
step an id, whichever prediction it falls to. Blocks of ids are reset and checksummed one by one; many blocks of a
record are coded side by side, one array element each, in integer arithmetic only, so every machine decodes the
same bits.

A record (magic ACM2) holds whole documents in ascending doc_id order: their ids and counts, the frequency tables,
a table of blocks (kind of frequencies, bytes, crc32) and the block bytes. Records are rows of a Parquet folder in
the shared storage.

Defined results: a null or empty text has its end id alone; a null doc_id sorts first and stays null; rows with
equal doc_id stand one after another, ordered by text; a wrong checksum raises; an empty table makes no records;
more than 2^19 different ids in a record raise.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, tidy
from .tokens import default_tokenizer, encoder

MAGIC = b"ACM2"
BLOCK_IDS = 2048
LANES = 2048
RECORD_IDS = BLOCK_IDS * LANES
SLOT_BITS = 11
#: Weights are in 1/1024; they are worked out anew every GROUP ids.
WEIGHT_BITS, GROUP, KINDS = 10, 32, 8
#: States of the mixture: predictions (none, order 1, both and different, both and equal) times ids foretold in a row (0 to 3).
STATES = 16
#: What the counts of a state start from: events, hits of order 2, hits of order 1.
PRIOR = np.zeros((3, STATES), np.int64)
PRIOR[0], PRIOR[1, 8:12], PRIOR[1, 12:], PRIOR[2, 4:8], PRIOR[2, 8:12] = 32, 8, 16, 6, 3
#: Frequencies are stored as levels, four to each power of two.
LEVEL = np.array([(16, 19, 23, 27)[k % 4] << k // 4 for k in range(128)], np.int64)
#: Blocks are told apart by their counts of so many of the most frequent ids.
TOLD_BY = 1024
_HEAD = struct.Struct("<4sIQIII")
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_32, _LEAST, _FULL = np.uint64(32), np.uint64(1 << 32), np.uint64(2**64 - 1)


def turned(a: np.ndarray) -> np.ndarray:
    """The transpose, copied in strips that a cache line holds."""
    out = np.empty(a.shape[::-1], a.dtype)
    for lo in range(0, len(a), 16):
        out[:, lo : lo + 16] = a[lo : lo + 16].T
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(LEVEL, counts * 16, "right") - 1, 0, 127).astype(np.uint8)


def block_kinds(rows: np.ndarray, counts: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Which frequency table suits each block (a column of `rows`): split by the signs along the main axes of the counts, then moved to the table that costs least."""
    n = rows.shape[1]
    top = np.argsort(-counts, kind="stable")[: TOLD_BY - 1]
    place = np.full(len(counts), min(TOLD_BY, len(counts)) - 1, np.int64)
    place[top] = np.arange(len(top))
    width = int(place.max()) + 1
    c = np.empty((n, width), np.float32)
    for lo in range(0, n, 256):
        part = turned(rows[:, lo : lo + 256])
        at = place.take(part) + np.arange(len(part))[:, None] * width
        c[lo : lo + 256] = np.bincount(at.reshape(-1), minlength=len(part) * width).reshape(-1, width)
    x = np.sqrt(c)
    x -= x.mean(0)
    kind = np.zeros(n, np.int64)
    for k in range(KINDS.bit_length() - 1):
        axis = x[int((x * x).sum(1).argmax())]
        for _ in range(4):
            axis = (x @ axis) @ x
            axis = axis / max(float(np.sqrt(axis @ axis)), 1e-30)
        at = x @ axis
        kind += (at > 0).astype(np.int64) << k
        x -= at[:, None] * axis
    for _ in range(rounds):
        sums = np.stack([c[kind == k].sum(0) for k in range(KINDS)]) + (c.sum(0) + 1) * 1e-3
        kind = (c @ np.log(sums / sums.sum(1, keepdims=True)).T).argmax(1)
    return kind


class Orders:
    """The predictions of all blocks coded side by side: frequencies by kind, tables of the id that followed a context last, and the counts that the weights come from."""

    def __init__(self, levels: np.ndarray, kind: np.ndarray):
        self.width, n = levels.shape[1], len(kind)
        self.bits = np.uint32(18 if self.width <= 1 << 14 else 20)
        whole = 1 << int(self.bits)
        f = LEVEL[levels]
        f = f * (whole - self.width) // f.sum(1, keepdims=True) + 1
        f[np.arange(len(f)), f.argmax(1)] += whole - f.sum(1)
        self.freq, self.cum = f.astype(np.uint32).reshape(-1), (np.cumsum(f, 1) - f).astype(np.uint32).reshape(-1)
        self.range_shift = np.uint64(int(self.bits) + WEIGHT_BITS)
        self.own, self.own_slots = kind.astype(np.int64) * self.width, kind.astype(np.int64) << int(self.bits)
        self.type = np.uint16 if self.width < 65535 else np.uint32
        self.base = np.arange(n, dtype=np.int64) << SLOT_BITS
        self.t1, self.t2 = np.zeros(n << SLOT_BITS, self.type), np.zeros(n << SLOT_BITS, self.type)
        #: Events, and hits of either order at 20 bits more each: a block has fewer than 2^20 ids.
        self.counts = np.zeros(n * STATES, np.int64)
        self.lane = np.arange(n, dtype=np.int64) * STATES

    def slots(self) -> np.ndarray:
        """The id of each unit of frequency, for all kinds."""
        return np.repeat(np.arange(len(self.freq)) % self.width, self.freq).astype(self.type)

    def places(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift, a = np.uint32(32 - SLOT_BITS), last * _A
        return self.base + (a >> shift), self.base + ((a ^ before * _B) * _C >> shift)

    def states(self, p1: np.ndarray, p2: np.ndarray, run: np.ndarray) -> np.ndarray:
        # 0, 4, 8, 12: none, order 1 alone, both and different, both and equal
        both = (p2 > 0).view(np.int8)
        s = np.maximum((both & (p1 == p2).view(np.int8)) + (both << 1), (p1 > 0).view(np.int8))
        s <<= 2
        s += run
        return s + self.lane

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of order 2 and order 1 in each lane and state; order 0 has at least 1/64."""
        c = self.counts.reshape(-1, STATES)
        n = (c & 0xFFFFF) + PRIOR[0]
        return tuple((((c >> 20 * k & 0xFFFFF) + PRIOR[k]) * 1008 // n).astype(np.uint32).reshape(-1) for k in (1, 2))


_ONE, _HIT2, _HIT1 = 1, 1 + (1 << 20), 1 + (1 << 40)


def encode_blocks(rows: np.ndarray, m: Orders) -> list[bytes]:
    """The bytes of each block; rows: places of the ids in the record's list, a column for each block."""
    steps, n = rows.shape
    t1, t2 = m.t1, m.t2
    low, span = np.zeros(n, np.uint64), np.full(n, _FULL)
    cap = steps + 4
    out = np.zeros(n * cap, np.uint32)
    put = np.arange(n, dtype=np.int64) * cap
    first = put.copy()
    v = np.zeros((GROUP + 2, n), np.uint32)  # ids plus one; those of the two steps before come first
    hits = np.zeros((GROUP + 3, n), np.int8)

    def carry(lanes: np.ndarray) -> None:
        at = put[lanes] - 1
        while at.size:
            out[at] += np.uint32(1)
            at = at[out[at] == 0] - 1

    for lo in range(0, steps, GROUP):
        g = min(GROUP, steps - lo)
        sym = rows[lo : lo + g]
        np.add(sym, 1, out=v[2 : g + 2], casting="unsafe")
        i1, i2 = m.places(v[1 : g + 1], v[:g])
        now = v[2 : g + 2].astype(m.type)
        p1, p2 = np.empty((g, n), m.type), np.empty((g, n), m.type)
        for t in range(g):
            p1[t] = t1.take(i1[t])
            t1[i1[t]] = now[t]
            p2[t] = t2.take(i2[t])
            t2[i2[t]] = now[t]
        hit2 = now == p2
        hit1 = (now == p1) & ~hit2
        hits[3 : g + 3] = hit2 | hit1
        s = m.states(p1, p2, hits[2 : g + 2] * (1 + hits[1 : g + 1] * (1 + hits[:g])))
        w2, w1 = (w.take(s) for w in m.weights())
        for at, one in ((s, _ONE), (s[hit2], _HIT2 - 1), (s[hit1], _HIT1 - 1)):
            m.counts += np.bincount(at.reshape(-1), minlength=n * STATES) * one
        w = w2 + w1
        w0 = np.uint32(1 << WEIGHT_BITS) - w
        place = sym + m.own
        start, freq = (w << m.bits) + w0 * m.cum.take(place), w0 * m.freq.take(place)
        np.copyto(start, w2 << m.bits, where=hit1)
        np.copyto(freq, w1 << m.bits, where=hit1)
        np.copyto(start, np.uint32(0), where=hit2)
        np.copyto(freq, w2 << m.bits, where=hit2)
        start, freq = start.astype(np.uint64), freq.astype(np.uint64)
        for t in range(g):
            r = span >> m.range_shift
            add = r * start[t]
            low += add
            if (over := np.flatnonzero(low < add)).size:
                carry(over)
            np.multiply(r, freq[t], out=span)
            short = np.flatnonzero(span < _LEAST)
            k = low[short]
            out[put[short]] = k >> _32
            put[short] += 1
            low[short] = k << _32
            span[short] <<= _32
        v[:2] = v[g : g + 2]
        hits[:3] = hits[g : g + 3]
    last = low + np.uint64(0xFFFFFFFF)
    carry(np.flatnonzero(last < low))
    out[put] = last >> _32
    return [out[a : b + 1].astype(">u4").tobytes() for a, b in zip(first.tolist(), put.tolist())]


def decode_blocks(data: list[bytes], steps: int, m: Orders) -> np.ndarray:
    """The rows that encode_blocks took."""
    n = len(data)
    t1, t2, slots = m.t1, m.t2, m.slots()
    size = np.array([len(d) // 4 for d in data], np.int64)
    at = np.cumsum(size + 3) - (size + 3)
    words = np.zeros(int((size + 3).sum()), np.uint64)
    for d, b in zip(data, at.tolist()):
        words[b : b + len(d) // 4] = np.frombuffer(d, ">u4")
    ends = at + size + 1
    x = words[at] << _32 | words[at + 1]
    at += 2
    span = np.full(n, _FULL)
    got = np.empty((steps, n), np.uint32)
    last, before, run = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int8)
    ones, one, next_run = np.ones(n, np.int64), m.type(1), np.array([1, 2, 3, 3], np.int8)
    most, top, all_ = np.uint64((1 << int(m.range_shift)) - 1), np.uint32((1 << int(m.bits)) - 1), np.uint32(1 << WEIGHT_BITS)
    for t in range(steps):
        if t % GROUP == 0:
            w2_of, w1_of = m.weights()
            np.minimum(at, ends, out=at)  # damaged bytes must not lead beyond a block; the checksum tells
        i1, i2 = m.places(last, before)
        p1, p2 = t1.take(i1), t2.take(i2)
        s = m.states(p1, p2, run)
        w2, w1 = w2_of.take(s), w1_of.take(s)
        w = w2 + w1
        w0 = all_ - w
        r = span >> m.range_shift
        q = np.minimum(x // r, most).astype(np.uint32)
        hit = (q >> m.bits) < w
        above = w << m.bits
        sym = slots.take(np.minimum((q - above) // w0, top) + m.own_slots)
        place = sym + m.own
        start, freq = above + w0 * m.cum.take(place), w0 * m.freq.take(place)
        now = sym + one
        event = ones.copy()
        if (h := np.flatnonzero(hit)).size:
            by2 = w2[h]
            two = (q[h] >> m.bits) < by2
            now[h] = np.where(two, p2[h], p1[h])
            start[h] = np.where(two, 0, by2) << m.bits
            freq[h] = np.where(two, by2, w1[h]) << m.bits
            event[h] = np.where(two, _HIT2, _HIT1)
        m.counts[s] += event
        x -= r * start
        np.multiply(r, freq, out=span)
        short = np.flatnonzero(span < _LEAST)
        k = at[short]
        x[short] = x[short] << _32 | words.take(k, mode="clip")
        at[short] = k + 1
        span[short] <<= _32
        t1[i1] = now
        t2[i2] = now
        run = next_run.take(run) * hit
        got[t] = now
        before, last = last, got[t]
    got -= np.uint32(1)
    return got


def encode_record(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One record of whole documents, whose ids stand one after another in `ids`."""
    n = len(ids)
    block = int(min(BLOCK_IDS, max(64, n // 512)))
    held = np.bincount(ids)
    symbols = np.flatnonzero(held)
    if len(symbols) > 1 << 19:
        raise ValueError("too many different ids for one record")
    of = np.zeros(len(held), np.int32)
    of[symbols] = np.arange(len(symbols))
    n_blocks = -(-n // block)
    rows = np.zeros(n_blocks * block, np.int32)
    rows[:n] = of.take(ids)
    rows = turned(rows.reshape(n_blocks, block))
    kind = np.concatenate([block_kinds(rows[:, lo : lo + LANES], held[symbols]) for lo in range(0, n_blocks, LANES)])
    sums = np.zeros(KINDS * len(symbols), np.int64)
    for lo in range(0, block, 64):
        sums += np.bincount((rows[lo : lo + 64] + kind * len(symbols)).reshape(-1), minlength=len(sums))
    levels = levels_of(sums.reshape(KINDS, -1))
    streams: list[bytes] = []
    for lo in range(0, n_blocks, LANES):
        streams += encode_blocks(rows[:, lo : lo + LANES], Orders(levels, kind[lo : lo + LANES]))
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    crcs = [zlib.crc32(raw[4 * lo : 4 * (lo + block)]) for lo in range(0, n, block)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids64 = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [
        np.packbits(known).tobytes(),
        np.diff(ids64, prepend=np.int64(0)).tobytes(),
        counts.astype("<u4").tobytes(),
        np.diff(symbols.astype("<i8"), prepend=0).astype("<u4").tobytes(),
        levels.tobytes(),
        kind.astype(np.uint8).tobytes(),
        np.array(list(map(len, streams)), "<u4").tobytes(),
        np.array(crcs, "<u4").tobytes(),
    ]
    body = b"".join(struct.pack("<I", len(z := zlib.compress(p, 6))) + z for p in parts)
    return _HEAD.pack(MAGIC, len(doc_ids), n, block, len(symbols), zlib.crc32(body)) + body + b"".join(streams)


def decode_record(record: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a record; every checksum is held against the data."""
    magic, n_docs, n, block, n_symbols, crc = _HEAD.unpack_from(record)
    if magic != MAGIC:
        raise ValueError("not a token-id record")
    at, parts = _HEAD.size, []
    for _ in range(8):
        (size,) = struct.unpack_from("<I", record, at)
        parts.append(record[at + 4 : at + 4 + size])
        at += 4 + size
    if zlib.crc32(record[_HEAD.size : at]) != crc:
        raise ValueError("header checksum differs")
    parts = [zlib.decompress(p) for p in parts]
    known = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n_docs)
    doc_ids = [d if k else None for d, k in zip(np.cumsum(np.frombuffer(parts[1], "<i8")).tolist(), known.tolist())]
    counts = np.frombuffer(parts[2], "<u4").astype(np.int64)
    symbols = np.cumsum(np.frombuffer(parts[3], "<u4").astype(np.int64)).astype(np.uint32)
    levels, kind = np.frombuffer(parts[4], np.uint8).reshape(KINDS, n_symbols), np.frombuffer(parts[5], np.uint8)
    sizes, crcs = (np.frombuffer(p, "<u4").astype(np.int64) for p in parts[6:])
    ends = at + np.cumsum(sizes)
    streams = [record[b - s : b] for b, s in zip(ends.tolist(), sizes.tolist())]
    ids = np.concatenate([symbols.take(turned(decode_blocks(streams[lo : lo + LANES], block, Orders(levels, kind[lo : lo + LANES])))).reshape(-1) for lo in range(0, len(kind), LANES)])[:n]
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    for k, lo in enumerate(range(0, n, block)):
        if zlib.crc32(raw[4 * lo : 4 * min(lo + block, n)]) != crcs[k]:
            raise ValueError(f"checksum of block {k} differs")
    return doc_ids, counts, ids


def write_tokens(docs: DataFrame, path: str, *, end_id: int = 2, tokenizer: str | None = None, record_ids: int = RECORD_IDS) -> None:
    """Write the ids of all documents, each with its end id, as records in ascending doc_id order."""
    vocabulary = tokenizer or default_tokenizer()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        docs_: list[int | None] = []
        held: list[np.ndarray] = []
        total = seq = 0

        def flush() -> pa.RecordBatch:
            counts = np.array(list(map(len, held)), np.int64)
            record = encode_record(docs_, counts, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([record], pa.binary())], ["part", "seq", "n_ids", "record"])

        for b in batches:
            part, doc_ids = b.column("part")[0].as_py() if b.num_rows else 0, b.column("doc_id").to_pylist()
            for lo, ids, at in enc.encode_column(b.column("text"), end_id):
                for k, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist()), lo):
                    docs_.append(doc_ids[k])
                    held.append(ids[x:y])
                    total += y - x
                    if total >= record_ids:
                        yield flush()
                        docs_, held, total, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = thin.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(tidy(of), "part int, seq int, n_ids long, record binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, decoded from the records in `path`."""
    names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, record in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("record")):
                doc_ids, counts, ids = decode_record(record.as_py())
                at = np.cumsum(counts) - counts
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + c)]) for a, c in zip(at.tolist(), counts.tolist())]
                n = len(doc_ids)
                cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(at), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    types = {"part": "int", "seq": "int", "ids": "array<int>"}
    records = spark.read.parquet(path)
    decoded = records.select("part", "seq", "record").mapInArrow(tidy(of), ", ".join(f"{n} {types.get(n, 'long')}" for n in names))
    sizes = records.select("part", "seq", "n_ids")
    # Ids before a record: those of earlier parts (a row for each part), and of earlier records of its part.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inner = Window.partitionBy("part").orderBy("seq")
    places = sizes.withColumn("before", F.sum("n_ids").over(inner) - F.col("n_ids")).drop("n_ids").join(parts, "part")
    out = decoded.join(places, ["part", "seq"]).withColumn("start", F.col("before_part") + F.col("before") + F.col("at"))
    return out.select("doc_id", "start", *names[4:])


def roundtrip(docs: DataFrame, *, path: str | None = None, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write `docs` as token-id files and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, end_id=end_id, tokenizer=tokenizer)
    return read_tokens(spark, path)
