"""A binary arithmetic coder with 15-bit probabilities, and byte codecs on it with round-trip checks."""

from __future__ import annotations

import struct
import zlib
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalyte.functions.byteview import map_bytes
from stratalyte.plans.registry import query, table

UNIT = 1 << 15
_TOP, _BOTTOM = 1 << 32, 1 << 24


class BitEncoder:
    """Range coder: the chance of a zero is prob0 / 32768; a carry runs back through the bytes written."""

    def __init__(self) -> None:
        self.low, self.range, self.out = 0, _TOP - 1, bytearray()

    def put(self, prob0: int, bit: int) -> None:
        zero = self.range * prob0 >> 15
        if bit:
            self.low += zero
            self.range -= zero
        else:
            self.range = zero
        if self.low >= _TOP:
            self.low -= _TOP
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        while self.range < _BOTTOM:
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & _TOP - 1
            self.range <<= 8

    def flush(self) -> bytes:
        """The fewest bytes that still decode: zeros at the end are understood."""
        value = self.low + self.range - 1
        for keep in range(1, 5):
            cut = value >> 8 * (4 - keep) << 8 * (4 - keep)
            if cut >= self.low:
                break
        if cut >= _TOP:
            cut -= _TOP
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        return bytes(self.out + cut.to_bytes(4, "big")).rstrip(b"\0")


class BitDecoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range = data, 4, _TOP - 1
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def get(self, prob0: int) -> int:
        zero = self.range * prob0 >> 15
        bit = self.code >= zero
        if bit:
            self.code -= zero
            self.range -= zero
        else:
            self.range = zero
        while self.range < _BOTTOM:
            self.code = self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.range <<= 8
        return int(bit)


class Model(Protocol):
    """Counts of the next symbol, and learning from it; any predictor may stand behind the codec."""

    def counts(self) -> list[int]: ...
    def update(self, symbol: int) -> None: ...


class OrderK:
    """Adaptive counts of bytes after the last k bytes."""

    def __init__(self, k: int = 1):
        self.k, self.context, self.table = k, (), {}

    def counts(self) -> list[int]:
        return self.table.setdefault(self.context, [1] * 256)

    def update(self, symbol: int) -> None:
        self.counts()[symbol] += 32
        self.context = (*self.context, symbol)[-self.k :] if self.k else ()


def _split(counts: list[int], lo: int, hi: int) -> tuple[int, int]:
    mid = (lo + hi) // 2
    left, whole = sum(counts[lo:mid]), sum(counts[lo:hi])
    return mid, min(UNIT - 1, max(1, left * UNIT // whole))


def encode(data: bytes, model: Model) -> bytes:
    """Each byte by halving the range of symbols, a bit for each half."""
    e = BitEncoder()
    for s in data:
        c, lo, hi = model.counts(), 0, 256
        while hi - lo > 1:
            mid, p = _split(c, lo, hi)
            bit = s >= mid
            e.put(p, bit)
            lo, hi = (mid, hi) if bit else (lo, mid)
        model.update(s)
    return e.flush()


def decode(data: bytes, n: int, model: Model) -> bytes:
    d, out = BitDecoder(data), bytearray()
    for _ in range(n):
        c, lo, hi = model.counts(), 0, 256
        while hi - lo > 1:
            mid, p = _split(c, lo, hi)
            lo, hi = (mid, hi) if d.get(p) else (lo, mid)
        out.append(lo)
        model.update(lo)
    return bytes(out)


#: Magic and version of a coded stream.
MAGIC, VERSION = b"SBYT", 1
_HEADER = struct.Struct(">4sBBII")


def pack_stream(data: bytes, order: int = 1) -> bytes:
    """Header (magic, version, model order, length, crc32) and the coded bytes."""
    return _HEADER.pack(MAGIC, VERSION, order, len(data), zlib.crc32(data)) + encode(data, OrderK(order))


def unpack_stream(stream: bytes) -> bytes:
    magic, version, order, n, crc = _HEADER.unpack_from(stream)
    if magic != MAGIC or version > VERSION:
        raise ValueError("not a stream of this format")
    data = decode(stream[_HEADER.size :], n, OrderK(order))
    if zlib.crc32(data) != crc:
        raise ValueError("checksum differs")
    return data


@query("codec_roundtrip", "select item_id, octet_length(encode(text))::bigint as size, true as ok from benchmark")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Lossless coding of whole texts, an adaptive order-one model each: sequential, so one text is one unit of work."""
    return map_bytes(table(spark, d, "benchmark"), "item_id", "text", lambda b: (len(b), unpack_stream(pack_stream(b.tobytes())) == b.tobytes()), {"size": "long", "ok": "boolean"})


@query("deflate_roundtrip", "select doc_id, octet_length(encode(text))::bigint as size, true as ok from documents")
def deflate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary blob's codec, on every text, with raw and compressed sizes checked."""

    def of(b: np.ndarray) -> tuple[int, bool]:
        raw = b.tobytes()
        blob = struct.pack(">II", len(raw), len(z := zlib.compress(raw))) + z
        n, k = struct.unpack_from(">II", blob)
        return len(raw), zlib.decompress(blob[8 : 8 + k]) == raw and n == len(raw)

    return map_bytes(table(spark, d, "documents"), "doc_id", "text", of, {"size": "long", "ok": "boolean"})


@query("symbol_blocks", "select doc_id, b::int as block, least(1000, n - b * 1000)::int as length from (select doc_id, octet_length(encode(text)) as n, unnest(range(0, (octet_length(encode(text)) + 999) // 1000)) as b from documents) q")
def symbol_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a thousand symbols of each text's bytes, read as slices of binary."""
    x = F.col("text").cast("binary")
    t = table(spark, d, "documents").where("length(text) > 0").select("doc_id", x.alias("x"), F.explode(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 1000).cast("int"))).alias("block"))
    return t.select("doc_id", "block", F.length(F.substring("x", F.col("block") * 1000 + 1, F.lit(1000))).alias("length"))
