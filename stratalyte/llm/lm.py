"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of each order are mixed with the next lower order; the weight of an order depends on
how often its context occurs (buckets by powers of two) and comes from expectation-maximisation on a held-out fold
of the training documents, with counts that leave the fold out:

    P_k(w | h) = m_k(c(h)) * c(h, w) / c(h) + (1 - m_k(c(h))) * P_k-1(w | shorter h)        P_0 = 1 / (V + 1)

Documents are gathered into segments of some million tokens. Of each order, a segment asks for the corpus counts
of its own distinct n-grams: their 64-bit keys, sorted and packed, go to ranges of keys (a number that grows with
the corpus), where they are summed, and the sums go back. Every n-gram of the corpus is counted; a segment asks for
each once, however often it occurs, so neither a frequent word nor a frequent pair weighs more than a rare one.

Defined results: a null or empty text is its end token alone; with no training document every score is that of
the uniform estimate; repeated rows have repeated results; a null doc_id is training text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fold, materialise, release, tidy

FOLDS, TEST_FOLD, TUNE_FOLD = 7, 2, 6
MAIN, TUNE, TEST = 0, 1, 2
SEGMENT_TOKENS, RANGE_KEYS = 1 << 20, 1 << 21
BUCKETS = 64
_SEED = 42
_EDGE, _START = np.uint64(1), np.uint64(2)  # the end of a text; what stands before its first token
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RETURN = "seg long, bucket int, main binary, whole binary, kinds long, tokens long, at array<int>, odds array<int>, n array<long>"


def pack(a: np.ndarray) -> bytes:
    """An unsigned array as byte planes, compressed."""
    return pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def key_bits(order: int) -> int:
    """Bits of the keys: of pairs and triples, one in 2^30 or so would share its key with another of a range."""
    return 64 if order == 1 else 56


def bucket_of(c: np.ndarray) -> np.ndarray:
    """Floor of log2(c + 1)."""
    return np.frexp(c.astype(np.float64) + 1)[1] - 1


def segments(docs: DataFrame) -> DataFrame:
    """seg, doc_id, part, n (arrays, a document each), size, keys of the words, places in them of all tokens."""
    names = ["seg", "doc_id", "part", "n", "size", "kinds", "keys", "tokens"]

    def segment(seg: int, ids: list[pa.Array], parts: list[np.ndarray], n: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
        places = coded.indices.to_numpy()
        held = np.bincount(places, minlength=len(coded.dictionary))
        order = np.argsort(-held, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        names_ = coded.dictionary.to_pylist()
        keys = np.array([_EDGE, *(xxhash.xxh64_intdigest(names_[i], _SEED) for i in order.tolist())], np.uint64)
        counts = np.concatenate(n)
        tokens = np.zeros(int(counts.sum()), np.uint32)  # the end, place 0, stands after each document
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(counts) - 1] = False
        tokens[inner] = rank[places]
        doc_id = pa.concat_arrays(ids)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        cols = [pa.array([seg], pa.int64()), one(doc_id, pa.int64()), one(np.concatenate(parts).astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32())]
        cols += [pa.array([len(tokens)], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([pack(keys)], pa.binary()), pa.array([pack(tokens)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        total, seg = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            seg = b.column("at")[0].as_py() << 32 if seg is None else seg
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                split = pc.ascii_split_whitespace(part.column("text"))
                words = split.flatten()
                if (empty := pc.equal(words, "")).true_count:
                    keep = pc.invert(empty)
                    ends = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
                    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
                    n, words = np.diff(ends[offsets]), words.filter(keep)
                else:
                    n = np.diff(split.offsets.to_numpy())
                for x, y in zip(held, (part.column("doc_id"), part.column("part").to_numpy(), n.astype(np.int64) + 1, words.cast(pa.large_string()))):
                    x.append(y)
                total += len(words)
                if total >= SEGMENT_TOKENS:
                    yield segment(seg, *held)
                    held, total, seg = ([], [], [], []), 0, seg + 1
        if held[0]:
            yield segment(seg, *held)

    part = F.when(fold("doc_id", FOLDS) == TEST_FOLD, TEST).when(fold("doc_id", FOLDS) == TUNE_FOLD, TUNE).otherwise(MAIN)
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"), part.cast("int").alias("part"), F.spark_partition_id().cast("long").alias("at"))
    return rows.mapInArrow(tidy(of), "seg long, doc_id array<long>, part array<int>, n array<int>, size long, kinds long, keys binary, tokens binary")


class Segment:
    """The tokens of a segment, and of each order its distinct n-grams with what has come back for them."""

    def __init__(self, row: dict):
        self.seg, self.doc_id = row["seg"], row["doc_id"]
        self.n = np.array(row["n"], np.int64)
        self.keys = unpack(row["keys"], np.uint64, row["kinds"])
        self.tokens = unpack(row["tokens"], np.uint32, row["size"])
        self.part = np.repeat(np.array(row["part"], np.int8), self.n)
        self.doc_part = np.array(row["part"], np.int8)
        self.first = np.cumsum(self.n) - self.n
        self.counts: dict[int, np.ndarray] = {}

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the order's distinct n-grams, ascending, and the place of each token's n-gram in them."""
        if order == 1:
            keys, place = np.unique(self.keys, return_inverse=True)
            return keys, place[self.tokens]
        word = self.keys[self.tokens]
        key = word
        for _ in range(order - 1):
            key = self._before(key, _START) * _M1 + word
            key = (key ^ key >> np.uint64(29)) * _M2
            key ^= key >> np.uint64(32)
        return np.unique(key >> np.uint64(64 - key_bits(order)), return_inverse=True)

    def _before(self, x: np.ndarray, start) -> np.ndarray:
        """What stands one token before, and `start` at the beginning of each text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def take(self, order: int, rows: list[dict], name: str) -> None:
        """Counts of each token's n-gram in the corpus, from the sums that came back: `main` without the tuning fold, or `whole`."""
        keys, place = self.grams(order)
        parts = [unpack(r[name], np.uint32, r["kinds"]) for r in sorted(rows, key=lambda r: r["bucket"])]
        self.counts[order] = (np.concatenate(parts) if parts else np.zeros(len(keys), np.uint32))[place]

    def probabilities(self, upto: int, docs: int, tokens: int, kinds: int, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """P of each token by the orders up to `upto`, and how often the context of the next order occurs, by these counts."""
        p = np.full(len(self.tokens), 1 / (kinds + 1))
        context = np.full(len(p), float(tokens))
        for k in range(1, upto + 1):
            m = np.where(context > 0, weights[k - 1][0 if k == 1 else bucket_of(context)], 0.0)
            p = m * self.counts[k] / np.maximum(context, 1) + (1 - m) * p
            context = self._before(self.counts[k].astype(np.float64), docs)
        return p, context


def asked(seg: Segment, order: int, ranges: int, model: Model, returns: dict[int, list[dict]]) -> Iterator[tuple]:
    """bucket, seg, keys, counts without and in the tuning fold; of those in the fold also the context's bucket, and the odds of one occurrence against the lower orders (64 steps to a power of two)."""
    keys, place = seg.grams(order)
    main, tune = (np.bincount(place[seg.part == x], minlength=len(keys)).astype(np.uint32) for x in (MAIN, TUNE))
    at = np.flatnonzero(tune)
    level, unit = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint16)
    if order > 1:
        for k in range(1, order):
            seg.take(k, returns.get(k, []), "main")
        p, context = seg.probabilities(order - 1, model.docs_main, model.tokens_main, model.kinds, model.weights)
        level[place] = bucket_of(context)
        unit[place] = np.where(context > 0, np.round(64 * (np.log2(1 / (np.maximum(context, 1) * p)) + 500)), 0)
    ends = np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) << np.uint64(key_bits(order) - ranges.bit_length() + 1)) if ranges > 1 else []
    ends = [0, *np.asarray(ends, np.int64).tolist(), len(keys)]
    for b, (x, y) in enumerate(zip(ends, ends[1:])):
        if y > x:
            own = at[np.searchsorted(at, x) : np.searchsorted(at, y)]
            yield b, seg.seg, y - x, pack(keys[x:y]), pack(main[x:y]), pack(tune[x:y]), pack(level[own]), pack(unit[own])


_ASK = "bucket int, seg long, kinds long, keys binary, main binary, tune binary, level binary, unit binary"
_ASK_TYPES = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _ASK.split(", ")])


def _by_order(sums: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in sums.to_pylist():
        out.setdefault(r["order"], []).append(r)
    return out


def _asker(order: int, ranges: int, model: Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = _ask_batches(x for r in left.to_pylist() for x in asked(Segment(r), order, ranges, model, _by_order(right)))
        out = pa.Table.from_batches(batches, _ASK_TYPES)
        release()
        return out

    return ask


def _ask_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, _ASK_TYPES.types)], schema=_ASK_TYPES)


def summed(table: pa.Table) -> pa.Table:
    """The sums of one range of keys, for each segment that asked; its first row also has the range's kinds and tokens, and its held-out events by the context's bucket and the odds in eighths of a power of two."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    keys = np.concatenate([unpack(r["keys"], np.uint64, r["kinds"]) for r in rows])
    main, tune = (np.concatenate([unpack(r[x], np.uint32, r["kinds"]) for r in rows]) for x in ("main", "tune"))
    distinct, place = np.unique(keys, return_inverse=True)
    sums = [np.bincount(place, x, len(distinct)).astype(np.int64) for x in (main, tune)]
    level, unit = np.zeros(len(distinct), np.uint8), np.zeros(len(distinct), np.uint16)
    here = np.flatnonzero(tune)
    ends = np.cumsum([0, *(r["kinds"] for r in rows)])
    held_in = np.diff(np.searchsorted(here, ends)).tolist()  # entries of each row that are in the fold
    level[place[here]] = np.concatenate([unpack(r["level"], np.uint8, n) for r, n in zip(rows, held_in)])
    unit[place[here]] = np.concatenate([unpack(r["unit"], np.uint16, n) for r, n in zip(rows, held_in)])
    held = np.flatnonzero(sums[1])
    with np.errstate(divide="ignore"):
        odds = np.log2(sums[0][held]) + np.where(unit[held] > 0, unit[held] / 64 - 500, 0.0)
    at = level[held].astype(np.int64) * 4096 + np.where(np.isfinite(odds), np.round(8 * np.maximum(odds, -200)) + 2000, 0).astype(np.int64)
    events, inverse = np.unique(at, return_inverse=True)
    n = np.bincount(inverse, sums[1][held], len(events)).astype(np.int64)
    whole = (sums[0] + sums[1])[place].astype(np.uint32)
    first = sums[0][place].astype(np.uint32)
    out, lo = [], 0
    for k, r in enumerate(rows):
        hi = lo + r["kinds"]
        stats = {"at": (events >> 12).tolist(), "odds": (events & 4095).tolist(), "n": n.tolist()} if k == 0 else {"at": [], "odds": [], "n": []}
        out.append({"seg": r["seg"], "bucket": r["bucket"], "main": pack(first[lo:hi]), "whole": pack(whole[lo:hi]), "kinds": r["kinds"], "tokens": int((sums[0] + sums[1] > 0).sum()) if k == 0 else 0, **stats})
        lo = hi
    del keys, main, tune, distinct, place, sums, level, unit, at, inverse, whole, first
    release()
    return pa.Table.from_pylist(out, pa.schema([("seg", pa.int64()), ("bucket", pa.int32()), ("main", pa.binary()), ("whole", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64()), ("at", pa.list_(pa.int32())), ("odds", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]))


class Model:
    """What every task knows: documents and tokens (without and with the tuning fold), kinds of tokens, and the weights of each order."""

    def __init__(self, docs_main: int, docs: int, tokens_main: int, tokens: int):
        self.docs_main, self.docs, self.tokens_main, self.tokens = docs_main, docs, tokens_main, tokens
        self.kinds = 0
        self.weights: list[np.ndarray] = []


def weight(odds: np.ndarray, n: np.ndarray, rounds: int = 100) -> float:
    """EM for the weight of an estimate whose odds against the other are given, for n held-out events each."""
    m = 0.5
    for _ in range(rounds):
        m = float((n * (m * odds / (m * odds + 1 - m))).sum() / n.sum())
        m = min(max(m, 1e-6), 1 - 1e-6)
    return m


def _weights(hist: list, scale: float) -> np.ndarray:
    """The weight for each bucket; one without events goes by the one below."""
    out = np.zeros(BUCKETS)
    by: dict[int, list] = {}
    for r in hist:
        by.setdefault(r["at"], []).append((0.0 if r["odds"] == 0 else scale * 2.0 ** ((r["odds"] - 2000) / 8), r["n"]))
    for b in range(BUCKETS):
        out[b] = weight(*np.array(by[b]).T) if b in by else out[b - 1] if b else 0.0
    return out


def fit(docs: DataFrame, order: int = 2) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the segments of `docs`, and the sums that came back for each (with a column `order`)."""
    segs = materialise(segments(docs), "segments")
    sizes = segs.select("size", "kinds", F.explode(F.arrays_zip("part", "n")).alias("d")).agg(
        *(F.coalesce(F.sum(F.when(F.col("d.part") == x, y)), F.lit(0)).alias(f"{name}{x}") for x in (MAIN, TUNE) for name, y in (("docs", F.lit(1)), ("tokens", F.col("d.n").cast("long"))))
    ).first()
    totals = segs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    model = Model(sizes["docs0"], sizes["docs0"] + sizes["docs1"], sizes["tokens0"], sizes["tokens0"] + sizes["tokens1"])
    returns = None
    for k in range(1, order + 1):
        entries = totals["kinds"] if k == 1 else totals["size"]
        ranges = 1 << max(0, (-(-entries // RANGE_KEYS) - 1).bit_length())
        if k == 1:
            asks = segs.mapInArrow(tidy(lambda batches, ranges=ranges, m=model: _ask_batches(x for b in batches for r in b.to_pylist() for x in asked(Segment(r), 1, ranges, m, {}))), _ASK)
        else:
            asks = segs.groupBy("seg").cogroup(returns.drop("whole").groupBy("seg")).applyInArrow(_asker(k, ranges, model), _ASK)
        own = materialise(asks.groupBy("bucket").applyInArrow(summed, _RETURN).withColumn("order", F.lit(k)), f"sums-{k}")
        hist = own.where(F.size("at") > 0).select(F.explode(F.arrays_zip("at", "odds", "n")).alias("e")).groupBy("e.at", "e.odds").agg(F.sum("e.n").alias("n")).orderBy("at", "odds").collect()
        if k == 1:
            model.kinds = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("v")).first()["v"]
        model.weights.append(_weights(hist, (model.kinds + 1) / max(1, model.tokens_main) if k == 1 else 1.0))
        own = own.select("seg", "bucket", "main", "whole", "kinds", "order")
        returns = own if returns is None else returns.unionByName(own)
    return model, segs, returns


def score(docs: DataFrame, *, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, segs, returns = fit(docs, order)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        back, tables = _by_order(right), []
        for row in left.to_pylist():
            s = Segment(row)
            for k in range(1, order + 1):
                s.take(k, back.get(k, []), "whole")
            p, _ = s.probabilities(order, model.docs, model.tokens, model.kinds, model.weights)
            base = np.log10((s.counts[1].astype(np.float64) + 1) / (model.tokens + model.kinds + 1))
            sums = [np.add.reduceat(x, s.first) for x in ((s.counts[1] > 0).astype(np.int64), base, np.log10(p))]
            ids = pa.array(s.doc_id, pa.int64())
            held = (s.doc_part == TEST) & ids.is_valid().to_numpy(zero_copy_only=False)
            tables.append(pa.table([ids, pa.array(held), pa.array(s.n), pa.array(sums[0]), pa.array(np.full(len(ids), model.tokens)), pa.array(sums[1]), pa.array(sums[2])], names=names))
        release()
        return pa.concat_tables(tables)

    kinds = ("long", "boolean", "long", "long", "long", "double", "double")
    return segs.groupBy("seg").cogroup(returns.drop("main").groupBy("seg")).applyInArrow(scored, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
