"""Benchmark decontamination by template canonicalisation.

A text becomes template tokens: words without the marks around them, A-Z and other letters lower-cased; numbers
become <num>, units after a number <unit>, and capitalised words inside a sentence <name>. A text has up to three
readings: a capitalised word that begins a sentence as a plain word, or as <name>, and all names as plain words (so
that a copy in other case is found). Windows of five tokens, by any reading, are hash-joined with those of the
benchmark items. An item is found in a document where at least 0.8 of the item's windows match near one alignment
with slots that are consistent: each slot value of the item stands for one value of its type throughout, and no two
for the same, so a question with other numbers or names is found, and one that mixes them is not.

The join looks for an item by its rarest windows only, as many as could all be missing and one more: whichever 0.8
match, one of these is among them. Windows that many items share so bring no candidates, and lose none.

Defined results: null and empty texts match nothing; items of fewer than five template tokens, or with no window
of two or more plain words, are not searched for; an item whose text another repeats is found like the other;
repeated rows have repeated results; the longest texts are matched whole; a null doc_id is carried as null; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, ragged, tidy

WIDTH = 5
SHARE = 0.8
#: Alignments up to this many tokens apart count as one.
DRIFT = 16
#: Windows of the benchmark held by one task; larger benchmarks are matched in blocks of items.
BLOCK_WINDOWS = 2_000_000
#: Bytes of texts that are read at once.
GROUP_BYTES = 1_000_000
#: Tokens of a text that are aligned at once.
STRIP = 100_000
#: Units of measure, currency and time.
UNITS = frozenset("kg g mg lb lbs oz t km m cm mm mi mile miles ft foot feet in inch inches yd l ml gram grams gramme grammes kilogram kilograms milligram milligrams pound pounds ounce ounces ton tons tonne tonnes meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters millimetre millimetres yard yards liter liters litre litres milliliter milliliters millilitre millilitres gallon gallons pint pints quart quarts s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent $ € £ dollar dollars euro euros cent cents mph kmh".split())
#: Numbers as words.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_MARKS = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?$")
_GLUED = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|%)$")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
LITERAL, NAME, NUM, UNIT = 0, 1, 2, 3


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


_KIND_HASH = np.array([0, _h("<name>"), _h("<num>"), _h("<unit>")], np.uint64)


class Canon:
    """Words to template tokens; what a word is by itself is kept in a table of bounded size."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1 << 16, 4), np.int64)  # of each word: hash, kind, tokens, ends a sentence
        self.n = 1
        self.units: dict[int, int] = {}

    def _add(self, word: str) -> int:
        core = word if word.isalpha() else word[:-1] if word[-1] in ",." and word[:-1].isalpha() else _MARKS.sub("", word)
        ends = int(word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?"))
        low = core.lower()
        alpha = core.isalpha()
        glued = None if alpha else _GLUED.match(core)
        if not core:
            row = (0, LITERAL, 0, ends)
        elif not alpha and _NUMBER.match(core) or low in NUMBER_WORDS:
            row = (_h(low), NUM, 1, ends)
        elif glued and glued[2].lower() in UNITS:
            row = (_h(glued[1]), NUM, 2, ends)
            self.units[self.n] = _h(glued[2].lower())
        elif low in UNITS:
            row = (_h(low), UNIT, 1, ends)
        elif core[0].isupper():
            row = (_h(low), NAME, 1, ends)
        else:
            row = (_h(low), LITERAL, 1, ends)
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = (row[0] - (1 << 64) if row[0] >> 63 else row[0], *row[1:])
        self.ids[word] = self.n
        self.n += 1
        return self.n - 1

    def _rows(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        for i in np.flatnonzero(ids == 0).tolist():
            ids[i] = self._add(words[i])
        return ids

    def read(self, texts: pa.Array) -> Reading:
        if len(self.ids) > self.most:
            self.clear()
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        empty = np.array([not w for w in words], bool)
        rows = np.zeros(len(words), np.int64)  # row 0, of no tokens, for the nothing that the split leaves at the ends
        rows[~empty] = self._rows([w for w in words if w])
        ids = rows[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        value, kind, n, ends = (np.ascontiguousarray(self.table[:, k])[ids] for k in range(4))
        real = ids > 0
        if not real.all():
            doc, ids, value, kind, n, ends = (x[real] for x in (doc, ids, value, kind, n, ends))
        begins = np.ones(len(ids), bool)
        begins[1:] = (ends[:-1] == 1) | (doc[1:] != doc[:-1])
        first = (kind == NAME) & begins
        value = value.view(np.uint64)
        if (n != 1).any():
            place = ragged(n)
            source = np.repeat(ids, n)
            doc, kind, value, first = (np.repeat(x, n) for x in (doc, kind, value, first))
            second = np.flatnonzero(place == 1)
            kind[second] = UNIT
            value[second] = np.array([self.units[i] for i in source[second].tolist()], np.uint64)
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUM) & (doc[1:] == doc[:-1])
        kind = np.where((kind == UNIT) & ~after, LITERAL, kind).astype(np.int8)
        return Reading(value, kind, first, doc)


class Reading:
    """The tokens of some texts, one text after another, in three readings."""

    def __init__(self, value: np.ndarray, kind: np.ndarray, first: np.ndarray, doc: np.ndarray):
        self.value, self.doc = value, doc
        self.kinds = [np.where(first, LITERAL, kind).astype(np.int8), kind, np.where(kind == NAME, LITERAL, kind).astype(np.int8)]
        self.same = len(doc) - WIDTH + 1
        n = max(self.same, 0)
        self.whole = doc[:n] == doc[WIDTH - 1 :] if n else np.zeros(0, bool)
        # Where a reading differs from the first: windows with a name at the beginning of a sentence, and with any name.
        marks = [None, first, kind == NAME]
        self.differs = [self.whole, *(self.whole & self._any(m, n) for m in marks[1:])]

    @staticmethod
    def _any(mark: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        for j in range(WIDTH):
            out |= mark[j : j + n]
        return out

    def windows(self, reading: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of a reading that the first reading has not."""
        kind, n = self.kinds[reading], max(self.same, 0)
        x = np.where(kind == LITERAL, self.value, _KIND_HASH[kind])
        x = x ^ x >> np.uint64(29)
        out = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            out += x[j : j + n] * _MULT[j]
        at = np.flatnonzero(self.differs[reading])
        out = out[at]
        return at, out ^ (out >> np.uint64(32))

    def plain(self) -> np.ndarray:
        """Plain words of each window in the first reading."""
        n = max(self.same, 0)
        return sum((self.kinds[0][j : j + n] == LITERAL).astype(np.int8) for j in range(WIDTH)) if n else np.zeros(0, np.int8)


class Index:
    """The windows of benchmark items: all of them, item by item, and those by which an item is looked for, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        r = Canon().read(pa.array([t for _, t in items], pa.string()))
        ok = r.whole & (r.plain() >= 2)
        item, place, reading, hashes = [], [], [], []
        for k in range(3):
            at, h = r.windows(k)
            mine = ok[at]
            at, h = at[mine], h[mine]
            item.append(r.doc[at])
            place.append(at)
            reading.append(np.full(len(at), k, np.int8))
            hashes.append(h)
        item, place, reading, hashes = (np.concatenate(x) for x in (item, place, reading, hashes))
        order = np.argsort(item, kind="stable")
        self.item, self.place, self.reading, self.hash = item[order], place[order], reading[order], hashes[order]
        self.starts = np.searchsorted(self.item, np.arange(len(items) + 1))
        self.total = np.bincount(r.doc[: len(ok)][ok], minlength=len(items)) if len(ok) else np.zeros(len(items), np.int64)
        self.ids, self.value, self.kinds = [i for i, _ in items], r.value, r.kinds
        # How many items have a window of this hash; a place goes by the commonest of its readings.
        distinct, inverse = np.unique(self.hash, return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * (len(items) + 1) + self.item)
        shared = np.bincount(pairs // (len(items) + 1), minlength=len(distinct))[inverse]
        looked = np.zeros(len(self.hash), bool)
        for k in np.flatnonzero(self.total).tolist():
            at = np.arange(self.starts[k], self.starts[k + 1])
            places, inv = np.unique(self.place[at], return_inverse=True)
            most = np.zeros(len(places), np.int64)
            np.maximum.at(most, inv, shared[at])
            spare = int(self.total[k]) - self.least(k)
            rank = np.empty(len(places), np.int64)
            rank[np.argsort(most, kind="stable")] = np.arange(len(places))
            looked[at] = rank[inv] <= spare
        keyed = np.flatnonzero(looked)
        keyed = keyed[np.argsort(self.hash[keyed], kind="stable")]
        self.key, self.key_item = self.hash[keyed], self.item[keyed]
        self.near = np.zeros(1 << 20, bool)
        self.near[self.key >> np.uint64(44)] = True

    def least(self, k: int) -> int:
        """Windows of item k that must match."""
        return int(np.ceil(SHARE * self.total[k] - 1e-9))

    def search(self, r: Reading) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, matched windows, windows, slots with another value) for each item found in a text."""
        found = [r.windows(k) for k in range(3)]
        pairs = []
        for at, h in found:
            some = np.flatnonzero(self.near[h >> np.uint64(44)])
            at, h = at[some], h[some]
            lo, hi = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
            n = hi - lo
            pairs.append(np.unique(np.repeat(r.doc[at], n) * len(self.ids) + self.key_item[np.repeat(lo, n) + ragged(n)]))
        pairs = np.unique(np.concatenate(pairs))
        if not len(pairs):
            return []
        # Windows of the texts that have a candidate, of all readings.
        has = np.zeros(int(r.doc[-1]) + 1, bool)
        has[pairs // len(self.ids)] = True
        mine = [np.flatnonzero(has[r.doc[at]]) for at, _ in found]
        spot = np.concatenate([at[m] for (at, _), m in zip(found, mine)])
        h = np.concatenate([x[m] for (_, x), m in zip(found, mine)])
        order = np.lexsort((h, r.doc[spot]))
        spot, h = spot[order], h[order]
        ends = np.searchsorted(r.doc[spot], np.arange(len(has) + 1))
        out = []
        for pair in pairs.tolist():
            text, k = divmod(pair, len(self.ids))
            a, b = int(ends[text]), int(ends[text + 1])
            x, y = int(self.starts[k]), int(self.starts[k + 1])
            best = (0, 0)
            # A text with very many places of the item's windows is taken in strips that overlap by any alignment's length.
            reach = int(np.ptp(self.place[x:y])) + 2 * DRIFT + WIDTH
            strip = max(STRIP, 4 * reach)
            low, high = int(spot[a:b].min()), int(spot[a:b].max())
            for begin in range(low, high + 1, strip - reach) if high - low >= strip else [low]:
                if high - low < strip:
                    s, hs = spot[a:b], h[a:b]
                else:
                    mine = (spot[a:b] >= begin) & (spot[a:b] < begin + strip)
                    s, hs = spot[a:b][mine], h[a:b][mine]
                lo = np.searchsorted(hs, self.hash[x:y], "left")
                n = np.searchsorted(hs, self.hash[x:y], "right") - lo
                entry = np.repeat(np.arange(x, y), n)
                best = max(best, self._best(k, s[np.repeat(lo, n) + ragged(n)], self.place[entry], self.reading[entry], r.value))
            if best[0]:
                out.append((text, self.ids[k], best[0], int(self.total[k]), best[1]))
        return out

    def _best(self, k: int, p: np.ndarray, q: np.ndarray, reading: np.ndarray, value: np.ndarray) -> tuple[int, int]:
        """The alignment with most matches that agree, if they are enough."""
        least, best = self.least(k), (0, 0)
        if len(np.unique(q)) < least:
            return 0, 0
        band = (p - q) // DRIFT
        order = np.argsort(band, kind="stable")
        band, p, q, reading = band[order], p[order], q[order], reading[order]
        bands = np.unique(band)
        lo, hi = np.searchsorted(band, bands, "left"), np.searchsorted(band, bands + 1, "right")
        for x, y in zip(lo.tolist(), hi.tolist()):
            if y - x >= max(least, best[0] + 1) and len(np.unique(q[x:y])) >= max(least, best[0] + 1):
                best = max(best, self._consistent(p[x:y], q[x:y], reading[x:y], value))
        return best if best[0] >= least else (0, 0)

    def _consistent(self, p: np.ndarray, q: np.ndarray, reading: np.ndarray, value: np.ndarray) -> tuple[int, int]:
        """Windows with slots that agree with those of the windows before, and slots whose value is another."""
        to: dict = {}
        back: dict = {}
        seen, changed = set(), set()
        for x in np.lexsort((reading, p, q)).tolist():
            a, b, kinds = int(p[x]), int(q[x]), self.kinds[reading[x]]
            if b in seen:
                continue
            pairs = [(int(kinds[b + j]), int(self.value[b + j]), int(value[a + j])) for j in range(WIDTH) if kinds[b + j] != LITERAL]
            if all(to.get((t, u), v) == v and back.get((t, v), u) == u for t, u, v in pairs):
                seen.add(b)
                for t, u, v in pairs:
                    to[t, u], back[t, v] = v, u
                    if u != v:
                        changed.add((t, u))
        return len(seen), len(changed)


def _matcher(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            texts = b.column("text").cast(pa.string())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(texts) and len(index.key):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + GROUP_BYTES, "right")))
                rows = index.search(canon.read(texts.slice(lo, hi - lo)))
                if rows:
                    text, *cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([lo + t for t in text], pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "item_id", "matched", "windows", "changed"])
                lo = hi

    return match


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, windows, changed: one row for each document and item found in it."""
    schema = "doc_id long, item_id long, matched int, windows int, changed int"
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2
    blocks = -(-size // BLOCK_WINDOWS) or 1
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(blocks):
        # One block at a time is held whole: BLOCK_WINDOWS bounds it, and an item is in one block only.
        index = Index([(r["item_id"], r["text"]) for r in bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()])
        part = thin.mapInArrow(tidy(_matcher(index)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows in which an item is found; rows with a null doc_id stay. The ids of those are written first: while texts are searched, none are sorted or shuffled."""
    gone = fresh(docs, "_leaked_id")
    leaks = materialise(find_leaks(docs, benchmark).select("doc_id").distinct().toDF(gone), "leaks", small=True)
    return docs.join(leaks, F.col("doc_id") == F.col(gone), "left_anti")
