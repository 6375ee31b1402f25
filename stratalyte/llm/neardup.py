"""Near dedup by SimHash trees and, for what they do not see, Jaccard similarity of word shingles.

A text is the set of the XXH64 values of all its shingles of five words. Two texts are linked if the sets have a
similarity of 0.8 or more, and one text of each component of links stays. Equal sets are one node.

1. Fingerprints of the sets go through the BK-trees of `simhash`; what these join is compared, and linked if similar.
   Most copies are found so, at a comparison each. Four bits do not see every pair of 0.8, so the rest is exact:
2. Of a set of n, any other that is so similar shares one of the first n - ceil(0.8 n) + 1 values in any order that is
   the same for all sets, so texts that share none are not compared and no link is lost. In the order taken here,
   values below a fixed bound that few texts have come first, those that many have next, and values beyond it last:
   passages that many texts share are then seldom among the first values.
3. The sets that share a value are a crowd. All pairs of a crowd whose sets are not yet in one component are held against
   sketches (the parities of a set's values by their low bits, in about as many bits as it has values): they differ in at
   most as many bits as the sets in values, so no similar pair is lost, and few others pass. Of two sets whose value before
   the shared one is the same too, the pair is looked at there only. What passes is compared by whole sets, in rounds: each
   set brings its first pair of a crowd, then eight times as many a round, until no set has more to bring. Pairs inside a crowd are
   looked at in memory, a bounded number at once, and a large crowd is dealt to tasks in blocks; only what passes is a row.

Defined results: texts of fewer than five words are one shingle, and blank texts are equal; rows with a null doc_id
stay; of equal rows one stays; two texts under one doc_id are told apart; other columns are passed on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, ragged, slices, tidy, words
from .simhash import SEED, components, tree_edges

SIZE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Values below this share of all, told apart by how many texts have them.
REGION = int(0.35 * 2**64) - 2**63
#: A value is common if so many texts have it at least, and at most so many values can be.
COMMON, MOST_COMMON = 32, 1 << 20
#: Texts that are compared are looked up by a broadcast of at most so many ids, else by a join.
BROADCAST_ROWS = 500_000
#: A larger crowd is dealt in blocks of about so many sets, each pair of blocks to a task's group.
CROWD = 1 << 14
#: Pairs whose sketches are held against each other at once.
PAIRS = 1 << 18


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The values of all shingles of the whole text, each once and in order."""
    w = words(text)
    line = b" ".join(w)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64).view(np.int64)
    at = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], at + 1)).tolist()
    ends = np.append(at, len(line)).tolist()
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.array([h64(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64).view(np.int64))


def majority(s: np.ndarray) -> int:
    """The fingerprint of a set: the bits that over half its values have."""
    totals = np.zeros(64, np.int64)
    for lo in range(0, len(s), 1 << 16):
        totals += np.unpackbits(s[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(s), bitorder="little").view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """For each of 2^k >= len(s) (64 at least) values of the low bits, whether an odd number of the set's values have them. Half as many bits are the exclusive or of both halves."""
    m = max(64, 1 << (max(1, len(s)) - 1).bit_length())
    return np.packbits((np.bincount(s.view(np.uint64) & np.uint64(m - 1), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def enough(n: int) -> int:
    """The least number of values that a set of n shares with a similar one."""
    return (n * OVER + UNDER - 1) // UNDER


def _enough(n: Column) -> Column:
    return F.floor((n * OVER + UNDER - 1) / UNDER).cast("int")


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """d, t, node, n, fp, x, p: id, hash of the text, hash of the set, its size, fingerprint, sketch, and its least values: those of the region, and as many as the search may need."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t.as_py(), size) for t in b.column("text")]
            n = np.array([len(s) for s in sets], np.int32)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            least = [s[: max(len(s) - enough(len(s)) + 1, int(np.searchsorted(s, REGION)))] for s in sets]
            flat = np.concatenate(least) if least else np.zeros(0, np.int64)
            p = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in least])).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), pa.array(node), pa.array(n), pa.array([majority(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), p], ["d", "t", "node", "n", "fp", "x", "p"])

    return _ided(docs).mapInArrow(tidy(of), "d long, t long, node long, n int, fp long, x binary, p array<long>")


def _ided(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), "text")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are similar. The sets are made again from the texts of these nodes alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t.as_py(), size) for t in b.column("text")]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("node"), s], ["node", "s"])

    asked = materialise(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "d", "t"), "asked")
    texts = _ided(docs).join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, ["d", "t"]).select("node", "text")
    sets = materialise(texts.mapInArrow(tidy(of), "node long, s array<long>").dropDuplicates(["node"]), "sets", small=True)
    left, right = sets.toDF("a", "as"), sets.toDF("b", "bs")
    both = F.size(F.array_intersect("as", "bs"))
    found = materialise(pairs.select("a", "b").join(left, "a").join(right, "b").where(both * UNDER >= (F.size("as") + F.size("bs") - both) * OVER).select("a", "b"), "similar")
    discard(asked, sets)
    return found


def crowd_pairs(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of crowds that can be similar: of rows sorted by crowd (key, u, v) and by component in it, those of a set and one of an earlier component, `most` a set. If some set has more, a row of nulls too."""

    def passed(g: np.ndarray, x: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows a and b of pairs that pass, and which of its row's they are; g: crowd, key, u, v, blk, node, n, label, prev."""
        crowd, key, u, v, blk, node, n, label, prev = g
        size = np.diff(at)
        opens = np.append(True, (crowd[1:] != crowd[:-1]))
        first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        part = np.flatnonzero(opens | np.append(True, label[1:] != label[:-1]))
        before = part[np.searchsorted(part, np.arange(len(n)), "right") - 1] - first  # rows of earlier components
        ends = np.cumsum(before)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            b = np.repeat(np.arange(lo, hi), before[lo:hi])
            a = first[b] + ragged(before[lo:hi])
            ok = np.minimum(n[a], n[b]) * UNDER >= np.maximum(n[a], n[b]) * OVER
            ok &= (prev[a] != prev[b]) | (prev[b] == key[b])
            ok &= (blk[a] != blk[b]) | (u[b] == v[b])
            a, b = a[ok], b[ok]
            # Similar sets differ in at most a ninth of their sizes' sum.
            far, w, differ = (n[a] + n[b]) * (UNDER - OVER) // (UNDER + OVER), 0, np.zeros(len(a), np.int64)
            width = np.minimum(size[a], size[b])
            done = []
            while len(a):
                folded = lambda r: np.where(size[r] > width, x[at[r] + w] ^ x[at[r] + w + np.where(size[r] > width, width, 0)], x[at[r] + w])  # noqa: E731, B023
                differ = differ + np.bitwise_count(folded(a) ^ folded(b))
                w += 1
                near, whole = differ <= far, width == w
                done.append((a[near & whole], b[near & whole]))
                on = near & ~whole
                a, b, far, width, differ = a[on], b[on], far[on], width[on], differ[on]
            if done:
                a, b = (np.concatenate(z) for z in zip(*done))
                order = np.lexsort((a, b))
                a, b = a[order], b[order]
                yield a, b, np.arange(len(b)) - np.searchsorted(b, b)
            lo = hi

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            names = ("crowd", "key", "u", "v", "blk", "node", "n", "label", "prev")
            g = [rows.column(c).to_numpy().astype(np.int64) for c in names]
            sketches = rows.column("x").combine_chunks().cast(pa.large_binary())
            ends = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(sketches) + 1]
            x = np.frombuffer(sketches.buffers()[2], np.uint64, (ends[-1] - ends[0]) // 8, ends[0])
            more = False
            for a, b, rank in passed(g, x, (ends - ends[0]) // 8):
                more |= bool((rank >= most).any())
                a, b = g[5][a[rank < most]], g[5][b[rank < most]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            if more:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= 2 * CROWD:
                rows = pa.Table.from_batches(held)
                crowd = rows.column("crowd").to_numpy()
                cut = int(np.flatnonzero(crowd != crowd[-1])[-1]) + 1 if crowd[0] != crowd[-1] else 0  # the last crowd may go on
                held = rows.slice(cut).combine_chunks().to_batches()
                if cut:
                    yield from found(rows.slice(0, cut))
        if held:
            yield from found(pa.Table.from_batches(held))

    return of


def _first_values(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists, n = b.column("p"), b.column("n").to_numpy()
            p, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()  # of a slice: values of the whole, offsets of the slice
            p, offsets = p[offsets[0] : offsets[-1]], offsets - offsets[0]
            row = np.repeat(np.arange(len(n)), np.diff(offsets))
            beyond = p >= REGION
            at = np.minimum(np.searchsorted(common, p), max(len(common) - 1, 0))
            shared = (common[at] == p if len(common) else np.zeros(len(p), bool)) & ~beyond
            order = np.lexsort((p, beyond, shared | beyond, row))
            rank = np.arange(len(p)) - np.repeat(offsets[:-1], np.diff(offsets))
            need = n - (n.astype(np.int64) * OVER + UNDER - 1) // UNDER + 1
            keep = rank < need[row]  # rows stand in order after the sort as before
            keyed = order[keep]
            before = np.where(rank > 0, np.append(0, p[order][:-1]), p[order])[keep]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(row[keep])), pa.array(n[row[keep]]), pa.array(p[keyed]), pa.array(before)], ["node", "n", "key", "prev"])

    return of


def similar_groups(rows: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """node, label of all nodes with links; rows: sketches(docs), written once, and deleted here."""
    nodes = materialise(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("x").alias("x"), F.first("p").alias("p"), F.min(F.struct("d", "t")).alias("f")).select("node", "n", "fp", "x", "p", "f.*"), "nodes")
    discard(rows)

    # What the trees join.
    kinds = materialise(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "kinds")
    tied = tree_edges(kinds).unionByName(nodes.join(kinds, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    tied = materialise(tied.distinct(), "tied")
    links = [similar(tied, nodes, docs, size)]
    labels = components(links[0])
    discard(kinds, tied)

    # What they do not see.
    counts = nodes.select(F.explode("p").alias("key")).where(F.col("key") < REGION).groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= COMMON)
    counts = materialise(counts, "common")
    held = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()["n"]
    common = counts.where(F.col("k") >= max(COMMON, -(-held // MOST_COMMON))).select("key").toArrow().column("key").to_numpy()  # at most MOST_COMMON
    keys = nodes.select("node", "n", "p").mapInArrow(tidy(_first_values(np.sort(common))), "node long, n int, key long, prev long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    members = materialise(_labelled(keys.join(shared, "key"), labels), "shared-values", small=True)
    discard(counts)

    tried, most = None, 1
    while True:
        # Values whose texts are in one component stay so, and are left out of later rounds.
        crowds = members.groupBy("key").agg((F.min("label") < F.max("label")).alias("mixed"), F.count(F.lit(1)).alias("size")).where("mixed").drop("mixed")
        before, members = members, materialise(members.join(crowds, "key"), "mixed-values")
        discard(before)
        blocks = F.ceil(F.col("size") / CROWD).cast("int")
        dealt = members.join(nodes.select("node", "x"), "node").withColumn("blk", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"u": F.least("blk", "o"), "v": F.greatest("blk", "o")})
        dealt = dealt.withColumn("crowd", F.when(F.col("size") <= CROWD, F.col("key")).otherwise(F.xxhash64("key", "u", "v")))
        dealt = dealt.select("crowd", "key", "u", "v", "blk", "node", "n", "label", "prev", "x").repartition("crowd").sortWithinPartitions("crowd", "key", "u", "v", "label", "node")
        passed = materialise(dealt.mapInArrow(tidy(crowd_pairs(most)), "a long, b long").distinct(), "passed", small=True)
        more = passed.where("a is null").limit(1).count()
        pairs = passed.where("a is not null")
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = similar(pairs, nodes, docs, size)
        links.append(found)
        discard(passed)
        if found.limit(1).count():
            old, labels = labels, components(functools.reduce(DataFrame.unionByName, links))
            discard(old)
        if not more:
            break
        known = pairs if tried is None else materialise(tried.unionByName(pairs), "tried")
        if tried is not None:
            discard(tried, pairs)
        tried, most = known, most * 8
        before, members = members, materialise(_labelled(members.drop("label", "size"), labels), "shared-values")
        discard(before)
    discard(nodes, members, pairs, *links, *([tried] if tried is not None else []))
    return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("node", "n", "key", "prev", F.coalesce("label", "node").alias("label"))


def dedup_similar(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """`docs` with one row of each group: the one with the least doc_id; rows with a null doc_id stay."""
    rows = materialise(sketches(docs, size), "sketches", small=True)
    own = materialise(rows.select("d", "t", "node"), "own")
    own = own.join(similar_groups(rows, docs, size), "node", "left").select("d", "t", F.coalesce("label", "node").alias("label"))
    first = own.groupBy("label").agg(F.min(F.struct("d", "t")).alias("f")).select("f.*").distinct()
    t, d2, t2 = (fresh(docs, x) for x in ("_text_hash", "_kept_doc", "_kept_hash"))
    named = docs.where("doc_id is not null").withColumn(t, F.xxhash64("text"))
    kept = named.join(first.toDF(d2, t2), (F.col("doc_id") == F.col(d2)) & (F.col(t) == F.col(t2)), "left_semi")
    return kept.dropDuplicates(["doc_id", t]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
