"""SimHash near-dedup with BK-trees.

A 64-bit fingerprint is linked to every other at `radius` or fewer differing bits. Distinct fingerprints are dealt
to shards that share two of six bit blocks (with four differing bits, two of six blocks are equal, so no link is
lost). A shard is a BK-tree, its children keyed by the Hamming distance to the parent, and a search follows only
edges within the radius of the distance at hand. The trees of all shards together grow with the corpus, so they are
not broadcast: each travels with its shard in a shuffle, which also keeps them off the driver. Within a shard the
links become one edge for each linked fingerprint. A large shard is first linked to a few of its members, and a
search leaves out what is all linked with it already, so a crowd of near-equal fingerprints is not walked pair by pair; components over those edges come from distributed rounds of
least-label hooking, each written to the shared folder.

Defined results: a null or blank text has fingerprint zero, linked like any other; rows with a null doc_id have a
fingerprint, no links and a null component; repeated rows have one result each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, tidy, words

SEED = 42
#: Lowest bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 4) -> int:
    """Majority of the XXH64 values of all shingles of the whole text; as a signed 64-bit integer."""
    w = words(text)
    if not w:
        return 0
    line = b" ".join(w)
    at = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], at + 1)).tolist()
    ends = np.append(at, len(line)).tolist()
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(w) - size + 1)
    totals = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        if len(w) < size:
            h = [h64(line, SEED)]
        else:
            h = [h64(line[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + size - 1 : hi + size - 1])]
        totals += np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, size: int = 4) -> DataFrame:
    """doc_id, fp (long) for every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), size) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps], ["doc_id", "fp"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(tidy(of), "doc_id long, fp long")


def shard_keys(fp: Column) -> Column:
    """The keys of the shards that a fingerprint belongs to: the pair of blocks and their bits."""
    part = lambda k: F.shiftrightunsigned(fp, BLOCKS[k][0]).bitwiseAND((1 << BLOCKS[k][1]) - 1)
    pairs = list(combinations(range(len(BLOCKS)), 2))
    return F.array(*[F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 11) + part(i), 11) + part(j) for n, (i, j) in enumerate(pairs)])


class Forest:
    """BK-trees over fingerprints that are sorted by shard; one root for each shard."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.ones(n, bool)
        first[1:] = keys[1:] != keys[:-1]
        self.roots = np.flatnonzero(first)[np.cumsum(first) - 1]
        slots, nodes = [], []
        rest = np.flatnonzero(~first)
        at = self.roots[rest]
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
            slot = at * 65 + d
            found, index, back = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(found)
            nodes.append(rest[index])
            stay = np.ones(len(rest), bool)
            stay[index] = False
            at = rest[index][back][stay]
            rest = rest[stay]
        self.levels = [(slot // 65, node) for slot, node in zip(slots, nodes)]  # parents and children, from the roots down
        slot, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, nodes))
        order = np.argsort(slot)
        self.slots, self.nodes = slot[order], node[order]
        self.labels = np.arange(n)
        self.whole = np.zeros(n, bool)  # everything below the node has its label

    def crowds(self, radius: int, least: int = 64, rounds: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of large shards to a few of their members: each round the first that is not linked yet, with all near it."""
        size = np.bincount(self.roots, minlength=len(self.fps))
        at = np.flatnonzero(size[self.roots] >= least)
        for _ in range(rounds):
            if not len(at):
                return
            shards, first = np.unique(self.roots[at], return_index=True)
            lead = at[first][np.searchsorted(shards, self.roots[at])]
            near = np.bitwise_count(self.fps[at] ^ self.fps[lead]) <= radius
            yield lead[near], at[near]
            at = at[~near]

    def settle(self, labels: np.ndarray) -> None:
        """Walks leave out what is below a node if all of it is linked with the query by these labels."""
        self.labels = labels
        low, high = labels.copy(), labels.copy()
        for parents, children in reversed(self.levels):
            np.minimum.at(low, parents, low[children])
            np.maximum.at(high, parents, high[children])
        self.whole = low == high

    def _child(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which slots have a child, and it."""
        at = np.searchsorted(self.slots, slot)
        at[at == len(self.slots)] = 0
        has = self.slots[at] == slot
        return has, self.nodes[at[has]]

    def links(self, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b) of nodes of one shard at `radius` or less, a < b; the frontier is walked in pieces of `most`."""
        q = np.flatnonzero(self.roots != np.arange(len(self.fps)))
        stack = [(q[i : i + most], self.roots[q[i : i + most]]) for i in range(0, len(q), most)]
        while stack:
            q, at = stack.pop()
            d = np.bitwise_count(self.fps[q] ^ self.fps[at]).astype(np.int64)
            hit = (d <= radius) & (at < q)
            if hit.any():
                yield at[hit], q[hit]
            nq, nat = [], []
            for e in range(-radius, radius + 1):
                ok = (d + e >= 1) & (d + e <= 64)
                has, child = self._child(at[ok] * 65 + d[ok] + e)
                keep = child <= q[ok][has]  # a child has a larger number than its parent: what follows is larger still
                keep &= ~(self.whole[child] & (self.labels[child] == self.labels[q[ok][has]]))
                nq.append(q[ok][has][keep])
                nat.append(child[keep])
            q, at = np.concatenate(nq), np.concatenate(nat)
            stack += [(q[i : i + most], at[i : i + most]) for i in range(0, len(q), most)]


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node that the pairs connect it with."""
    lab = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = lab[a], lab[b]
            if (open_ := la != lb).any():
                a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
                np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
                while (lab[lab] != lab).any():
                    lab = lab[lab]
            else:
                break
    return lab


def _edges(radius: int, rows: int = 200_000):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(x: np.ndarray) -> pa.RecordBatch:
            if not len(x):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            forest = Forest(x[:, 0], x[:, 1].view(np.uint64) if x[:, 1].flags.c_contiguous else np.ascontiguousarray(x[:, 1]).view(np.uint64))
            forest.settle(least_labels(len(x), forest.crowds(radius)))
            lab = least_labels(len(x), chain([(forest.labels, np.arange(len(x)))], forest.links(radius)))
            on = np.flatnonzero(lab != np.arange(len(x)))
            return pa.RecordBatch.from_arrays([pa.array(x[lab[on], 2]), pa.array(x[on, 2])], ["a", "b"])

        def grouped(x: np.ndarray) -> np.ndarray:
            """Without the shards of one fingerprint."""
            key = x[:, 0]
            same = key[1:] == key[:-1]
            keep = np.zeros(len(x), bool)
            keep[1:] |= same
            keep[:-1] |= same
            return x[keep]

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy() for i in range(3)], axis=1))
            if sum(map(len, held)) >= rows:
                x = np.concatenate(held)
                cut = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last shard may go on
                held = [x[cut:]]
                if cut:
                    yield linked(grouped(x[:cut]))
        if held:
            yield linked(grouped(np.concatenate(held)))

    return of


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect it with. Every round is written to the shared folder."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("l")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("l")))
    labels = materialise(both.groupBy("node").agg(F.min("l").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
        open_ = edges.join(la, "a").join(lb, "b").where("la <> lb")
        # A label hooks on to the least label that an edge joins it with; it may itself have moved, so two jumps follow.
        own = labels.where("node <> label").select(F.col("node").alias("hi"), F.col("label").alias("lo"))
        hooks = open_.select(F.greatest("la", "lb").alias("hi"), F.least("la", "lb").alias("lo")).unionByName(own).groupBy("hi").agg(F.min("lo").alias("lo"))
        hooks = materialise(hooks, "hooks")
        nxt = labels
        for _ in range(2):
            nxt = nxt.join(hooks, nxt["label"] == hooks["hi"], "left").select("node", F.coalesce("lo", "label").alias("label"))
        nxt = materialise(nxt, "labels")
        changed = nxt.toDF("node", "new").join(labels, "node").where("new <> label").limit(1).count()
        discard(labels, hooks)
        labels = nxt
        if not changed:
            discard(edges)
            return labels


def tree_edges(kinds: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: one edge for each linked fingerprint of each shard; kinds: fp and rep, a row for each fingerprint."""
    if radius > 4:
        raise ValueError("six blocks in pairs find links of four bits at most")
    shards = kinds.select(F.explode(shard_keys(F.col("fp"))).alias("key"), "fp", "rep")
    return shards.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(tidy(_edges(radius)), "a long, b long")


def near_duplicates(docs: DataFrame, *, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id for every row: the least doc_id that links of `radius` or fewer bits reach."""
    prints = materialise(fingerprints(docs, size=size), "fingerprints")
    kinds = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "kinds")
    found = components(tree_edges(kinds, radius))
    named = kinds.join(found, kinds["rep"] == found["node"], "left").select(F.col("fp").alias("f"), F.coalesce("label", "rep").alias("component_id"))
    out = prints.join(named, prints["fp"] == named["f"], "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup_near(docs: DataFrame, *, size: int = 4, radius: int = 4) -> DataFrame:
    """`docs` without the rows whose component has a smaller doc_id; rows with a null doc_id stay."""
    groups = near_duplicates(docs, size=size, radius=radius).where("doc_id <> component_id").select("doc_id").distinct()
    gone = fresh(docs, "_gone_id")
    return docs.join(groups.toDF(gone), F.col("doc_id") == F.col(gone), "left_anti")
