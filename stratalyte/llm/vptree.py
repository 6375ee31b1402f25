"""Nearest neighbours by cosine, with a vantage-point tree in each shard.

Rows are dealt to groups by a hash; a task streams its group in shards of a bounded size, each a tree over the unit
sphere, and keeps the k best of every query from shard to shard. A half of a node is left out where its distance bound
exceeds `factor` times the k-th distance found so far: factor one is exact, less leaves out more. In a leaf, products of
unit vectors sieve by that k-th score less their rounding error; only what passes is scored component by component in
double precision on the vectors as given. Queries go in blocks of a bounded size, so no task holds more than one shard
and one block. Where no bound excludes anything (vectors in all directions alike), each query still meets each row.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of
another length than the query's are no candidates; rows with the query's own id are no candidates; of several query
rows with one id the least vector is taken; equal candidate rows each count; extra columns are ignored. Vectors are
scaled by powers of two first, which changes no score but that of magnitudes whose squares leave the range of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

SHARD_ROWS, BLOCK_QUERIES, LEAF = 16384, 32768, 128
#: Components in a shard or block, where vectors are long; rows of the least and the largest group.
VALUES, GROUP_ROWS = 1 << 21, (2048, 1 << 18)
#: Queries, and pairs to score, that a leaf takes at once.
_CHUNK, _PAIRS = 4096, 1 << 14


def cosine(q: np.ndarray, qn: np.ndarray, x: np.ndarray, xn: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with that row of x; sums run over the components in order. qn, xn: sums of squares."""
    return np.clip((np.add.accumulate(q * x, axis=1)[:, -1] + 0.0) / np.sqrt(qn * xn), -1.0, 1.0)


def squares(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return out


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * sim, 0.0))


class Vectors:
    """ids, the vectors scaled so that no square overflows, their sums of squares, and unit vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        self.n = squares(self.x)
        self.unit = self.x / np.sqrt(self.n)[:, None]
        #: Bounds on how far products of unit vectors, and distances by them, are off.
        self.off = 8 * (x.shape[1] + 8) * np.finfo(float).eps
        self.slack = max(1e-6, 4 * np.sqrt(2 * self.off))


class Best:
    """The k best of each query so far: least id first among equals, -inf where there are fewer."""

    def __init__(self, queries: Vectors, k: int):
        self.q, self.k = queries, k
        self.score = np.full((len(queries.ids), k), -np.inf)
        self.who = np.full((len(queries.ids), k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates ids with scores, of the queries at these places."""
        mine = np.unique(at)
        a = np.concatenate([np.repeat(mine, self.k), at])
        s, i = np.concatenate([self.score[mine].ravel(), scores]), np.concatenate([self.who[mine].ravel(), ids])
        order = np.lexsort((i, -s, a))
        top = order[np.searchsorted(a[order], mine)[:, None] + np.arange(self.k)]
        self.score[mine], self.who[mine] = s[top], i[top]


def _distinct(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without copies of a vector that can't be among k: of one vector and id k count, and 2k of one vector hold k of other ids than any one."""
    _, kind = np.unique(np.ascontiguousarray(x).view(f"V{x.dtype.itemsize * x.shape[1]}").ravel(), return_inverse=True)

    def first(rows: np.ndarray, keys: list[np.ndarray], most: int) -> np.ndarray:
        """The first `most` of each run of equal keys."""
        new = np.ones(len(rows), bool)
        new[1:] = np.any([c[rows][1:] != c[rows][:-1] for c in keys], axis=0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        return rows[np.arange(len(rows)) - start < most]

    return first(first(np.lexsort((ids, kind)), [kind, ids], k), [kind], 2 * k)


class VPTree:
    """Halves hold equal numbers, so copies of one vector can't make the tree deep. Rows lie in the order of the leaves; a leaf is its first row and the one after its last."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.v = Vectors(ids, x)
        self.root, rows = self._build(np.arange(len(ids)), 0)
        for name in ("ids", "x", "n", "unit"):
            setattr(self.v, name, getattr(self.v, name)[rows])

    def _build(self, rows: np.ndarray, start: int):
        if len(rows) <= LEAF:
            return (start, start + len(rows)), rows
        vantage = self.v.unit[rows[0]]
        d = _distance(self.v.unit[rows] @ vantage)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        parts = [self._build(rows[o], start + at) for o, at in ((order[:half], 0), (order[half:], half))]
        bounds = [(d[o[0]], d[o[-1]]) for o in (order[:half], order[half:])]
        return (vantage, [(lo, hi, node) for (lo, hi), (node, _) in zip(bounds, parts)]), np.concatenate([r for _, r in parts])

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores, k for each query (least id first among equals; -inf where there are fewer), and distances computed."""
        best = Best(Vectors(query_ids, q), k)
        work = self.improve(best, factor)
        return best.who, best.score, work

    def improve(self, best: Best, factor: float = 1.0) -> int:
        """Take what this tree has into best; distances computed."""
        v, q, k = self.v, best.q, best.k
        work = 0

        def take(at: np.ndarray, lo: int, hi: int) -> None:
            sim = q.unit[at] @ v.unit[lo:hi].T
            least = best.score[at, -1]
            if hi - lo > k and len(fresh := np.flatnonzero(np.isneginf(least))):
                others = np.where(v.ids[lo:hi] == q.ids[at[fresh]][:, None], -np.inf, sim[fresh])
                least[fresh] = np.partition(others, -k, axis=1)[:, -k]
            i, j = np.divmod(np.flatnonzero(sim >= (least - 2 * v.off)[:, None]), hi - lo)
            i, j = at[i], j + lo
            other = v.ids[j] != q.ids[i]
            i, j = i[other], j[other]
            for n in range(0, len(i), _PAIRS):
                a, b = i[n : n + _PAIRS], j[n : n + _PAIRS]
                best.add(a, v.ids[b], cosine(q.x[a], q.n[a], v.x[b], v.n[b]))

        def leaf(node: tuple[int, int], at: np.ndarray) -> None:
            nonlocal work
            work += len(at) * (node[1] - node[0])
            for n in range(0, len(at), _CHUNK):
                take(at[n : n + _CHUNK], *node)

        def distances(vantage: np.ndarray, at: np.ndarray) -> np.ndarray:
            nonlocal work
            work += len(at)
            return _distance(q.unit[at] @ vantage)

        def descend(node, at: np.ndarray) -> None:
            """Each query's own leaf first, so that the walk starts with a k-th distance."""
            if not len(at):
                return
            if isinstance(node[0], int):
                home[at] = node[0]
                return leaf(node, at)
            vantage, (near, far) = node
            first = distances(vantage, at) < (near[1] + far[0]) / 2
            for half, mine in ((near, at[first]), (far, at[~first])):
                descend(half[2], mine)

        def walk(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node[0], int):
                return leaf(node, at[home[at] != node[0]])
            d = distances(node[0], at)
            for lo, hi, half in node[1]:
                least = best.score[at, -1]
                tau = np.where(np.isfinite(least), _distance(least), np.inf)
                walk(half, at[np.maximum(lo - d, d - hi) <= factor * tau + v.slack])

        home = np.zeros(len(q.ids), np.int64)
        descend(self.root, np.arange(len(q.ids)))
        walk(self.root, np.arange(len(q.ids)))
        return work


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id (long), v (array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(base: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score. Both sides have id and v, as `usable` makes them."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    asked, rows = queries.agg(F.count(F.lit(1)).alias("q"), F.sum(F.size("v")).alias("values")), base.agg(F.count(F.lit(1)).alias("n"))
    sizes = asked.crossJoin(rows).first()
    blocks = max(1, -(-sizes["q"] // BLOCK_QUERIES), -(-(sizes["values"] or 0) // VALUES))
    least, most = GROUP_ROWS
    groups = max(1, min(sizes["n"] // least, base.sparkSession.sparkContext.defaultParallelism), -(-sizes["n"] // most))
    of = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("id", "v", F.lit(1).alias("kind"), of(groups, "id", "v").alias("group"), every(blocks).alias("block"))
    right = queries.select("id", "v", F.lit(0).alias("kind"), every(groups).alias("group"), of(blocks, "id").alias("block"))
    dealt = left.unionByName(right).select((F.col("group") * blocks + F.col("block")).alias("part"), "kind", "id", "v")
    search = _searcher(k, factor, SHARD_ROWS, VALUES)
    found = dealt.repartitionById(groups * blocks, "part").sortWithinPartitions("part", "kind").mapInArrow(tidy(search), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors, for each length apart."""
    ids, v = b.column("id").to_numpy(zero_copy_only=False), b.column("v")
    starts = v.offsets.to_numpy()
    n, flat = np.diff(starts), v.values.to_numpy(zero_copy_only=False)
    for m in np.unique(n).tolist():
        at = np.flatnonzero(n == m)
        yield m, ids[at], flat[starts[at][:, None] + np.arange(m)]


def _searcher(k: int, factor: float, shard_rows: int, values: int):
    """For mapInArrow over rows sorted by part and kind: the k best in a part of each of its queries, which come before its rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, of_kind, best = None, None, {}
        held: dict[int, list] = {}  # by length
        size = 0

        def settle() -> None:
            """Make queries of what is held, or a shard for each length that they have."""
            nonlocal size
            for m, pieces in held.items():
                ids, x = (np.concatenate(c) for c in zip(*pieces))
                if of_kind == 0:
                    best[m] = Best(Vectors(ids, x), k)
                else:
                    keep = _distinct(ids, x, k)
                    VPTree(ids[keep], x[keep]).improve(best[m], factor)
            held.clear()
            size = 0

        def results() -> Iterator[pa.RecordBatch]:
            for b in best.values():
                real = np.isfinite(b.score)
                found = np.repeat(b.q.ids, k).reshape(real.shape)[real], b.who[real], b.score[real]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])
            best.clear()

        for batch in batches:
            parts, kinds = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "kind"))
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for b in (batch.slice(lo, hi - lo) for lo, hi in zip([0, *cuts], [*cuts, len(parts)]) if hi > lo):
                now = b.column("part")[0].as_py(), b.column("kind")[0].as_py()
                if now != (part, of_kind):
                    settle()
                    if now[0] != part:
                        yield from results()
                    part, of_kind = now
                for m, ids, x in _vectors(b):
                    if of_kind == 0:
                        held.setdefault(m, []).append((ids, x))
                        continue
                    step = max(1, min(shard_rows, values // m))
                    for n in range(0, len(ids), step) if m in best else ():
                        held.setdefault(m, []).append((ids[n : n + step], x[n : n + step]))
                        size += min(step, len(ids) - n) / step
                        if size >= 1:
                            settle()
        settle()
        yield from results()

    return of
