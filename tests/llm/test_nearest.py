"""What op5's search costs, and rows that its sieve must not lose."""

import collections

import numpy as np
import pytest

from stratalyte.llm import vptree

from .test_llm import brute_neighbours


def test_few_pairs_are_scored_where_no_bound_excludes_any(monkeypatch):
    scored, plain = 0, vptree.cosine

    def counted(*a):
        nonlocal scored
        out = plain(*a)
        scored += out.size
        return out

    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(8000, 64)), rng.normal(size=(160, 64))
    monkeypatch.setattr(vptree, "cosine", counted)
    who, score, _ = vptree.VPTree(np.arange(8000), x).search(np.arange(160) - 1000, q, 5)
    assert scored < 0.05 * 8000 * 160
    true = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    assert (who == np.argsort(-true, axis=1)[:, :5]).all() and np.allclose(score, -np.sort(-true, axis=1)[:, :5], atol=1e-12)


def rows_of(got):
    out = collections.defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def test_copies_repeated_ids_and_near_ties(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 64)
    monkeypatch.setattr(vptree, "GROUP_ROWS", (100, 1 << 18))
    rng = np.random.default_rng(11)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(50, [1.0, 2.0, 3.0, 4.0])] * 20 + [(7, [1.0, 2.0, 3.0, 4.0])] * 20
    rows += [(i, (np.array([1.0, 2.0, 3.0, 4.0]) + 1e-15 * rng.normal(size=4)).tolist()) for i in range(300, 400)]
    rows += [(i, (rng.integers(1, 4) * np.array([4.0, 1.0, 0.0, 2.0])).tolist()) for i in range(400, 500)] + [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(500, 900)]
    base = vptree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert rows_of(vptree.nearest(base, base.where("id % 50 = 0"), k=5)) == brute_neighbours(rows, range(0, 1000, 50), 5)


@pytest.mark.parametrize("size", [1e-170, 1e170])
def test_magnitudes_whose_squares_leave_the_range(spark, size):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 8))
    frame = lambda v: vptree.usable(spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    far, near = (rows_of(vptree.nearest(b, b.where("id % 50 = 0"), k=5)) for b in (frame(x * size), frame(x)))
    assert far.keys() == near.keys()
    for q, found in near.items():
        assert [i for i, _ in far[q]] == [i for i, _ in found] and np.allclose([s for _, s in far[q]], [s for _, s in found])


def test_no_rows_and_no_queries(spark):
    base = vptree.usable(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert not vptree.nearest(base, base.where("id = 50")).collect() and not vptree.nearest(base.where("id > 5"), base).collect()
