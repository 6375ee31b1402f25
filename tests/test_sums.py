"""Sums that meet one another or a bound to the cent: the last bits follow the order of the rows, over files too, as in the SQL run by one thread."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from stratalyte.plans.registry import ORACLES, QUERIES, load

from test_queries import rows

load()
SCHEMA = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64())])
NOW = datetime(2024, 1, 9)


def same_as_sql(spark, folder, query, files):
    """Of events in files of their own, the later ones larger, so that Spark reads them first."""
    (folder / "events.parquet").mkdir()
    for name, part in zip("abcdefgh", files):
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*part), SCHEMA.types)], schema=SCHEMA), f"{folder}/events.parquet/{name}.parquet")
    c = duckdb.connect()
    c.sql("set threads = 1")
    c.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got, want = QUERIES[query](spark, str(folder)), c.sql(ORACLES[query])
    return rows(got.columns, got.collect()), rows(want.columns, want.fetchall())


def to_the_cent(rng, cents, n):
    """n values of whole cents with that sum."""
    cuts = sorted(rng.sample(range(1, cents), n - 1))
    return [(b - a) / 100 for a, b in zip([0, *cuts], [*cuts, cents])]


def in_files(groups, files):
    """Events of groups (user, type, values), the values dealt over growing files and, in a file, between those of others."""
    out = [[] for _ in range(files)]
    for u, kind, values in groups:
        for i, v in enumerate(values):
            out[min(files - 1, int((i / len(values)) ** 0.5 * files))].append((NOW - timedelta(seconds=i), u, kind, v))
    k = iter(range(10**9, 0, -1))  # ids fall: the order is that of the rows
    rng = random.Random(3)
    for part in out:
        rng.shuffle(part)
    return [[(next(k), *e) for e in part] for part in out]


def test_bottleneck_of_equal_sums(spark, tmp_path):
    rng = random.Random(1)
    groups = [(u, kind, to_the_cent(rng, 70_000 + u, 12)) for u in range(300) for kind in ("view", "click", "error")]
    got, want = same_as_sql(spark, tmp_path, "bottleneck", in_files(groups, 4))
    assert len({r[0] for r in want}) == 3 and got == want


def test_bottleneck_shares_that_end_in_a_five(spark, tmp_path):
    parts = [(a, b) for b in (640, 3200, 16_000) for a in range(b // 2 + 1, b, 14)]
    groups = [g for u, (a, b) in enumerate(parts) for g in ((u, "view", [a / 100]), (u, "click", [(b - a) / 100]))]
    got, want = same_as_sql(spark, tmp_path, "bottleneck", in_files(groups, 1))
    assert got == want


def test_bottleneck_of_odd_values(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [[None], [nan], [inf], [-inf], [inf, -inf], [0.0], [-0.0], [1e308, 1e308], [5e-324], [-3.0], [1e16, 1.0, -1e16], [None, 2.0]]
    groups = [(u, kind, odd[(u * m + i) % len(odd)]) for u in range(40) for m, (i, kind) in zip((1, 5, 7), enumerate(("view", None, "click")))]
    groups += [(None, kind, [1.0, 2.0]) for kind in ("view", None)] + [(50, "view", [1.0]), (50, "click", [-1.0])]
    got, want = same_as_sql(spark, tmp_path, "bottleneck", in_files(groups, 2))
    assert got == want


def test_store_eviction_of_sums_at_the_bound(spark, tmp_path):
    rng = random.Random(2)
    groups = [(u, kind, to_the_cent(rng, 100_000, 12)) for u in range(100) for kind in ("view", "click", "error")]
    got, want = same_as_sql(spark, tmp_path, "store_eviction", in_files(groups, 4))
    assert {r[2] for r in want} == {"True", "False"} and got == want


def test_store_eviction_of_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [[None], [nan], [inf], [inf, -inf], [-0.0], [2000.0], [1e16, 1000.0, -1e16], [None, 2.0], [1000.0]]
    (part,) = in_files([(u, kind, odd[(3 * (u or 0) + i) % len(odd)]) for u in (*range(9), None) for i, kind in enumerate(("view", None, "click"))], 1)
    stamps = [datetime(1960, 1, 1, 0, 0, 0, 500_000), datetime(2024, 1, 8, 23, 59, 59, 999_999), None, NOW, datetime(1969, 12, 31, 23, 59, 59, 1)]
    part = [(i, stamps[(u or 0) % len(stamps)], u, kind, v) for i, _, u, kind, v in part]
    got, want = same_as_sql(spark, tmp_path, "store_eviction", [part])
    assert got == want
