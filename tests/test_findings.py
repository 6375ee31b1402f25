"""Queries on tables that the small ones do not stand for: large values, ties, null and long texts."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pytest

from stratalyte.functions import byteview
from stratalyte.plans.registry import ORACLES, QUERIES, load

from test_queries import rows

load()


def same_as_sql(spark, folder, query, table, data, schema):
    spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = QUERIES[query](spark, str(folder)), c.sql(ORACLES[query])
    return rows(got.columns, got.collect()), rows(want.columns, want.fetchall())


def test_si_prefix_of_large_values(spark, tmp_path):
    orders = [(k, p) for k in (1, 999, 10**6, 3 * 10**6, 36 * 10**6) for p in (0.5, 999.99, 333_333.3, 499_993.18)]
    got, want = same_as_sql(spark, tmp_path, "si_prefix", "orders", orders, "o_orderkey long, o_totalprice double")
    assert got == want


def test_store_eviction_rounds_as_its_sql(spark, tmp_path):
    now = datetime(2024, 1, 9)
    uses = [(28, 1754), (29, 1754), (30, 1754), (30, 759), (31, 759)]  # with an age, scores of nine digits that end in 500
    events = [(1000 * u + i, now - timedelta(seconds=age), u, "view", 1.0) for u, (n, age) in enumerate(uses) for i in range(n)]
    events.append((9999, now, 99, "click", 1.0))
    got, want = same_as_sql(spark, tmp_path, "store_eviction", "events", events, "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert got == want


TEXTS = ["", "a", "aa ab aab, abc abcd", "é€😀 zz", None, "word " * 3000, "x\n1:2=3 {}<p>\t" * 200, "the theory of them, the", "\u0001\u0004A b", "ÿ" * 70]


@pytest.mark.parametrize("name", ["utf8", "local_entropy", "token_statistics", "vocabulary", "pair_counts", "pair_gains", "symbol_frequencies", "case_space_roundtrip", "repetition"])
def test_odd_texts(spark, tmp_path, name):
    docs = [(i, t) for i, t in enumerate(TEXTS * (3 if name != "pair_gains" else 1))]
    got, want = same_as_sql(spark, tmp_path, name, "documents", docs, "doc_id long, text string")
    assert got == want


@pytest.mark.parametrize("step", [byteview.byte_profile, lambda df: byteview.map_bytes(df, "doc_id", "text", lambda b: (len(b),), {"n": "long"})])
def test_workers_are_given_small_batches(spark, step):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "rows"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    df = spark.range(6000, numPartitions=1).selectExpr("id as doc_id", "repeat('some text of many words ', 150) as text")
    assert step(df).count() == 6000
    got = df.mapInArrow(sizes, "size long, rows long").collect()
    assert sum(r["rows"] for r in got) == 6000 and max(r["size"] for r in got) < 5 << 20
    spark.conf.set(key, "16m")
    step(df)
    assert spark.conf.get(key) == "16m"
    spark.conf.unset(key)


def test_pieces_of_a_batch_are_small():
    b = pa.RecordBatch.from_arrays([pa.array(range(30_000)), pa.array(["x" * 2000] * 29_999 + ["y" * (3 << 20)])], ["doc_id", "text"])
    parts = list(byteview.pieces(b))
    assert max(p.num_rows for p in parts) <= 1000 and sum(p.num_rows for p in parts) == 30_000
    assert sorted(len(byteview.text_bytes(p.column(1))[0]) for p in parts)[-2] <= 1 << 20
