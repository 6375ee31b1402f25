"""Known answers and round trips of single functions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalyte.functions import byteview
from stratalyte.operators import codec, dictionary, integrity, patterns, schedules, text, windows


def profile_of(t):
    flat, starts = byteview.text_bytes(pa.array([t], pa.string()))
    p = {k: v[0] for k, v in byteview.profiles(flat, starts).items()}
    h = np.array([byteview.entropy_of(p["hist"])])
    return p | {"cond": byteview.conditional_entropy(flat), "block_var": byteview.block_variances(flat, starts, h)[0]}


def test_profiles_are_those_of_single_texts():
    texts = ["", None, "a", "aa bb", "x" * 63, "xy" * 64, "é" * 200, "The quick brown fox. " * 40, "z"]
    flat, starts = byteview.text_bytes(pa.array(["skipped", *texts], pa.string()).slice(1))
    got = byteview.profiles(flat, starts)
    h = np.array([byteview.entropy_of(x) for x in got["hist"]])
    var = byteview.block_variances(flat, starts, h)
    for k, t in enumerate(texts):
        want = profile_of(t)
        assert all((got[x][k] == want[x]).all() for x in got) and abs(var[k] - want["block_var"]) < 1e-12
        b = (t or "").encode()
        blocks = [byteview.entropy_of(np.bincount(np.frombuffer(b[max(0, m - 64) : m + 64], np.uint8), minlength=256)) for m in range(0, len(b), 64)]
        assert abs(var[k] - (np.mean([(x - h[k]) ** 2 for x in blocks]) if len(blocks) > 1 else 0)) < 1e-9
        assert (want["sum"], want["sumsq"], want["lagged"]) == (sum(b), sum(x * x for x in b), sum(x * y for x, y in zip(b, b[1:])))
        assert want["same"] == sum(x == y for x, y in zip(b, b[1:])) and want["n"] == len(b)


def test_rows_with_repeated_or_no_ids_stay(spark, tmp_path):
    from stratalyte.plans.registry import QUERIES, load

    load()
    rows = [(1, "<a>one</a> two 1:2", "s"), (1, "{three: 4}", "s"), (None, "five six seven", "s"), (2, None, "s"), (2, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in {"content_type": 5, "repetition": 5, "crc_verified": 5, "entropy_running_average": 5, "file_pattern": 3, "content_scores": 3}.items():
        assert QUERIES[name](spark, str(tmp_path)).count() == n, name


def test_entropy_of_sixteen_equal_bytes():
    p = profile_of("".join(chr(i % 16) for i in range(1024)))
    assert p["n"] == 1024 and byteview.entropy_of(p["hist"]) == 4.0 and p["same"] == 0


def test_entropy_of_nothing():
    p = profile_of(None)
    assert p["n"] == 0 and p["cond"] == 0.0 and p["block_var"] == 0.0 and byteview.repeats(np.zeros(0, np.uint8)) == (0, 0, 0)


def test_checksums():
    assert integrity.poly31(np.array([1, 2, 3], np.uint8)) == 1026
    assert integrity.crc32_mpeg(b"123456789") == 0x0376E6E7
    assert integrity.djb2(np.frombuffer(b"a", np.uint8)) == 5381 * 33 + 97


def test_overlapping_search():
    assert patterns.find_all(np.frombuffer(b"aaaa", np.uint8), b"aa").tolist() == [0, 1, 2]
    assert patterns.find_all(np.frombuffer(b"a", np.uint8), b"aa").tolist() == []


def test_windows(spark):
    w = windows.sliding(spark.createDataFrame([(1, 300), (2, 0)], "doc_id int, n int"), 100, 25).orderBy("win_id").collect()
    assert [(r["start"], r["end"]) for r in w] == [(0, 100), (75, 175), (150, 250), (225, 300)]


def test_stream_split(spark):
    r = spark.createDataFrame([(10,)], "n int").select(F.inline(windows.split_streams(F.col("n"), 4))).collect()
    assert [x["length"] for x in r] == [3, 3, 2, 2] and [x["start"] for x in r] == [0, 3, 6, 8]


def test_padding(spark):
    r = spark.createDataFrame([(["61", "62", "63"],)], "a array<string>").select(*(F.array_join(windows.pad_pairs(F.col("a"), F.lit(8), k), "").alias(k) for k in ("zero", "repeat", "reflect"))).first()
    decoded = {k: bytes.fromhex(r[k]).decode() for k in ("zero", "repeat", "reflect")}
    assert decoded == {"zero": "abc\0\0\0\0\0", "repeat": "abcabcab", "reflect": "abccbaab"}


def test_schedule(spark):
    r = spark.createDataFrame([(5.0,), (10.0,), (40.0,)], "x double").select(schedules.schedule("1,10,2,p0.5", F.col("x")).alias("y")).collect()
    assert [round(x["y"], 9) for x in r] == [1.5, 2.0, 1.0]


def test_si_format(spark):
    cases = {999: "999", 1000: "1.00k", 1999: "1.99k", 12345: "12.3k", 123456: "123k", 9_999_999: "9.99M", 1_234_567_890_123: "1.23T"}
    r = spark.createDataFrame([(k,) for k in cases], "v long").select("v", text.si_format(F.col("v")).alias("s")).collect()
    assert {x["v"]: x["s"] for x in r} == cases


def test_case_space_codes():
    assert text.case_space_encode(b"Hello WORLD the aBc\x02") == b"\x01\x03 hello\x02 world the a\x01\x03 bc\x04\x02"
    assert text.case_space_encode(b"x  1y") == b"\x01 x  1\x01 y"
    assert text.case_space_decode(b"\x01\x02 abc\x01\x03 de f\x04\x01") == b"ABCDe f\x01"


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_case_space_roundtrip(data):
    assert text.case_space_decode(text.case_space_encode(data)) == data


@given(st.binary(max_size=120))
@settings(max_examples=60, deadline=None)
def test_codec_roundtrip(data):
    assert codec.unpack_stream(codec.pack_stream(data)) == data
    assert codec.unpack_stream(codec.pack_stream(data, 0)) == data


def test_codec_carries():
    rng = random.Random(7)
    for _ in range(50):
        bits = [(rng.choice((1, 2, 16384, 32766, 32767)), rng.random() < 0.5) for _ in range(400)]
        e = codec.BitEncoder()
        for p, b in bits:
            e.put(p, b)
        d = codec.BitDecoder(e.flush())
        assert all(d.get(p) == b for p, b in bits)


def test_codec_refuses_damage():
    s = bytearray(codec.pack_stream(b"some text that is long enough"))
    s[-3] ^= 1
    with pytest.raises(ValueError):
        codec.unpack_stream(bytes(s))


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_pair_replacement_goes_left_to_right(symbols):
    to = {(0, 0): 9, (1, 2): 8}
    want, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) in to:
            want.append(to[tuple(symbols[i : i + 2])])
            i += 2
        else:
            want.append(symbols[i])
            i += 1
    assert dictionary.replace_pairs(np.array(symbols, np.int32), to).tolist() == want


def test_pcg_repeats():
    a, b = schedules.Pcg(42), schedules.Pcg(42)
    x = [a.uniform() for _ in range(1000)]
    assert x == [b.uniform() for _ in range(1000)] and 0.45 < sum(x) / 1000 < 0.55
