import pytest

from stratalyte.operators.codec import pack_stream
from stratalyte.sources import symbols
from stratalyte.sources.container import Container, block_size


def test_symbol_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(10)))
    r = symbols.read_symbols(spark, str(tmp_path), bits=16, block=3).orderBy("block").collect()
    assert [x["symbols"] for x in r] == [[1, 0x203, 0x405], [0x607, 0x809]]
    back = symbols.read_symbols(spark, str(tmp_path), block=100).select(symbols.to_bytes(symbols.F.col("symbols")).alias("b")).first()["b"]
    assert bytes(back) == bytes(range(10))
    with pytest.raises(Exception, match="symbol of 5"):
        symbols.read_symbols(spark, str(tmp_path), limit=5).collect()


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# words\n\nthe\t10\n3→fox\t2\nbroken\n", encoding="utf-8")
    assert [(r["token"], r["freq"]) for r in symbols.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()] == [("the", 10), ("fox", 2)]


def test_dictionary_text(spark, tmp_path):
    words = ["a\nb", "c\\n", "\\", "plain"]
    symbols.write_dictionary(spark.createDataFrame([(w,) for w in words], "word string"), str(tmp_path / "d"))
    assert sorted(r["word"] for r in symbols.read_dictionary(spark, str(tmp_path / "d")).collect()) == sorted(words)


def test_stream_source(spark, tmp_path):
    (tmp_path / "s").write_bytes(pack_stream(b"hello hello hello"))
    spark.dataSource.register(symbols.StreamSource)
    r = spark.read.format("stratalyte_stream").option("paths", str(tmp_path / "s")).load().first()
    assert bytes(r["content"]) == b"hello hello hello"


def test_container(spark, tmp_path):
    c = Container.create(spark, str(tmp_path / "c"))
    c.append(spark.createDataFrame([(0, bytearray(b"hello ")), (1, bytearray(b"wide "))], "position int, content binary"))
    c.append(spark.createDataFrame([(0, bytearray(b"world"))], "position int, content binary"), stage="second")
    c = Container.open(spark, str(tmp_path / "c"))
    text = lambda df: b"".join(bytes(r["content"]) for r in df.orderBy("chunk").collect())
    assert text(c.read()) == b"hello wide world" and text(c.read(4, 9)) == b"o wide wo"
    assert {r["level"]: r["ok"] for r in c.validate().collect()} == {"metadata": True, "sizes": True, "data": True}
    c.set_field("a", "1")
    c.set_field("b", "2")
    c.set_field("a", "3")
    assert c.get_field("a") == "3" and sorted(c.field_names()) == ["a", "b"]
    c.remove_field("a")
    with pytest.raises(KeyError):
        c.get_field("a")
    m = c.metadata().first()
    assert m["size"] == 16 and m["chunks"] == 3 and m["stages"] == ["raw", "second"]
    assert block_size("binary", 65536) == 8192 and block_size("text", 1) == 16384 and block_size("video", 1) == 1 << 20
