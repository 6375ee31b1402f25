"""What Python workers are given and keep: batches of bounded size, and no words of a stage that is over."""

import pyarrow as pa
import pytest

from stratalyte.llm import common, decontaminate, packing, tokens

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_batches_for_one_write_only(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["mb", "rows"])

    before = spark.conf.get(KEY)
    texts = spark.range(6000, numPartitions=2).selectExpr("id as doc_id", "repeat('some text of many words ', 150) as text")
    got = common.materialise(texts.mapInArrow(sizes, "mb long, rows long"), "sizes", small=True).collect()
    assert sum(r["rows"] for r in got) == 6000 and max(r["mb"] for r in got) < 1.1 * common.SMALL_BATCH
    assert spark.conf.get(KEY) == before


def test_decontaminate_searches_before_it_joins(spark):
    item = "the quick brown fox jumps over a lazy dog while nine grey cats look on from the garden wall"
    docs = spark.createDataFrame([(1, f"so {item} then"), (2, "nothing of it is here, not a word of the item in this text"), (None, item)], "doc_id long, text string")
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2]
    assert "MapInArrow" not in left._jdf.queryExecution().toString()


def test_packing_leaves_no_words_in_the_worker():
    pytest.importorskip("tokenizers")
    path = tokens.default_tokenizer()
    texts = pa.array([f"word{i} and again {i}" for i in range(3000)])
    first = [ids.tolist() for _, ids, _ in tokens.encoder(path).encode_column(texts, 1)]
    assert len(tokens.encoder(path).base) > 1000
    tokens.encoder(path).forget()
    assert not tokens.encoder(path).base
    assert first == [ids.tolist() for _, ids, _ in tokens.encoder(path).encode_column(texts, 1)]


def test_cut_leaves_no_words_in_the_worker(spark):
    def known(batches):
        n = len(tokens._KEPT[path].base) if path in tokens._KEPT else 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    path = tokens.default_tokenizer()
    docs = spark.range(4000, numPartitions=4).selectExpr("id as doc_id", "concat('word', id, ' other', id * 7) as text")
    assert packing.cut(docs, length=16, end_id=1).count() >= 4000
    assert {r["n"] for r in spark.range(400, numPartitions=8).mapInArrow(known, "n long").collect()} == {0}
