"""The pipeline over small tables, against what its stages are to do."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(10)).capitalize() + "."
    text = {i: " ".join(sentence() for _ in range(8)) + "\n" + " ".join(sentence() for _ in range(8)) for i in range(1, 301)}
    item = " ".join(sentence() for _ in range(4))
    passage = " ".join(sentence() for _ in range(7))
    for i in range(301, 361):
        text[i] = "BUY!! NOW!! " * 50
    text[400], text[401] = text[10], text[11].replace(text[11].split()[3], "changed", 1)
    text[402] = text[12] + " " + item + " " + sentence()
    for i in (20, 21, 22):
        text[i] += "\n" + passage
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i <= 300), 0) for i in range(1, 361)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), text, passage


def test_pipeline(spark, tables, tmp_path):
    d, text, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not set(range(301, 361)) & set(kept["quality"]) and len(set(range(1, 301)) & set(kept["quality"])) >= 297
    assert set(kept["line_dedup"]) == set(kept["quality"])
    assert sum(passage in t for t in kept["line_dedup"].values()) == 1
    assert 402 in kept["near_dedup"] and 402 not in kept["decontamination"]
    assert len(set(range(1, 301)) & set(kept["decontamination"])) >= 296
    packed = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert packed == set(kept["decontamination"])
    assert {name for name, _ in pipeline.STAGES} == set(kept) | {"packing"}


def test_run(spark, tables):
    out = pipeline.run(spark, tables[0])
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
