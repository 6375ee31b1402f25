"""Near dedup where many texts share their values and are not alike."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stratalyte.llm import neardup


def crowd(n, blocks=24, taken=10, seed=5):
    """Texts of common passages between separators, so that no value is rare; every second text is the one before with one passage fewer."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    passage = [" ".join(word() for _ in range(12)) for _ in range(blocks)]
    texts = []
    for _ in range(n // 2):
        chosen = rng.sample(passage, taken)
        texts += [" | | | | | ".join(["", *c, ""]).strip() for c in (chosen, chosen[:-1])]
    return texts


def components(texts):
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sets, label


@pytest.mark.parametrize("block", [neardup.CROWD if hasattr(neardup, "CROWD") else 0, 100])
def test_no_link_of_a_crowd_is_lost(spark, monkeypatch, block):
    if block == 100:
        monkeypatch.setattr(neardup, "CROWD", 100)
    texts = crowd(400)
    _, label = components(texts)
    assert 150 < len(set(label)) < 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.dedup_similar(docs).select("doc_id").collect()) == sorted(set(label))


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 63, 64, 65, 300, 1000):
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        b = np.unique(np.append(a[: n - n // 9], rng.integers(-(2**63), 2**63, n // 9)))
        x, y = (np.frombuffer(neardup.sketch(s), np.uint64) for s in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
