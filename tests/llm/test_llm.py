"""The training-data operators against brute force, exact round trips and planted cases, with odd rows in every table."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalyte.llm import decontaminate, langid, linededup, lm, neardup, packing, quality, simhash, tokenfile, tokens, urlfilter, vptree

DOC = "doc_id long, text string, lang string, source string, n_chars long, _gone long, _quality string"


def docs_of(spark, texts, schema=DOC):
    """Rows (id, text) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in texts], schema)


def words_of(n, seed):
    rng = random.Random(seed)
    return [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore magna aliqua".split()) + str(rng.randrange(40) or "") for _ in range(n)]


ODD = [(None, "null id here"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "x " * 30_000), (906, "tie"), (906, "tie")]


@pytest.fixture(scope="module")
def encoder():
    return tokens.ChunkEncoder(tokens.default_tokenizer(), most=50)


def whole(encoder, text, end):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


STRANGE = ["", " ", "it's I'll <|endoftext|> ok", "a|b | c || d", "é é ́x", "a\x1cb c", " \x85 ", "x y z　w 12,3", "ΑΣ ΑΣ. ΑΣ", "İstanbul. ŉ ß,", "Words. words, WORDS", "﻿x ​ y"]


def test_chunks_give_the_ids_of_whole_texts(encoder):
    for t in STRANGE:
        assert encoder.encode(t).tolist() == whole(encoder, t, 0)[:-1], t


def test_token_files(spark, encoder):
    rows = ODD + [(i, t) for i, t in enumerate(STRANGE)] + [(2000 + i, " ".join(words_of(300, i))) for i in range(20)]
    got = tokenfile.roundtrip(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    want = []
    for d, t in order:
        ids = whole(encoder, t, 2)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[1])
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == want


def test_token_record_refuses_damage():
    ids = np.array([5, 6, 5, 7] * 200, np.int32)
    r = bytearray(tokenfile.encode_record([1], np.array([800]), ids))
    assert (tokenfile.decode_record(bytes(r))[2] == ids).all()
    r[-10] ^= 255
    with pytest.raises(ValueError):
        tokenfile.decode_record(bytes(r))


@pytest.mark.parametrize("n,k", [(1, 1), (1, 5), (3000, 2), (5000, 900), (40_000, 3)])
def test_token_coder(n, k):
    rng = np.random.default_rng(n + k)
    ids = (rng.zipf(1.3, n) % k).astype(np.int32) * 50
    got = tokenfile.decode_record(tokenfile.encode_record([None], np.array([n]), ids))
    assert got[0] == [None] and (got[2] == ids).all()


def test_token_files_of_nothing(spark):
    assert tokenfile.roundtrip(docs_of(spark, [])).count() == 0


PASSAGE = "The shared passage stands here. " + " ".join(f"It has many words in it number {i}." for i in range(12))


def test_line_dedup(spark):
    unique = lambda i: f"A line of its own {i}.\nAnd one more {i}."
    rows = ODD + [(i, f"{unique(i)}\n{PASSAGE}\n{unique(i + 100)}") for i in range(1, 6)] + [(50, f"{PASSAGE}"), (51, f"short line\n{unique(51)}"), (52, f"short line\n{unique(52)}")]
    docs = docs_of(spark, rows)
    got = linededup.dedup_lines(docs, count="removed")
    assert got.columns == [*docs.columns, "removed"] and got.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert PASSAGE in text[1] and all(PASSAGE not in text[i] for i in (2, 3, 4, 5, 50))
    assert all(x in text[i] for i in (2, 3, 4, 5) for x in unique(i).split("\n"))
    for i, t in dict(rows).items():
        if i in (51, 52, 900, 901, 902, 903, 904, 906, None):
            assert text[i] == t
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_chunks_keep_the_text_and_resist_shifts(spark):
    lines = [" ".join(words_of(7, i)) + "\n" for i in range(400)]
    a, b = "".join(lines), "new first line\n" + "".join(lines)
    c = {r["k"]: [x["text"] for x in r["c"]] for r in spark.createDataFrame([(1, a), (2, b)], "k int, t string").select("k", linededup.chunks_of(F.col("t")).alias("c")).collect()}
    assert "".join(c[1]) == a and "".join(c[2]) == b and len(c[1]) > 20
    assert len(set(c[1]) & set(c[2])) >= len(c[1]) - 2


URLS = [(1, "http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), (2, "https://example.org/en/12?x=1", "example.org", "/en/12", "example.org/en/1", "block"), (3, "https://example.org/en/2#t", "example.org", "/en/2", "org/", "allow"), (4, "http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), (5, "http://b.com/de/x", "b.com", "/de/x", "com/de/", "block"), (6, "http://xcom/de/x", "xcom", "/de/x", None, None), (7, "no scheme/org/", "", "", None, None), (8, None, "", "", None, None), (9, "http://x.org", "x.org", "", None, None), (10, "", "", "", None, None)]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u, *_ in URLS], "page_id long, url string, html string, score string")
    none = spark.createDataFrame([], "url string, blocked int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, none).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), i


def test_url_trees_learn(spark):
    rows = [(f"http://site{i}.net/page-{i}", 0) for i in range(300)] + [(f"http://s{i}-win-{i * 7919}.biz/a/b/c?{'&'.join('k=1' for _ in range(i % 5 + 2))}", 1) for i in range(300)]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    pages = labelled.select(F.monotonically_increasing_id().alias("page_id"), "url", "blocked")
    got = urlfilter.judge(pages, labelled, rules=()).join(pages.select("page_id", "blocked"), "page_id")
    assert got.where((F.col("verdict") == "block") == (F.col("blocked") == 1)).count() >= 590


BENCH = "If Anna has 12 apples and gives 5 kg to Tom, how many apples does Anna have left after 3 days? She asked Anna twice."


def test_decontamination(spark):
    pad = " ".join(words_of(200, 1))
    changed = BENCH.replace("Anna", "Maria").replace("12", "20").replace("5 kg", "7kg")
    mixed = BENCH.replace("Anna", "Zoe", 1).replace("does Anna", "does Maria").replace("asked Anna", "asked Bea")
    rows = ODD + [(1, f"{pad} {BENCH} {pad}"), (2, f"{pad}. {changed} {pad}"), (3, pad), (4, f"{pad} {BENCH[:40]} {pad}"), (5, f"{pad}. {mixed} {pad}"), (6, BENCH.lower())]
    bench = spark.createDataFrame([(7, BENCH, 1), (8, None, 1), (9, "", 1), (10, "too short", 1)], "item_id long, text string, doc_id int")
    docs = docs_of(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {(1, 7), (2, 7), (6, 7)} <= set(got) and not {k for k in got if k[0] in (3, 4, 5)} and got[1, 7] == 0 and got[2, 7] >= 2
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.where("doc_id in (1, 2)").count() == 0 and left.count() == len(rows) - len({k[0] for k in got})
    assert decontaminate.find_leaks(docs_of(spark, []), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_names_that_begin_sentences(spark):
    item = "Anna has 12 apples in a basket. Tom brings her 7 more from the garden behind the house. Anna then eats 3 of them. Tom weighs the rest at 500 grams on the kitchen scale. How many apples are left?"
    swap = lambda t, *pairs: functools.reduce(lambda x, y: x.replace(*y), pairs, t)
    changed = swap(item, ("Anna", "Maria"), ("Tom", "Peter"), ("12", "30"), ("7", "9"), ("500", "2"), ("grams", "pounds"))
    mixed = item.replace("Anna has", "Zoe has").replace("Tom brings", "Peter brings").replace("Anna then", "Bea then").replace("Tom weighs", "Carl weighs").replace("12", "30").replace("7", "9")
    pad = " ".join(words_of(80, 2))
    docs = docs_of(spark, [(1, f"{pad}. {changed} {pad}"), (2, f"{pad}. {item} {pad}"), (3, f"{pad} {mixed} {pad}"), (4, item.lower()), (5, pad)])
    got = {r["doc_id"]: (r["matched"], r["windows"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[1][0] == got[1][1] == got[2][0]


def brute_leaks(rows, items):
    """The definition, window by window, for texts of letters, full stops and whole numbers."""

    def readings(text):
        words = text.split()
        begins = [k == 0 or words[k - 1].endswith(".") for k in range(len(words))]
        tokens = [("num", w.strip(".")) if w.strip(".").isdigit() else ("name" if w[0].isupper() else "word", w.strip(".").lower()) for w in words]
        out = []
        for r in range(3):
            kinds = ["word" if k == "name" and (r == 2 or r == 0 and b) else k for (k, _), b in zip(tokens, begins)]
            out.append([(k, v if k == "word" else None) for k, (_, v) in zip(kinds, tokens)])
        return out, [v for _, v in tokens]

    def places(text):
        reads, values = readings(text)
        return [[tuple(r[k : k + 5]) for k in range(len(r) - 4)] for r in reads], values

    found = set()
    for item, itext in items:
        iw, iv = places(itext)
        ok = [k for k, w in enumerate(iw[0]) if sum(t[0] == "word" for t in w) >= 2]
        for doc, text in rows:
            dw, dv = places(text)
            at = collections.defaultdict(set)
            for r in dw:
                for k, w in enumerate(r):
                    at[w].add(k)
            hits = [(q, p, r) for r in range(3) for q in ok for p in at[iw[r][q]]]
            for band in {(p - q) // 16 for q, p, r in hits}:
                to, back, seen = {}, {}, set()
                for q, p, r in sorted((h for h in hits if (h[1] - h[0]) // 16 in (band, band + 1))):
                    slots = [(k, iv[q + j], dv[p + j]) for j, (k, _) in enumerate(iw[r][q]) if k != "word"]
                    if q not in seen and all(to.get((k, u), v) == v and back.get((k, v), u) == u for k, u, v in slots):
                        seen.add(q)
                        for k, u, v in slots:
                            to[k, u], back[k, v] = v, u
                if ok and len(seen) >= 0.8 * len(ok):
                    found.add((doc, item))
    return found


def test_decontamination_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 3000)
    plain, names = "one the a of red blue green walks sees finds box tree house river apple stone with from into under".split()[1:], "Anna Tom Maria Peter Zoe Carl".split()

    def sentence(n):
        w = [rng.choice(plain) if rng.random() < 0.75 else rng.choice(names) if rng.random() < 0.6 else str(rng.randrange(40)) for _ in range(n)]
        w[0] = w[0].capitalize()
        return " ".join(w) + "."

    shared = "which of these is the box that Anna finds under the tree."
    items = [(k, " ".join([sentence(rng.randrange(6, 14)) for _ in range(rng.randrange(1, 4))] + [shared] * (k % 3 == 0))) for k in range(30)]
    rows = []
    for d in range(220):
        t = rng.choice(items)[1]
        how = d % 7
        if how == 1:
            t = t.lower()
        elif how == 2:
            t = t.upper()
        elif how == 3:  # every name and number for one other
            to = dict(zip(names, rng.sample(names, len(names)))) | {str(n): str(m) for n, m in zip(range(40), rng.sample(range(100, 200), 40))}
            t = " ".join(to.get(w.rstrip("."), w.rstrip(".")) + "." * w.endswith(".") for w in t.split())
        elif how == 4:  # names and numbers at random
            t = " ".join((rng.choice(names) if w.rstrip(".") in names else str(rng.randrange(40)) if w.rstrip(".").isdigit() else w.rstrip(".")) + "." * w.endswith(".") for w in t.split())
        elif how == 5:
            w = t.split()
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(plain)
            t = " ".join(w)
        elif how == 6:
            t = sentence(30)
        rows.append((d, f"{sentence(20)} {t} {sentence(20)}"))
    rows.append((999, " ".join([shared] * 400)))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(rows, items)
    assert got == want
    assert len({d for d, _ in want if d % 7 in (0, 1, 2)}) == len([d for d, _ in rows[:-1] if d % 7 in (0, 1, 2)])
    assert len({d for d, _ in want if d % 7 == 3}) >= 0.95 * len([d for d, _ in rows if d % 7 == 3])
    monkeypatch.setattr(decontaminate, "STRIP", 50)
    again = decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in again.collect()} == want


def brute_neighbours(rows, queries, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q in queries:
            best = []
            for i, w in ok:
                if i != q and len(w) == len(v):
                    dot = lambda x, y: functools.reduce(lambda s, p: s + p[0] * p[1], zip(x, y), 0.0)  # noqa: E731  not sum(), which compensates
                    best.append((-min(1.0, max(-1.0, dot(v, w) / math.sqrt(dot(v, v) * dot(w, w)))), i))
            out[q] = [(i, -s) for s, i in sorted(best)[:k]]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    monkeypatch.setattr(vptree, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(i, [1.0, 2.0] * 4) for i in range(400, 600)]
    rows += [(600, None), (650, []), (700, [0.0] * 8), (750, [float("nan")] * 8), (800, [float("inf")] + [1.0] * 7), (850, [None] * 8), (None, [1.0] * 8), (900, [1.0, 2.0, 3.0])]
    base = vptree.usable(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int"), "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in vptree.nearest(base, base.where("id % 50 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {q: x for q, x in brute_neighbours(rows, range(0, 1000, 50), 5).items() if x}
    assert dict(got) == want


def test_neighbours_relaxed_does_less_work_with_good_recall():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(40, size=4000)] + 0.2 * rng.normal(size=(4000, 16))).astype(float)
    tree = vptree.VPTree(np.arange(4000), x)
    exact, _, all_work = tree.search(np.arange(100) - 1000, x[:100] + 0.01, 5, 1.0)
    some, _, work = tree.search(np.arange(100) - 1000, x[:100] + 0.01, 5, 0.7)
    assert work < all_work < 100 * 4000
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact.tolist(), some.tolist())]) >= 0.9


def test_language_model(spark):
    rows = ODD + [(i, " ".join(words_of(60 + i % 50, i))) for i in range(300)]
    rows = [(i, t) for i, t in rows]
    got = lm.score(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    count, total = collections.Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*(t or "").encode().lower().split(), None])
    total, kinds = sum(count.values()), len(count)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
        r = by[i][0]
        assert r["n_tokens"] == len(w) and r["train_tokens"] == total and r["n_known"] == sum(count[x] > 0 for x in w)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score(docs_of(spark, [])).count() == 0


class BruteModel:
    """Deleted interpolation by dictionaries, with the weights that EM gives on all held-out events one by one."""

    def __init__(self, texts, order):
        self.order = order
        part = {i: (lambda f: lm.TEST if f == lm.TEST_FOLD else lm.TUNE if f == lm.TUNE_FOLD else lm.MAIN)(zlib.crc32(str(i).encode()) % 7) for i, _ in texts}
        self.docs = [(i, t.encode().lower().split() + [None], part[i]) for i, t in texts]
        self.counts = {"main": collections.Counter(), "whole": collections.Counter()}
        for _, w, p in self.docs:
            for to in ["main", "whole"] if p == lm.MAIN else ["whole"] if p == lm.TUNE else []:
                for t in range(len(w)):
                    for k in range(order):
                        self.counts[to][self.gram(w, t, k)] += 1
                self.counts[to]["docs"] += 1
                self.counts[to]["tokens"] += len(w)
        self.kinds = sum(1 for g in self.counts["whole"] if isinstance(g, tuple) and len(g) == 1)
        self.weights = []
        for k in range(order):
            events = collections.defaultdict(list)
            for _, w, p in self.docs:
                if p == lm.TUNE:
                    for t in range(len(w)):
                        c = self.context("main", w, t, k)
                        odds = self.counts["main"][self.gram(w, t, k)] / c / self.p("main", w, t, k) if c else 0.0
                        events[0 if k == 0 else int(math.log2(c + 1))].append(odds)
            by = {b: lm.weight(np.array(o), np.ones(len(o))) for b, o in events.items()}
            weights = []
            for b in range(64):
                weights.append(by.get(b, weights[-1] if weights else 0.0))
            self.weights.append(weights)

    @staticmethod
    def gram(w, t, k):
        return tuple((["<s>"] * k + w)[t : t + k + 1])

    def context(self, to, w, t, k):
        c = self.counts[to]
        return c["tokens"] if k == 0 else c["docs"] if t == 0 else c[self.gram(w, t - 1, k - 1)]

    def p(self, to, w, t, upto):
        p = 1 / (self.kinds + 1)
        for k in range(upto):
            c = self.context(to, w, t, k)
            m = self.weights[k][0 if k == 0 else int(math.log2(c + 1))] if c else 0.0
            p = m * (self.counts[to][self.gram(w, t, k)] / c if c else 0) + (1 - m) * p
        return p


def chained(n, seed=5):
    """Texts in which most words follow the same word each time."""
    rng, follow, texts = random.Random(seed), {}, []
    for i in range(n):
        w = [f"w{rng.randrange(500)}"]
        for _ in range(rng.randrange(60)):
            w.append(follow.setdefault(w[-1], f"w{rng.randrange(500)}") if rng.random() < 0.7 else f"W{rng.randrange(3000)}")
        texts.append((i, " ".join(w)))
    return texts + [(5000, ""), (5001, "w1"), (5002, "never seen words 2")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_by_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_KEYS", 512)  # several ranges
    texts = chained(240)
    want = BruteModel(texts, order)
    model, _, _ = lm.fit(docs_of(spark, texts).select("doc_id", "text"), order)
    assert (model.kinds, model.docs, model.tokens) == (want.kinds, want.counts["whole"]["docs"], want.counts["whole"]["tokens"])
    for k in range(order):  # odds are gathered in eighths of a power of two
        assert np.allclose(model.weights[k], want.weights[k], atol=0.02 if k < 2 else 0.05), k
    want.weights = model.weights
    got = {r["doc_id"]: r for r in lm.score(docs_of(spark, texts), order=order).collect()}
    for i, w, _ in want.docs:
        assert abs(got[i]["score"] - sum(math.log10(want.p("whole", w, t, order)) for t in range(len(w)))) < 1e-6 * len(w)
    held = [r for r in got.values() if r["held_out"]]
    if order > 1:
        assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_interpolation_is_a_distribution(spark):
    want = BruteModel(chained(80), 3)
    words = [g[0] for g in want.counts["whole"] if isinstance(g, tuple) and len(g) == 1]
    for before in ([], ["x"], [b"w1"], [b"w1", b"w2"], want.docs[3][1][:2]):
        mass = sum(want.p("whole", [*before, w], len(before), 3) for w in [*words, "unknown"])
        assert abs(mass - 1) < 1e-9, before


def test_language(spark):
    text = {"en": "the and of that with for this", "de": "der und nicht die ist das mit", "fr": "les des une pour dans que est"}
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(text[x].split(), k=40)), x, "s", 1) for i, x in enumerate(list(text) * 30)], "doc_id long, text string, lang string, source string, n_chars long")
    page = lambda x, words, decl=None: f"<html lang={decl or x}><body><p>{' '.join(rng.choices(text[words].split(), k=12)) if words else ''}</p></body></html>"
    rows = [(i, f"http://site.{x}/a", page(x, x), "z") for i, x in enumerate(list(text) * 20)] + [(500, "http://site.de/b", page("de", None), "z"), (501, None, None, "z"), (502, "", "", "z"), (503, "http://site.fr/b", page("fr", "fr", "en"), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    got = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    assert len(got) == len(rows) and all(got[i]["lang"] == x for i, x in enumerate(list(text) * 20))
    assert got[500]["lang"] == "de" and got[503]["lang"] == "fr" and got[501]["declared"] == ""
    assert {r["lang"] for r in langid.identify(pages, docs.limit(0)).collect()} == {"und"} and langid.identify(pages.limit(0), docs).count() == 0


def test_quality(spark):
    clean = [(i, " ".join(words_of(80, i)).capitalize() + ".") for i in range(1600)]
    junk = [(i, "WIN!! " * 60 if i % 2 else "spam spam " * 50) for i in range(2000, 2280)]
    rows = ODD + clean + junk
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i in [*range(900), *range(907, 1600), *range(2000, 2280)]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and not 900 <= r["doc_id"] < 907]
    assert held and sum(r["predicted"] == (r["doc_id"] < 2000) for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert {r["score"] for r in quality.quality(docs_of(spark, ODD), labels.limit(0)).collect()} == {1.0}
    assert quality.quality(docs_of(spark, []), labels).count() == 0


def test_prior_is_found():
    rng = np.random.default_rng(0)
    pos = rng.normal(2, 1, 5000)
    unl = np.concatenate([rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)])
    assert 0.68 < quality.estimate_prior(pos, unl) < 0.8


def plain_fingerprint(text, size=4):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    n = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if n[b] * 2 > len(s))


def test_simhash(spark):
    rows = ODD + [(i, " ".join(words_of(120, i % 20) + ([f"tail{i}"] if i % 3 else []))) for i in range(100, 180)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fp = {i: plain_fingerprint(t) for i, t in rows}
    assert len(got) == len(rows) and all(r["fp"] & (1 << 64) - 1 == fp[r["doc_id"]] for r in got)
    ids = sorted(i for i in fp if i is not None)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            label[a] = min(label[b] for b in ids if (fp[a] ^ fp[b]).bit_count() <= 4)
    assert all(r["component_id"] == (None if r["doc_id"] is None else label[r["doc_id"]]) for r in got)
    docs = docs_of(spark, rows)
    left = simhash.dedup_near(docs)
    assert left.columns == docs.columns and sorted({r["doc_id"] for r in left.collect()} - {None}) == sorted(set(label.values()))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_dedup_by_similarity(spark):
    rng = random.Random(9)
    base = [" ".join(f"v{rng.randrange(500)}" for _ in range(150)) for _ in range(12)]

    def changed(t, k):
        w = t.split()
        for i in rng.sample(range(0, 150, 7), k):
            w[i] = "other"
        return " ".join(w)

    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, changed(t, 1 + i % 6)) for i, t in enumerate(base * 4)]
    rows += [(1, "one id with a second text of some length here"), (300, "x y z"), (301, "X  y z"), (302, ""), (303, None), (304, " "), (None, base[0]), (305, base[3]), (306, "q r s"), (306, "q r s")]
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    ids = sorted({x for x in rows if x[0] is not None}, key=lambda x: (x[0], x[1] or ""))
    sets = [shingle(t) for _, t in ids]
    label = list(range(len(ids)))
    for _ in range(6):
        label = [min(label[j] for j in range(len(ids)) if near(sets[i], sets[j])) for i in range(len(ids))]
    docs = docs_of(spark, rows)
    left = neardup.dedup_similar(docs)
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    want = [ids[i] for i in sorted(set(label))]
    assert left.columns == docs.columns and (None, base[0]) in got and len(got) == len(want) + 1
    assert {i for i, _ in got} - {None} == {i for i, _ in want} and rows[60] in got
    plain = {r["doc_id"] for r in simhash.dedup_near(docs).collect()}
    assert len(plain) > len({i for i, _ in got})  # four bits of the fingerprint are too few for 0.8
    assert neardup.dedup_similar(docs_of(spark, [])).count() == 0


def test_bk_trees_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(12)]))
    keys = np.sort(rng.integers(0, 3, len(fps)))
    got = {(int(a), int(b)) for x, y in simhash.Forest(keys, fps).links(4) for a, b in zip(x, y)}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if keys[a] == keys[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= 4}
    assert got == want and want


def test_components_of_a_chain(spark):
    n = 200
    ids = list(range(n))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_packing(spark, encoder):
    rows = ODD + [(i, " ".join(words_of(50 + 13 * (i % 90), i))) for i in range(1, 240)]
    got = packing.pack(docs_of(spark, rows), with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, t in rows:
        ids, copies = whole(encoder, t, 1), sum(x == i for x, _ in rows)
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) * copies and all(r["doc_tokens"] == len(ids) and r["ids"] == ids[r["start"] : r["start"] + r["length"]] for r in pieces)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    used = sum(r["length"] for r in got)
    assert used / (2048 * len(by_sequence)) > 0.9
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_knapsack_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        values = rng.random(4)
        best, count = packing.knapsack(values, sizes, 20)
        brute = max(sum(c * v for c, v in zip(x, values)) for x in np.ndindex(*(20 // s + 1 for s in sizes)) if sum(c * s for c, s in zip(x, sizes)) <= 20)
        assert abs(best - brute) < 1e-9 and (count * sizes).sum() <= 20 and abs((count * values).sum() - best) < 1e-9


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(8)
    sizes, demand = np.unique(np.minimum(128, 1 + rng.geometric(0.03, 20_000)), return_counts=True)
    plan = packing.plan_patterns(sizes, demand, 128)
    assert (sum(p * n for p, n in plan) >= demand).all() and all((p * sizes).sum() <= 128 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.02 * -(-(sizes * demand).sum() // 128) + 2
