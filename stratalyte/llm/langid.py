"""Language identification by Bayesian fusion of evidence.

Evidence of a page: the likelihood of its visible text under character-trigram models of the languages, tempered;
the language its markup declares; the last label of its host; and the host itself. How often each language is
declared so, has that suffix, or is found on that host comes from grouped sums of the text posteriors over all
pages: the declaration and suffix as likelihoods with add-one smoothing, the host as a prior smoothed towards its
domain (last two labels), that towards all pages. A page's own text is taken out of the counts it is judged by.

Defined results: null or empty markup gives no text evidence and no declaration; a null url has an empty host;
repeated rows have repeated results; with no labelled text the language is `und`; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .urlfilter import split_url

SLOTS = 1 << 14
#: Each trigram counts as this share of an independent one: text evidence is correlated.
TEMPER = 0.2
HOST_WEIGHT = DOMAIN_WEIGHT = 10.0
_DROPPED = re.compile(r"<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def visible_text(html: str | None) -> str:
    return html_lib.unescape(_TAG.sub(" ", _DROPPED.sub(" ", html or "")))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the text's character trigrams by hash slot; letters lower-cased, runs of other characters as one space."""
    line = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(SLOTS, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=SLOTS)


@dataclass
class TextModel:
    langs: list[str]
    logs: np.ndarray  # a row for each language

    def log_likelihood(self, text: str) -> np.ndarray:
        return TEMPER * (self.logs @ trigram_counts(text))


def fit_text(docs: DataFrame, *, max_rows: int = 8_000) -> TextModel:
    """From at most about `max_rows` labelled documents, taken by a hash of the text."""
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(1, n)) * (1 << 30)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for t, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                sums[lang] = sums.get(lang, 0) + trigram_counts(t.as_py())
            names = [x for x, v in sums.items() for _ in range(np.count_nonzero(v))]
            slots = [np.flatnonzero(v) for v in sums.values()]
            counts = [v[v > 0] for v in sums.values()]
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(slots)), pa.array(np.concatenate(counts))], ["lang", "slot", "n"])

    got = sample.mapInArrow(of, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.full((len(langs), SLOTS), 0.5)
    np.add.at(counts, (np.array([langs.index(x) for x in names], int), got.column("slot").to_numpy()), got.column("n").to_numpy())
    return TextModel(langs, np.log(counts / counts.sum(1, keepdims=True)))


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, and the tempered log-likelihoods ll, greatest zero."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll, declared = [], []
            for h in b.column("html"):
                raw = h.as_py() or ""
                x = model.log_likelihood(visible_text(raw))
                ll.append(x - x.max())
                m = _LANG.search(raw)
                declared.append(m[1].lower() if m and m[1].lower() in model.langs else "")
            if ll:
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(declared), pa.array(ll, pa.list_(pa.float64()))], ["page_id", "host", "declared", "ll"])

    host, _ = split_url(F.col("url"))
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), "html")
    out = thin.mapInArrow(of, "page_id long, host string, declared string, ll array<double>")
    return out.select("*", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"))


def _posterior(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    e = [F.exp(x - top) for x in logs]
    return [x / sum(e[1:], e[0]) for x in e]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang (by text alone), declared."""
    model = fit_text(docs)
    k = len(model.langs)
    if not k:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit("").alias("declared"))
    seen = materialise(text_evidence(pages, model), "language-evidence")
    own = _posterior([F.get("ll", F.lit(j)) for j in range(k)])
    seen = seen.select("*", *(p.alias(f"p{j}") for j, p in enumerate(own)))
    sums = lambda name: seen.groupBy(F.col(name).alias(f"{name}_key")).agg(*(F.sum(f"p{j}").alias(f"{name}{j}") for j in range(k)))
    total = seen.agg(*(F.coalesce(F.sum(f"p{j}"), F.lit(0.0)).alias(f"t{j}") for j in range(k))).first()
    n = sum(total)
    with_counts = seen
    for name in ("host", "domain", "suffix", "declared"):
        with_counts = with_counts.join(sums(name), F.col(name) == F.col(f"{name}_key"))
    rest = lambda name, j: F.greatest(F.col(f"{name}{j}") - F.col(f"p{j}"), F.lit(0.0))  # noqa: E731  without the page itself
    whole = lambda name: sum((rest(name, j) for j in range(1, k)), rest(name, 0))
    logs = []
    for j in range(k):
        everywhere = F.lit((total[j] + 1) / (n + k))
        domain = (rest("domain", j) + DOMAIN_WEIGHT * everywhere) / (whole("domain") + DOMAIN_WEIGHT)
        host = (rest("host", j) + HOST_WEIGHT * domain) / (whole("host") + HOST_WEIGHT)
        says = F.when(F.col("declared") == "", 0.0).otherwise(F.log((rest("declared", j) + 1) / (F.lit(total[j]) - F.col(f"p{j}") + k + 1)))
        ends = F.log((rest("suffix", j) + 1) / (F.lit(total[j]) - F.col(f"p{j}") + 2))
        logs.append(F.get("ll", F.lit(j)) + F.log(host) + says + ends)
    fused = with_counts.select("page_id", "declared", "p0", *(f"p{j}" for j in range(1, k)), F.array(*_posterior(logs)).alias("post"))
    name = lambda a: F.get(F.array(*map(F.lit, model.langs)), (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return fused.select("page_id", name(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), name(F.array(*(f"p{j}" for j in range(k)))).alias("text_lang"), "declared")
