"""URL filter: rules first, else gradient-boosted trees on lexical features.

The trees are trained on labelled URLs. Features: lengths, depth, digit share, entropy, parameters, hyphens, and
statistics of the host's last label and last two labels (how frequent they are among all URLs, and the smoothed
share of blocked among the labelled ones), counted by grouped aggregation into a fixed number of hash slots.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the trees' verdict on
the empty url; with no labelled URL the trees allow everything; repeated rows have repeated results; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed values: (rule, verdict) of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SLOTS = 4096
N_FEATURES = 13


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_slots(host: str) -> tuple[int, int]:
    labels = host.rsplit(".", 2)
    return zlib.crc32(labels[-1].encode("utf-8", "surrogatepass")) % SLOTS, zlib.crc32(".".join(labels[-2:]).encode("utf-8", "surrogatepass")) % SLOTS


_DIGITS = re.compile(r"\d+")


def host_of(url: str) -> str:
    rest = url.partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def url_features(url: str | None, stats: np.ndarray) -> list[float]:
    """stats: for each kind of suffix and slot, log count and blocked share."""
    u = url or ""
    host = host_of(u)
    rest = u.partition("://")[2][len(host) :]
    path, _, query = rest.partition("#")[0].partition("?")
    n = max(1, len(u))
    h = np.bincount(np.frombuffer(u.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    p = h[h > 0] / max(1, h.sum())
    digits = [len(x) for x in _DIGITS.findall(u)]
    s1, s2 = suffix_slots(host)
    return [len(u), len(host), host.count("."), path.count("/"), sum(digits) / n, max(digits, default=0), float(-(p * np.log2(p)).sum()), query.count("&") + bool(query), host.count("-"), *stats[0, s1], *stats[1, s2]]


@dataclass
class Boosted:
    """Trees of a fixed depth: feature and cut of each inner node in heap order, and the leaf values."""

    base: float
    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += v[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 5.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    inner = 2**depth - 1
    fs, cs, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                best = 1e-6
                if len(at) > 20:
                    whole = g[at].sum() ** 2 / (h[at].sum() + l2)
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.bincount(code[at, j], g[at], len(e) + 1).cumsum()[:-1]
                        hl = np.bincount(code[at, j], h[at], len(e) + 1).cumsum()[:-1]
                        gain = gl**2 / (hl + l2) + (g[at].sum() - gl) ** 2 / (h[at].sum() - hl + l2) - whole
                        if gain.max() > best:
                            best = gain.max()
                            f[k], c[k] = j, e[int(gain.argmax())]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        z += v[leaf]
        fs.append(f)
        cs.append(c)
        vs.append(v)
    return Boosted(base, depth, np.array(fs), np.array(cs), np.array(vs))


def _slot_counts(urls: DataFrame, label: str | None) -> np.ndarray:
    """For each kind of suffix and slot: how many urls, and the sum of `label`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            slots = np.array([suffix_slots(host_of(u.as_py() or "")) for u in b.column("url")], np.int64).reshape(-1, 2) + [0, SLOTS]
            at = slots.T.reshape(-1)
            n, s = np.bincount(at, minlength=2 * SLOTS), np.bincount(at, np.tile(y, 2), 2 * SLOTS)
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on]), pa.array(s[on])], ["slot", "n", "s"])

    rows = urls.select("url", (F.col(label) if label else F.lit(0)).cast("double").alias("y")).mapInArrow(of, "slot long, n long, s double")
    got = rows.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()  # at most 2 * SLOTS rows
    out = np.zeros((2, 2 * SLOTS))
    out[:, got.column("slot").to_numpy()] = [got.column("n").to_numpy(), got.column("s").to_numpy()]
    return out.reshape(2, 2, SLOTS)


def fit_urls(urls: DataFrame, labelled: DataFrame, *, max_rows: int = 50_000) -> tuple[Boosted | None, np.ndarray]:
    """urls: all, for the frequencies. labelled: url and blocked (0 or 1); of these at most about `max_rows` train the trees."""
    labelled = labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where("url is not null and blocked is not null")
    seen, marked = _slot_counts(urls.select("url"), None)[0], _slot_counts(labelled, "blocked")
    total = marked[0, 0].sum()
    share = marked[1, 0].sum() / total if total else 0.0
    stats = np.stack([np.log1p(seen), (marked[1] + 20 * share) / (marked[0] + 20)], axis=2)
    if not total:
        return None, stats
    sample = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, max_rows / total) * (1 << 30))).orderBy("url", "blocked").toArrow()
    y = sample.column("blocked").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None, stats
    x = np.array([url_features(u.as_py(), stats) for u in sample.column("url")], float)
    return boost(x, y), stats


def judge(pages: DataFrame, labelled: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score: the trees' probability that the url is to be blocked."""
    model, stats = fit_urls(pages, labelled)

    @F.arrow_udf("double")
    def score(url: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(url)))
        return pa.array(model.probability(np.array([url_features(u.as_py(), stats) for u in url], float).reshape(-1, N_FEATURES)))

    host, path = split_url(F.col("url"))
    thin = pages.select("page_id", host.alias("host"), path.alias("path"), score("url").alias("score"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    return thin.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
