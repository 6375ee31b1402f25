"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows, the unlabelled side is web text as it comes, and the class prior is
estimated from the two: the ratio of tail masses of a positive-against-unlabelled score, on rows it was not fitted on. The model is
additive over binned text statistics, so a score is a sum of table entries and a logistic.

Defined results: a null text counts as empty and gets a score; a null doc_id is never held out; repeated rows get
the same score; without trusted positives every score is 1 (nothing is rejected); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, tidy

BINS = 12
N_FEATURES = 14
_BYTE = np.arange(256)
_UP = (_BYTE >= 65) & (_BYTE <= 90)
_LOW = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_STOP = np.isin(_BYTE, [44, 46])
_HIGH = _BYTE >= 128
_MARK = ~(_UP | _LOW | _DIGIT | _SPACE | _STOP | _HIGH)


def text_features(text: str | None) -> list[float]:
    """Statistics of the whole text; none depends on language, source or id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    b = np.frombuffer(raw, np.uint8)
    h = np.bincount(b, minlength=256).astype(float)
    ascii_letters = h[_UP].sum() + h[_LOW].sum()
    w = raw.split()
    k = max(1, len(w))
    counts = Counter(w)
    top = max(counts.values(), default=1)
    p = h[h > 0] / n
    again = sum(map(eq, w, w[1:]))
    marked = int((_MARK[b[:-1]] & _SPACE[b[1:]]).sum()) + bool(_MARK[b[-1]])
    lines = h[10] + 1
    return [
        np.log1p(n),
        h[_UP].sum() / max(1.0, ascii_letters),
        h[_DIGIT].sum() / n,
        h[_MARK].sum() / n,
        h[_STOP].sum() / n,
        h[_SPACE].sum() / n,
        h[_HIGH].sum() / n,
        (n - h[_SPACE].sum()) / k,
        (k - len(counts)) / k,
        (top - 1) / k,
        again / k,
        -(p * np.log2(p)).sum(),
        marked / k,
        np.log1p(n / lines),
    ]


@dataclass
class QualityModel:
    """edges: per feature the inner bin edges; weights: per feature and bin, the last entry is the bias."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_codes(x, self.edges) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cumulative (thermometer) coding: one 0/1 column for each feature and edge, then a one."""
    return np.concatenate([(x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float64), np.ones((len(x), 1))], axis=1)


def _adam(grad, size: int, rounds: int, rate: float = 0.08) -> np.ndarray:
    """The mean of the last half of the steps."""
    w, m, v, mean = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > rounds // 2:
            mean += w / (rounds - rounds // 2)
    return mean


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled: the ratio of tail masses at the cut where its upper confidence bound is least."""
    cuts = np.quantile(pos, np.linspace(0, 0.9, 181))
    fp = 1 - np.searchsorted(np.sort(pos), cuts, "left") / len(pos)
    fu = 1 - np.searchsorted(np.sort(unl), cuts, "left") / len(unl)
    slack = np.sqrt(np.log(40) / 2 / len(pos)) + np.sqrt(np.log(40) / 2 / len(unl))
    best = int(((fu + slack) / np.maximum(fp, 1e-9)).argmin())
    return float(np.clip(fu[best] / max(fp[best], 1e-9), 0.05, 0.99))


def fit_pu(pos: np.ndarray, unl: np.ndarray, *, rounds: int = 400, l2: float = 1e-4) -> QualityModel:
    """Minimise  prior*R_p(+) + max(0, R_u(-) - prior*R_p(-))  with the logistic loss.

    Where the negative part falls below zero its gradient is turned round, which keeps the risk non-negative."""
    edges = np.quantile(np.concatenate([pos, unl]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    tails = np.quantile(np.concatenate([pos, unl]), [0.005, 0.02, 0.05, 0.95, 0.98, 0.995], axis=0).T
    edges = np.sort(np.concatenate([edges, tails], axis=1), axis=1)
    cp, cu = _codes(pos, edges), _codes(unl, edges)
    reg = np.full(cp.shape[1], l2)
    reg[-1] = 0

    def against(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + reg * w

    # The prior comes from rows that the score was not fitted on: each half is scored by the other's fit.
    halves = []
    for k in (0, 1):
        if min(len(pos), len(unl)) > 1:
            w = _adam(lambda w, k=k: against(cp[k::2], cu[k::2], w), cp.shape[1], rounds // 2)
            halves.append(estimate_prior(cp[1 - k :: 2] @ w, cu[1 - k :: 2] @ w))
    prior = float(np.mean(halves or [0.5]))

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(cp @ w), _sigmoid(cu @ w)
        up = -prior * (cp.T @ (1 - sp)) / len(cp)
        down = cu.T @ su / len(cu) - prior * (cp.T @ sp) / len(cp)
        value = np.logaddexp(0, cu @ w).mean() - prior * np.logaddexp(0, cp @ w).mean()
        return (up + down if value >= 0 else -down) + reg * w

    return QualityModel(edges, _adam(risk, cp.shape[1], rounds), prior)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_features(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("_pos"), b.column("_at")], ["f", "_pos", "_at"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, folds: int = 5) -> QualityModel | None:
    """Fit on at most `max_rows` trusted positives and `max_rows` unlabelled rows, taken by a hash of the id; of rows
    that repeat an id, however many, those with the least hashes of the text.

    Rows of fold 0 of `folds` (crc32 of the id) are left out on both sides."""
    lab = labels.select(F.col("doc_id"), F.col("quality")).where("doc_id is not null and quality = 1").where(fold("doc_id", folds) != 0).select("doc_id").distinct()
    rows = docs.select("doc_id", "text").where("doc_id is not null").where(fold("doc_id", folds) != 0)
    n_lab, n_rows = lab.count(), docs.where("doc_id is not null").count()
    if not n_lab or not n_rows:
        return None
    at = lambda salt, share: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    trusted = lab.where(at(1, max_rows / n_lab)).withColumn("_pos", F.lit(1))
    pos = rows.join(F.broadcast(trusted), "doc_id").select("text", "_pos", F.xxhash64("doc_id", "text").alias("_at"))
    unl = rows.where(at(2, max_rows / n_rows)).select("text", F.lit(0).alias("_pos"), F.xxhash64("doc_id", "text").alias("_at"))
    taken = [x.mapInArrow(tidy(_features_of), "f array<double>, _pos int, _at long").orderBy("_at").limit(max_rows) for x in (pos, unl)]
    got = taken[0].unionByName(taken[1]).toArrow()
    x = np.array(got.column("f").to_pylist(), dtype=np.float64).reshape(-1, N_FEATURES)
    s = got.column("_pos").to_numpy()
    if not (s == 1).any() or not (s == 0).any():
        return None
    return fit_pu(x[s == 1], x[s == 0])


def score_quality(docs: DataFrame, model: QualityModel | None, *, column: str = "quality_score") -> DataFrame:
    """`docs` with a score from 0 to 1 in `column`; the columns of `docs` stay."""
    if model is None:
        return docs.withColumn(column, F.lit(1.0))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([text_features(t.as_py()) for t in text]).reshape(-1, N_FEATURES)))

    return docs.withColumn(column, score("text"))


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    thin = docs.select("doc_id", "text")
    scored = score_quality(thin, fit_quality(thin, labels))
    return scored.select(
        "doc_id",
        ((fold("doc_id", 5) == 0) & F.col("doc_id").isNotNull()).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
