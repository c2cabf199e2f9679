"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each whole text (lengths, shares of character classes, repetition of words and lines) are put on a log or
logit scale. Class means and covariances come from one grouped aggregate over the labelled rows; each covariance is
shrunk towards the pooled one and towards a scaled identity. The score is the logistic of the difference of the two
log densities (Mahalanobis terms through cached Cholesky factors) plus the log prior odds.

Defined results: null text counts as empty, and empty texts are scored like any other; labels with null doc_id or
quality are left out and repeated equal label rows count once; without two labels of each class the score is the share
of label 1 (0.5 without any label); every input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, keep_rows, staged, parts, text_bytes

NAMES = (
    "log_bytes", "log_words", "word_size", "upper", "digit", "blank", "stops", "marks", "symbols", "bars",
    "high_bytes", "word_variety", "line_repeats", "line_size", "marked_words", "top_word",
)


def _classes() -> np.ndarray:
    """Class of each byte value: one row a class of NAMES[3:11], as 0/1 weights."""
    groups = [
        range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), (46, 44), (33, 63, 58, 59, 39, 34, 45, 40, 41),
        (35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126), (124,), range(128, 256),
    ]
    out = np.zeros((len(groups), 256))
    for k, g in enumerate(groups):
        out[k, list(g)] = 1
    return out


_CLASSES = _classes()


def statistics(text: bytes | None) -> np.ndarray:
    """Transformed statistics of a text, in the order of NAMES."""
    data = text or b""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_bytes, n_words = len(data), len(words)
    logit = lambda a, n: np.log((a + 0.5) / (n - a + 0.5))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    marked = sum(n for w, n in seen.items() if w[-2:] in _DOUBLED)
    shares = logit(_CLASSES @ counts, n_bytes)
    return np.array(
        [
            np.log1p(n_bytes),
            np.log1p(n_words),
            np.log1p((n_bytes - n_words) / max(1, n_words)),
            *shares,
            logit(len(seen), n_words),
            logit(len(lines) - len(set(lines)), len(lines)),
            np.log1p(n_words / max(1, len(lines))),
            logit(marked, n_words),
            logit(max(seen.values(), default=0), n_words),
        ]
    )


_DOUBLED = {bytes((b, b)) for b in b"!#$%&*?~^=+-_"}


def document_statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x): transformed statistics of every whole text."""
    kind = pa.list_(pa.float64())

    def run(batches):
        for batch in parts(batches):
            x = [statistics(t) for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, kind)], names=["doc_id", "x"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Class means, Cholesky factors of shrunk covariances and log prior odds."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float):
        counts = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        total = sum(counts.values())
        self.constant = counts[1] / total if total else 0.5
        self.parts = []
        if min(counts.values()) < 2:
            return
        means = {c: moments[c][1] / counts[c] for c in (0, 1)}
        covariances = {c: moments[c][2] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)}
        pooled = sum(counts[c] * covariances[c] for c in (0, 1)) / total
        p = len(pooled)
        for c in (0, 1):
            s = (1 - shrink) * covariances[c] + shrink * pooled
            s = (1 - ridge) * s + ridge * np.eye(p) * max(np.trace(s) / p, 1e-6)
            factor = np.linalg.cholesky(s)
            self.parts.append((means[c], np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(counts[c] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.constant)
        low, high = ((c - 0.5 * (((x - m) @ inverse.T) ** 2).sum(1)) for m, inverse, c in self.parts)
        return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, learn_from, shrink: float = 0.1, ridge: float = 0.01) -> Discriminant:
    """Fit on the labelled rows for which ``learn_from`` holds; what reaches the driver is two rows of moments."""
    p = len(NAMES)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where("doc_id is not null and quality in (0, 1)").where(learn_from).distinct()
    x = [F.col("x")[k] for k in range(p)]
    sums = [F.sum(v).alias(f"s{k}") for k, v in enumerate(x)]
    squares = [F.sum(x[a] * x[b]).alias(f"q{a}_{b}") for a in range(p) for b in range(a + 1)]
    rows = features.join(own, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *sums, *squares).collect()
    moments = {}
    for r in rows:
        q = np.zeros((p, p))
        for a in range(p):
            for b in range(a + 1):
                q[a, b] = q[b, a] = r[f"q{a}_{b}"]
        moments[r["quality"]] = (float(r["n"]), np.array([r[f"s{k}"] for k in range(p)]), q)
    return Discriminant(moments, shrink, ridge)


def held_out():
    """Rows that are kept for testing: crc32 of doc_id as text, modulo 3, is 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.01) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document."""
    features = staged(document_statistics(docs), "statistics")
    model = fit(features, labels, ~held_out(), shrink, ridge)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            scores = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, shrink: float = 0.1, ridge: float = 0.01) -> DataFrame:
    """The documents whose score reaches the threshold. All columns stay unchanged, whatever their names; null and empty texts are
    scored like others, rows that share a doc_id by their own texts; an empty table gives no rows."""
    learnt = document_statistics(docs)
    model = fit(learnt, labels, ~held_out(), shrink, ridge)

    def keeper():
        return lambda texts: (model.score(np.array([statistics(t) for t in texts])) >= threshold).tolist() if texts else []

    return keep_rows(docs, keeper)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
