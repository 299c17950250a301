"""Quality classification by a regularised quadratic discriminant.

Documents become a short vector of transformed text statistics.  For each class the
mean and a covariance, shrunk towards the pooled one and a multiple of the identity,
are estimated; a score is the logistic of the difference of the classes' log
densities, whose Mahalanobis terms come from cached Cholesky factors.

Scale.  Statistics are computed once per document and written to the shared folder;
training reduces them to sums of first and second order on the executors (a fixed
number of rows whatever the input), and scoring is a row-local product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .langid import held_out

#: Shrinkage of a class's covariance to the pooled one, and of that to the identity.
TO_POOLED, TO_IDENTITY = 0.5, 0.05

FEATURES = (
    "log_words", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "word_chars", "line_words",
    "distinct_words", "distinct_lines", "short_words", "other_letters", "byte_bits", "top_word",
)

_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 10, 11, 12, 13, 32]], _KIND[128:] = 1, 2, 3, 4, 5


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, ``FEATURES`` in order; all finite."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    low, up, digit, blank, beyond = (int(counts[_KIND == k].sum()) for k in range(1, 6))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, shown, letters = len(words), len(data) - blank, low + up + beyond
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = lambda a, b: a / b if b else 0.0
    p = counts[counts > 0] / max(len(data), 1)
    root = math.sqrt
    return [
        math.log1p(n),
        root(share(up, letters)),
        root(share(digit, shown)),
        root(share(shown - letters - digit - int(counts[[33, 39, 44, 45, 46, 63, 124]].sum()), shown)),
        root(share(int(counts[124]), n)),
        root(share(int(counts[33] + counts[63]), n)),
        root(share(int(counts[46]), n)),
        root(share(int(counts[44]), n)),
        math.log1p(share(shown, n)),
        math.log1p(share(n, len(lines))),
        share(len(seen), n) * math.log1p(n),
        share(len(set(lines)), len(lines)),
        share(sum(c for w, c in seen.items() if len(w) <= 3), n),
        root(share(beyond, letters)),
        float(-(p * np.log2(p)).sum()),
        root(share(max(seen.values(), default=0), n)),
    ]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, held_out, x``: the id, its fold and the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["id", "held_out", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, held_out boolean, x array<double>")


@dataclass
class QuadraticModel:
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    prior: float

    @staticmethod
    def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> QuadraticModel:
        """Learn from all rows of ``labelled`` (``y`` 0 or 1, ``x`` statistics)."""
        d = len(FEATURES)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 1 + d + d * d))
            for batch in batches:
                y = np.array(batch.column(0).to_pylist(), dtype=int)
                x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(len(y), d)
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            y, place = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(place), pa.array(total.ravel())], ["y", "place", "v"])

        parts = labelled.select("y", "x").mapInArrow(sums, "y long, place long, v double")
        total = np.zeros((2, 1 + d + d * d))
        for r in parts.groupBy("y", "place").agg(F.sum("v").alias("v")).collect():
            total[r["y"], r["place"]] = r["v"]
        n = total[:, 0]
        if min(n) < 2:  # a class is missing: the share of the labels is the score
            return QuadraticModel([], [], [], float((n[1] + 1) / (n.sum() + 2)))
        means = [total[k, 1 : 1 + d] / n[k] for k in (0, 1)]
        spread = [total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
        # statistics differ in scale: the identity is that of the standardised ones
        scale = np.diag(np.diag(pooled).clip(1e-6))
        factors = []
        for s in spread:
            mixed = (1 - to_pooled) * s + to_pooled * pooled
            factors.append(np.linalg.cholesky((1 - to_identity) * mixed + to_identity * scale))
        offsets = [math.log(n[k] / n.sum()) - float(np.log(np.diag(factors[k])).sum()) for k in (0, 1)]
        return QuadraticModel(means, [np.linalg.inv(f) for f in factors], offsets, 0.5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of ``x``."""
        if not self.means:
            return np.full(len(x), self.prior)
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``.

    Learns from the labels of documents that are not held out; only the text is input
    to a score.  Labels other than 0 and 1 are ignored, several labels of one id count
    each.  Null and empty texts have statistics (zeros) and so a score.  If a class has
    fewer than two rows to learn from, every score is (ones + 1) / (labels + 2).  Rows
    with the same id are scored each; an empty table gives an empty result.
    """
    rows = materialize(with_statistics(docs, id_col, text_col), "statistics")
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("y"))
    model = QuadraticModel.fit(rows.filter(~F.col("held_out")).join(known, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"],
            )

    return rows.select("id", "held_out", "x").mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")
