"""Document quality by regularised quadratic discriminant analysis.

Statistics of a text (shares of kinds of characters, repetition, word lengths, length)
are transformed to logs of smoothed rates. For either class, the mean and a shrunk
covariance describe them; a text's score is the logistic of the difference of the two
Gaussian log-densities, taken from Mahalanobis distances by Cholesky factors that are
worked out once, when the model is fitted.

Defined results: a null text counts as empty and is scored like one; repeated rows and
ids are scored alike; an empty table gives no rows; labels that are null or neither 0
nor 1 are not learned from, and of several labels of one id the smallest counts; where
a class has no labelled text at all, every score is the other class's (0.5 without any
labels). Further columns are not read, or are kept as they are (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settle, ship, slices, text_of
from .shingles import AT_ONCE, Words

#: Labelled documents that a model is fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Scores from here on are predictions of good quality.
THRESHOLD = 0.7

_KINDS = ("upper", "digit", "symbol", "shout", "bar", "line", "point", "letter", "beyond")
#: For each byte, a 1 at its kind.
_KIND = np.zeros((256, len(_KINDS)), np.int64)
for _i, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~_=+<>\\{}[]`", b"!", b"|", b"\n", b".,;:?'\"()-/", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256)))
):
    _KIND[list(_chars), _i] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of counts for each text: bytes, words, distinct words, words like the one before, letters of words, then bytes by kind."""
    n = len(texts)
    words = Words(texts)
    per_doc = words.per_doc()
    spelled = np.zeros((n, 256), np.int64)
    for i, (start, size) in enumerate(zip(words.begin.tolist(), words.lengths.tolist(), strict=True)):
        for at in range(start, start + size, AT_ONCE):
            spelled[i] += np.bincount(words.data[at : min(at + AT_ONCE, start + size)], minlength=256)
    again = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((words.hash, words.doc))
    h, d = words.hash[order], words.doc[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    return np.column_stack(
        [
            words.lengths,
            per_doc,
            np.bincount(d[first], minlength=n),
            np.bincount(words.doc[1:][again], minlength=n),
            np.bincount(words.doc, weights=words.size, minlength=n),
            spelled @ _KIND,
        ]
    ).astype(np.float64)


@dataclass
class Discriminant:
    """A fitted model; small, and sent to the executors with the code."""

    rates: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    priors: np.ndarray
    smoothing: float

    @staticmethod
    def fit(counts: np.ndarray, labels: np.ndarray, pooled: float = 0.3, diagonal: float = 0.2, smoothing: float = 10.0) -> Discriminant:
        """``pooled``: share of the common covariance in a class's; ``diagonal``: share of its diagonal."""
        empty = Discriminant(_rates(counts), np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), smoothing)
        seen = np.array([(labels == k).sum() for k in (0, 1)], float)
        if not seen.all():
            empty.priors = seen
            return empty
        x = empty.features(counts)
        scatter = [np.cov(x[labels == k].T, bias=True) for k in (0, 1)]
        common = (scatter[0] * seen[0] + scatter[1] * seen[1]) / seen.sum()
        factors = []
        for s in scatter:
            s = (1 - pooled) * s + pooled * common
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
            factors.append(np.linalg.cholesky(s))
        return Discriminant(empty.rates, np.array([x[labels == k].mean(0) for k in (0, 1)]), np.array(factors), seen, smoothing)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Logs of rates, drawn towards the corpus's rate where a text gives little evidence; and the log of the length."""
        size, words = counts[:, :1], counts[:, 1:2]
        weight = np.concatenate([np.full(3, self.smoothing), np.full(counts.shape[1] - 5, 5 * self.smoothing)])
        of = np.concatenate([np.repeat(words, 3, 1), np.repeat(size, counts.shape[1] - 5, 1)], 1)
        upper = np.concatenate([counts[:, 4:5], counts[:, 2:4], counts[:, 5:]], 1)
        return np.concatenate([np.log((upper + weight * (self.rates + 0.002)) / (of + weight)), np.log1p(words)], 1)

    @cached_property
    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """The inverses of the Cholesky factors, and each class's log of prior over root of determinant."""
        inverse = np.array([np.linalg.inv(f) for f in self.factors])
        return inverse, np.log(self.priors) - np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """How likely label 1 is."""
        if not self.means.size:
            return np.full(len(counts), self.priors[1] / self.priors.sum() if self.priors.sum() else 0.5)
        x = self.features(counts)
        inverse, constant = self.whitening
        density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, inverse, constant, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def _rates(counts: np.ndarray) -> np.ndarray:
    """Over all texts: letters, distinct words and repeats for each word, and kinds for each byte."""
    total = counts.sum(0)
    return np.concatenate([[total[4], total[2], total[3]] / np.maximum(total[1], 1), total[5:] / np.maximum(total[0], 1)])


def is_held_out(id_col: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _counts_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([row for texts in _encoded(part) for row in statistics(texts)], dtype=object)
        settle()

    return count(text)


def _encoded(part: pd.Series) -> Iterator[list[bytes]]:
    texts = [t.encode("utf-8", "surrogatepass") for t in part]
    for start, end in slices(map(len, texts)):
        yield texts[start:end]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Fit on labelled documents that aren't held out, ``fit_rows`` at most, with the smallest hashes of their ids."""
    ship(docs.sparkSession)
    ident = F.col(id_col).cast("long")
    chosen = (
        labels.select(ident.alias("label_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~is_held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(fit_rows)
    )
    # fit_rows rows at most: a broadcast of proven size.
    rows = docs.select(ident.alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = rows.select("label", _counts_column(F.col("text")).alias("counts")).limit(4 * fit_rows).toPandas()
    counts = np.array(found["counts"].tolist(), np.float64).reshape(len(found), len(_KINDS) + 5)
    # In one order, whatever order the rows came in: sums of floats depend on it.
    order = np.lexsort((*counts.T, found["label"].to_numpy(int)))
    return Discriminant.fit(counts[order], found["label"].to_numpy(int)[order])


def score_column(model: Discriminant, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            scores = [model.score(statistics(texts)) for texts in _encoded(part)]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))
        settle()

    return score(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns. Nothing is shuffled."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    name = free_name(docs, "score")
    return docs.withColumn(name, score_column(model, F.col(text_col))).filter(F.col(name) >= threshold).drop(name)
