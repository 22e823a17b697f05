"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (logs of smoothed
counts and rates). One aggregation over the labelled rows gives each class's
count, sum and sum of outer products; the class covariances are
shrunk towards the pooled one and towards a multiple of the identity, factored
by Cholesky once, and every document is scored in vectors by the
difference of the two log densities, whose Mahalanobis terms are solved with the
cached factors. Nothing but those sums, whose size is fixed, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

FEATURES = (
    "words", "distinct_words", "chars_a_word", "upper", "symbols", "stops", "digits", "pipes",
    "long_words", "short_words", "distinct_lines", "words_a_line", "repeats", "symbol_words", "distinct_tails",
)

_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL = (np.zeros(256) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_STOP[[ord(c) for c in ".,;:?!"]] = 1
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]|!"]] = 1
_LEAD = np.zeros(256)
_LEAD[0xC0:] = 1
_BYTES = np.stack([_UPPER, _LOWER + _LEAD, _DIGIT, _STOP, _SYMBOL], axis=1)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; null counts as empty.

    Rates are smoothed by a few pseudo-counts, so that short and empty texts stay
    near the average instead of jumping between 0 and 1.
    """
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, lower, digits, stops, symbols = (counts @ _BYTES).tolist()
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, letters = len(words), upper + lower
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeats = sum(map(eq, words, words[1:]))
    symbol_words = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,;:?")) if symbols else 0
    tails = len({w[-3:] for w in words})
    chars = letters + digits + stops + symbols
    rate = lambda x, of, prior, weight=20.0: np.log((x + prior * weight) / (of + weight))
    return [
        np.log1p(n),
        np.log((distinct + 1) / (n + 1)),
        np.log((letters + 50) / (n + 10)),
        rate(upper, letters, 0.03),
        rate(symbols, chars, 0.005),
        rate(stops, n, 0.15),
        rate(digits, chars, 0.005),
        rate(counts[124], n, 0.01),
        rate(int((lengths > 12).sum()), n, 0.05),
        rate(int((lengths < 4).sum()), n, 0.3),
        np.log((len(set(lines)) + 1) / (len(lines) + 1)),
        np.log((n + 20) / (len(lines) + 1)),
        rate(repeats, n, 0.01),
        rate(symbol_words, n, 0.01),
        np.log((tails + 1) / (distinct + 1)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``x`` array<double>) for each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "x": [statistics(t) for t in pdf["_text"]]})

    rows = docs.select(id_text(id_col), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id string, x array<double>").select(id_back(docs, id_col), "x")


@dataclass
class Discriminant:
    """Two Gaussian classes; index 1 is the good one."""

    means: np.ndarray  # 2 x d
    factors: np.ndarray  # 2 x d x d: inverses of the lower Cholesky factors
    log_dets: np.ndarray
    log_priors: np.ndarray
    scale: np.ndarray  # d: pooled deviations; statistics are divided by them first

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of ``x``."""
        z = x / self.scale
        density = [self.log_priors[k] - 0.5 * (self.log_dets[k] + (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1)) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, pooled: float = 0.1, ridge: float = 0.02, dim: int = len(FEATURES)) -> Discriminant | None:
    """A :class:`Discriminant` from rows of (x, ``label`` 0 or 1).

    A class covariance becomes (1 - pooled) its own + pooled the common one, then
    (1 - ridge) of that + ridge its mean variance on the diagonal. Rows without a label don't count; None if a class has no rows.
    """
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    x = F.col("x")
    moments = labelled.filter(F.col("label").isin(0, 1)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(dim)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    )
    found = {int(r["label"]): r for r in moments.collect()}  # two rows
    if len(found) < 2:
        return None
    n = np.array([found[k]["n"] for k in (0, 1)], float)
    means = np.array([[found[k][f"s{i}"] for i in range(dim)] for k in (0, 1)]) / n[:, None]
    covs = np.empty((2, dim, dim))
    for k in (0, 1):
        for i, j in pairs:
            covs[k, i, j] = covs[k, j, i] = found[k][f"p{i}_{j}"] / n[k] - means[k, i] * means[k, j]
    common = (covs * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(common), 1e-6))
    means, covs, common = means / scale, covs / np.outer(scale, scale), common / np.outer(scale, scale)
    covs = (1 - pooled) * covs + pooled * common
    covs = np.stack([(1 - ridge) * c + ridge * max(np.trace(c) / dim, 1e-6) * np.eye(dim) for c in covs])
    lower = np.linalg.cholesky(covs)
    log_dets = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, np.linalg.inv(lower), log_dets, np.log(n / n.sum()), scale)


def score(feats: DataFrame, model: Discriminant | None, id_col: str = "doc_id") -> DataFrame:
    """(id, ``score``, ``predicted``) for rows of (id, x); without a model every score is 0.5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"]) if len(pdf) else np.empty((0, len(FEATURES)))
            scores = model.scores(x) if model else np.full(len(pdf), 0.5)
            yield pd.DataFrame({"_id": pdf["_id"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)})

    return feats.select(id_text(id_col), "x").mapInPandas(run, "_id string, score double, predicted int").select(id_back(feats, id_col), "score", "predicted")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None) -> DataFrame:
    """(id, ``score`` 0 to 1, ``predicted``) for every row of ``docs``.

    ``labels`` has (id, label); only those where ``train`` (a condition on the
    id; all by default) holds are learned from. Null and empty texts have statistics and so a score;
    repeated rows score alike; labels that are null, unknown or of absent documents don't count, nor do ids that have both labels; a label
    that is repeated counts once. If a class has no rows, every score is 0.5.
    """
    feats = cut(features(docs, id_col, text_col))
    chosen = labels.select(F.col(id_col), F.col(label_col).alias("label"))
    chosen = chosen.filter(train) if train is not None else chosen
    chosen = chosen.filter(F.col("label").isin(0, 1)).groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    model = fit(feats.join(chosen.filter("label = _most").drop("_most"), id_col))
    return score(feats, model, id_col)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` predicted good, with all their columns."""
    good = quality_scores(docs, labels, id_col, text_col, **options).filter("predicted = 1").select(F.col(id_col).alias("_good_id")).distinct()
    return docs.join(good, docs[id_col].eqNullSafe(good["_good_id"]), "left_semi")
