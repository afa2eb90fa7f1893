"""Quality by positive-unlabelled learning.

Trusted positives are the texts labelled good; the unlabelled texts are a sample of all documents, labels unread. With
p the share of good texts, a linear model g on surface features minimises the non-negative unbiased risk

    p E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p E_pos[loss(-g)])

with the logistic loss; where the second term would turn negative, the step goes against it, as over-fitting shows there.
Texts labelled bad are never used, for p neither. p is estimated from the same two samples (best-bin estimation): one half
of each fits a classifier of positive against unlabelled texts; on the other half, for every score c that a positive text
reaches, the share of unlabelled texts at c or above over that of positive texts is at least p, but for chance. The ratio
is taken where it is smallest with its margin of chance, so where few bad texts score like good ones. The fit sees the whole texts of bounded samples; every text is
scored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlework.llm.common import carried, documents_by_id, held_out, labelled, logistic, slices, text_of

#: Bounds of the samples the fit sees.
POSITIVE_ROWS, UNLABELLED_ROWS = 20_000, 40_000
STEPS, RATE, RIDGE = 800, 0.05, 1e-4
#: Chance that the margins of the estimated prior allow for, and the bounds of the prior.
DOUBT, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.01, 0.99
_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
N_FEATURES = len(_MARKS) + 13


def features(text: str) -> np.ndarray:
    """Surface features of a whole text: shares of marks and kinds of letters, lengths and repetition."""
    out = np.zeros(N_FEATURES, np.float32)
    data = text.encode("utf-8", "replace")
    if not data:
        return out
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, k = len(data), len(_MARKS)
    out[:k] = np.sqrt(count[_MARKS] / n)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    out[k] = np.log1p(n)
    out[k + 1] = upper / max(1, upper + lower)
    out[k + 2] = np.sqrt(count[48:58].sum() / n)
    out[k + 3] = count[32] / n
    out[k + 4] = np.sqrt(count[10] / n)
    out[k + 5] = count[128:].sum() / n
    words = data.split()
    if not words:
        return out
    w = len(words)
    length = np.fromiter(map(len, words), np.int64, w)
    kinds = len(set(words))
    out[k + 6] = np.log1p(w)
    out[k + 7] = kinds / w
    out[k + 8] = np.log1p(kinds) / np.log1p(w)
    out[k + 9] = sum(map(operator.eq, words, words[1:])) / w
    out[k + 10] = length.mean() / 10
    out[k + 11] = length.std() / 10
    lines = data.split(b"\n")
    out[k + 12] = len(set(lines)) / len(lines)
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), np.float32)


def expanded(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, their sizes, and the constant."""
    z = np.clip((rows - mean) / spread, -8, 8)
    return np.column_stack([z, np.abs(z), np.ones(len(z))])


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, spread) by full-batch Adam on the non-negative risk."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, spread = both.mean(0), both.std(0) + 1e-3
    xp, xu = expanded(positive, mean, spread), expanded(unlabelled, mean, spread)
    w, m, v = np.zeros(xp.shape[1]), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, STEPS + 1):
        gp, gu = xp @ w, xu @ w
        up = prior * (xp.T @ (sigmoid(gp) - 1)) / len(xp)
        rest = loss(-gu).mean() - prior * loss(-gp).mean()
        down = xu.T @ sigmoid(gu) / len(xu) - prior * (xp.T @ sigmoid(gp)) / len(xp)
        grad = (up + down if rest >= 0 else -down) + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, mean, spread


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among unlabelled ones, from features of good and of unlabelled texts alone."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, spread = both.mean(0), both.std(0) + 1e-3
    xp, xu = (expanded(x, mean, spread)[:, :-1] for x in (positive, unlabelled))
    w = logistic(np.concatenate([xp[::2], xu[::2]]), np.repeat([1.0, 0.0], [len(xp[::2]), len(xu[::2])]))
    sp, su = (np.sort(w[0] + x[1::2] @ w[1:]) for x in (xp, xu))
    at_or_above = lambda found: 1 - np.searchsorted(found, sp) / len(found)
    p, u = at_or_above(sp), at_or_above(su)
    margin = sum(np.sqrt(np.log(4 / DOUBT) / (2 * n)) for n in (len(sp), len(su)))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], LEAST_PRIOR, MOST_PRIOR))


def score(rows: np.ndarray, w: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(expanded(rows, mean, spread) @ w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, spread): the classifier from documents and the labels that may be learned from."""
    usable = labelled(labels, "quality")
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))

    def sample(ids: DataFrame, most: int) -> np.ndarray:
        """Features of the texts of the bounded sample with the smallest hashes."""
        chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = _matrix(batch.column("text").to_pylist())
                yield pa.record_batch({"f": pa.array(list(f), pa.list_(pa.float32()))})

        got = documents_by_id(docs, chosen).select("text").mapInArrow(run, "f array<float>").toArrow()["f"].to_pylist()
        return np.array(got, np.float32).reshape(-1, N_FEATURES)

    positive = sample(learn.join(usable.where("y = 1"), "doc_id", "left_semi"), POSITIVE_ROWS)
    if not len(positive):
        return np.zeros(2 * N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES)
    unlabelled = sample(learn, UNLABELLED_ROWS)
    return minimise(positive, unlabelled, estimated_prior(positive, unlabelled) if prior is None else prior)


def _scored(rows: DataFrame, kept: str, kind: T.DataType, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(kept, score) of every row of (kept, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "text"):
                yield pa.record_batch({kept: batch.column(kept)[start : start + len(texts)], "score": score(_matrix(texts), *fitted)})

    return rows.select(kept, "text").mapInArrow(run, T.StructType([T.StructField(kept, kind), T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, prior: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    docs: doc_id, text; labels: doc_id, quality. Labels of ids whose crc32 modulo 3 is 1 are never read. prior: the share
    of good texts, by default estimated from texts labelled good and unlabelled ones. A null or empty text has all features 0
    and is scored like any other; a null doc_id is scored, not learned from; of repeated labels of an id the larger counts;
    repeated documents are scored each. Without a positive label all scores are 0.5. Other columns are ignored.
    """
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    out = _scored(rows, "doc_id", T.LongType(), fit(docs, labels, prior))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns as they were."""
    rows, kind = carried(docs)
    return _scored(rows, "row", kind, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")
