"""Language by nearest centroid.

A text becomes a TF-IDF vector of byte n-grams (one to three bytes of its lower-cased letters, in a fixed number of
slots), scaled to length 1. Each language has several centroids, found by spherical k-means; a text gets the language of
the centroid with the largest cosine, and is marked as rejected where that cosine is below a limit taken from the
language's own texts. Document frequencies cover all texts that may be learned from. Centroids are fitted on a bounded
sample of each language, inside the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlework.llm.common import documents_by_id, held_out, slices, text_of

SLOTS = 4093
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
#: Share of a language's sample whose cosine lies below its limit of rejection.
REJECTED_SHARE = 0.01
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _frequencies(texts: list[str]) -> np.ndarray:
    """Square-rooted counts per text and slot."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for i, text in enumerate(texts):
        data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
        a = np.frombuffer(data, np.uint8).astype(np.int32)
        if len(a) < 3:
            continue
        two = a[:-1] * 251 + a[1:]
        three = two[:-1] * 239 + a[2:]
        out[i] = np.bincount(a, minlength=SLOTS) + np.bincount((two + 7) % SLOTS, minlength=SLOTS) + np.bincount(three % SLOTS, minlength=SLOTS)
    return np.sqrt(out, out=out)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = _frequencies(texts) * idf
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many texts have each slot; the last slot number counts texts."""
    seen, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for _, texts in slices(batch, "text", 1 << 19):
            for i in range(0, len(texts), 256):
                seen += (_frequencies(texts[i : i + 256]) > 0).sum(0)
            n += len(texts)
    yield pa.record_batch({"slot": np.arange(SLOTS + 1, dtype=np.int32), "n": np.append(seen, n)})


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starting rows; centroids of length 1 and each row's cosine."""
    picks = [0]
    near = x @ x[0]
    while len(picks) < min(k, len(x)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    centre = x[picks]
    for _ in range(rounds):
        of = (x @ centre.T).argmax(1)
        sums = np.stack([x[of == j].sum(0) if (of == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(1e-12, np.sqrt((sums * sums).sum(1, keepdims=True)))
    return centre, (x @ centre.T).max(1)


def predict_language(docs: DataFrame, parts: int = 5, kept_back: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per row of docs.

    docs: doc_id, text, lang. Rows whose crc32 of doc_id modulo `parts` is `kept_back`, and null languages, are never
    learned from. score: the largest cosine. A text that is null or has no letter gets `und`, score 0 and rejected = true;
    so does every text if no language could be learned. Ties go to the language first in order. A null doc_id is
    predicted, not learned from. Repeated documents are treated each. Other columns are ignored.
    """
    spark = docs.sparkSession
    learn = text_of(docs, "doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, kept_back))
    seen = learn.select("text").mapInArrow(_present, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(SLOTS + 1)
    if seen.num_rows:
        count[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    idf = (np.log((1 + count[-1]) / (1 + count[:-1])) + 1).astype(np.float32)

    # ranks only ids, so the limit applies before any text moves; the sample is bounded per language
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id")
    chosen = learn.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_PER_LANGUAGE)
    sample = documents_by_id(docs, chosen).select("lang", "place", "text")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        texts = [t for t in group["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        centre, cosine = cluster(vectors(texts, idf), CENTROIDS)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tolist() for c in centre], "least": float(np.quantile(cosine, REJECTED_SHARE))})

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, centre array<float>, least double").toPandas()
    fitted = fitted.sort_values("lang", kind="stable")
    names = sorted(set(fitted["lang"]))
    centre = np.stack([np.asarray(c, np.float32) for c in fitted["centre"]]) if names else np.zeros((0, SLOTS), np.float32)
    of = np.array([names.index(x) for x in fitted["lang"]], np.int64)
    least = np.array([fitted["least"][fitted["lang"] == x].iloc[0] for x in names])
    model = spark.sparkContext.broadcast((idf, centre, of, names, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centre, of, names, least = model.value
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, part in slices(batch, "text", 1 << 19):
                for i in range(0, len(part), 256):
                    texts = part[i : i + 256]
                    ok = np.array([has_letter(t) for t in texts]) & bool(names)
                    best, cosine = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                    if names:
                        near = vectors(texts, idf) @ centre.T
                        best, cosine = of[near.argmax(1)], np.clip(near.max(1), 0, 1)
                    yield pa.record_batch(
                        {
                            "doc_id": ids[begin + i : begin + i + len(texts)],
                            "lang_pred": pa.array([names[b] if good else "und" for b, good in zip(best, ok)], pa.string()),
                            "score": np.where(ok, cosine, 0.0).astype(np.float64),
                            "rejected": np.array([not good or c < least[b] for b, c, good in zip(best, cosine, ok)], bool),
                        }
                    )

    out = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out("doc_id", parts, kept_back).alias("held_out"), "lang_pred", "score", "rejected")
