"""Runs of texts ask and are answered alike, however their rows come in batches."""

import numpy as np
import pyarrow as pa
import pytest

from candlework.llm import toxicity


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_runs_do_not_depend_on_batches(monkeypatch, size):
    monkeypatch.setattr(toxicity, "TEXTS", 50)
    texts = ["x" * n for n in (10, 0, 70, 49, 1, 1, 30, 30, 8, 200, 0)]
    rows = pa.table({"text": texts, "at": np.arange(len(texts))})
    runs = [(r, pa.Table.from_batches(h)) for h, r in toxicity._runs(iter(rows.to_batches(size)))]
    whole = [r for _, r in toxicity._runs(iter(rows.to_batches()))]
    assert [r for r, _ in runs] == whole and sum(whole, []) == texts
    assert all(t["text"].to_pylist() == r for r, t in runs)
    assert not list(toxicity._runs(iter([])))


def test_small_runs_score_alike(spark, monkeypatch):
    """Whole tables asked for in one run or in many give the same scores, with few items broadcast."""
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 40)) + (" vile scum" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "CACHE", 10)
    want = dict(toxicity.toxicity_scores(docs, labels).select("doc_id", "score").collect())
    monkeypatch.setattr(toxicity, "WORDS", 50)
    got = dict(toxicity.toxicity_scores(docs.withColumn("row", docs.text), labels).select("doc_id", "score").collect())
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
