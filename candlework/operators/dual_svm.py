"""Linear SVM without intercept by block-wise stochastic dual coordinate ascent with averaged updates.

Minimises regularisation / 2 |w|^2 + the mean hinge loss. Equal rows are counted once, by an aggregate that combines
map-side, and share one dual: what the ascent costs grows with the different rows, for codes their combinations. These lie
in chunks of a stored table, each chunk one row with its features, labels, counts and duals, so duals never leave their rows.
A round is one scan without a shuffle: every task starts from the shared weights, ascends one random row at a time through
its chunks, and stores the moves; their average over the tasks, one vector, makes the next weights. The next scan applies the
same average to the duals, so that always w = sum(count * dual * label * x) / (regularisation * rows). The duality gap
bounds how far the weights are from the best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.session import stored

_CHUNKS = "chunk long, n int, copies double, x binary, y binary, count binary, dual binary"
_MOVED = _CHUNKS + ", move binary, task int, hinge double, duals double, change array<double>"


class DualSvm(NamedTuple):
    weights: list[float]
    #: (round, primal, dual, gap) of the weights each round started from, and of the last ones.
    rounds: list[tuple[int, float, float, float]]


def ascend(x: np.ndarray, y: np.ndarray, count: np.ndarray, dual: np.ndarray, w: np.ndarray, scale: float, order: Sequence[int]) -> None:
    """One dual step a row in the given order; changes dual and w in place. The copies of a row step together, each by as
    much. scale: regularisation * rows."""
    norms, signed = count * np.einsum("ij,ij->i", x, x), count * y
    for i in order:
        if norms[i] > 0:
            new = min(1.0, max(0.0, dual[i] + (1 - y[i] * (x[i] @ w)) * scale / norms[i]))
            if new != dual[i]:
                w += (new - dual[i]) * signed[i] / scale * x[i]
                dual[i] = new
        else:  # loses 1 whatever the weights
            dual[i] = 1.0


def order_of(seed: int, round_no: int, chunk: int, n: int, passes: int) -> np.ndarray:
    rng = np.random.default_rng([seed, round_no, chunk])
    return np.concatenate([rng.permutation(n) for _ in range(passes)])


def _chunked(rows: DataFrame, features: Sequence[str], label: Column) -> DataFrame:
    """The different complete rows, with their counts, in chunks of at most one Arrow batch, duals 0."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = rows.select(vector.alias("x"), F.when(label > 0, 1.0).when(label <= 0, -1.0).alias("y"))
    rows = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    # in the order of their first copies
    rows = rows.withColumn("first", F.monotonically_increasing_id()).groupBy("x", "y").agg(F.count("*").cast("double").alias("count"), F.min("first").alias("first"))
    rows = rows.sortWithinPartitions("first").select("x", "y", "count")
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(b for b in batches if b.num_rows):
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            y = batch.column("y").to_numpy()
            count = batch.column("count").to_numpy()
            cells = [[first + number], [len(y)], [count.sum()], [x.tobytes()], [y.tobytes()], [count.tobytes()], [np.zeros(len(y)).tobytes()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * 4))], ["chunk", "n", "copies", "x", "y", "count", "dual"])

    return rows.mapInArrow(run, _CHUNKS)


def _round(chunks: DataFrame, w: list[float], total: int, regularisation: float, share: float, round_no: int, passes: int, seed: int) -> DataFrame:
    """The chunks with the share of their last moves taken over, the losses at w, and new moves."""
    scale, moved = regularisation * total, "move" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.array(w)
        own, task = start.copy(), TaskContext.get().partitionId()
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(r["n"], -1)
                y, count, dual = np.frombuffer(r["y"]), np.frombuffer(r["count"]), np.frombuffer(r["dual"]).copy()
                if moved:
                    dual += share * np.frombuffer(r["move"])
                hinge = float(count @ np.maximum(0, 1 - y * (x @ start)))
                new, before = dual.copy(), own.copy()
                ascend(x, y, count, new, own, scale, order_of(seed, round_no, r["chunk"], r["n"], passes))
                out = {c: r[c] for c in ("chunk", "n", "copies", "x", "y", "count")} | {"dual": dual.tobytes(), "move": (new - dual).tobytes(), "task": task}
                out |= {"hinge": hinge, "duals": float(count @ dual), "change": (own - before).tolist()}
                yield pa.RecordBatch.from_pylist([out], schema)

    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("copies", pa.float64()), ("x", pa.binary()), ("y", pa.binary()), ("count", pa.binary()), ("dual", pa.binary()), ("move", pa.binary()), ("task", pa.int32()), ("hinge", pa.float64()), ("duals", pa.float64()), ("change", pa.list_(pa.float64()))])
    return chunks.mapInArrow(run, _MOVED)


def train(rows: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 20, regularisation: float = 0.01,
          passes: int = 1, gap: float = 0.0, seed: int = 100) -> DualSvm:
    """Weights for labels above 0 against the others, after at most ``rounds`` or once the duality gap is at most ``gap``.

    Rows with a missing feature or label are left out; repeated rows count each; no rows give zero weights and no rounds.
    Each round is read back from its stored table, so a lost executor repeats one scan, and the weights always fit the duals.
    """
    chunks = stored(_chunked(rows, features, F.col(label)), "dual-rows")
    total = int(chunks.agg(F.sum("copies")).first()[0] or 0)
    w, history, share = np.zeros(len(features)), [], 0.0
    for round_no in range(rounds + 1 if total else 0):
        moved = stored(_round(chunks, w.tolist(), total, regularisation, share, round_no, passes, seed), "dual-round")
        changes = [F.sum(F.col("change")[i]).alias(f"c{i}") for i in range(len(features))]
        sums = moved.agg(F.sum("hinge").alias("hinge"), F.sum("duals").alias("duals"), F.count_distinct("task").alias("tasks"), *changes).first()
        penalty = regularisation / 2 * float(w @ w)
        primal, dual = penalty + sums.hinge / total, sums.duals / total - penalty
        history.append((round_no, primal, dual, primal - dual))
        if primal - dual <= gap or round_no == rounds:
            break
        share = 1 / sums.tasks
        w = w + share * np.array([sums[f"c{i}"] for i in range(len(features))])
        chunks = moved
    return DualSvm(w.tolist(), history)


def predicted(weights: Sequence[float], features: Sequence[str]) -> Column:
    """1 or -1; NULL where a feature is missing."""
    margin = sum((F.col(f).cast("double") * float(v) for f, v in zip(features, weights)), F.lit(0.0))
    return F.when(margin > 0, 1).when(margin <= 0, -1)
