"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are dealt into blocks of bounded size. A block keeps, for each of PROJECTIONS random directions, its projected
values as one sorted array. A query looks at the window round its own projection in every array; the windows belong to a
radius and grow with it (virtual rehashing), so only newly covered stretches are counted. A vector that has collided in
more than THRESHOLD of the arrays is verified: its exact distance is computed. A query stops in a block when its k-th
verified distance is within the radius, by which every vector that near has been verified with probability over 0.99, or
when the block is exhausted. The k best of all blocks are the answer.

The work is queries x blocks, each pair of a query chunk and a block in one task of bounded memory; what a block returns
is k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, CHUNK = 16_384, 2_048
PROJECTIONS = 64
#: Window width over radius; a vector at the radius collides with probability 0.826 in each array.
WIDTH = 2.72
#: Share of the arrays in which a vector must collide to be verified, three standard deviations below that.
THRESHOLD = 0.68
#: Growth of the radius, and the first radius over the spread of a block's projections.
GROWTH, FIRST = 1.2, 0.1


def usable(vector: str = "embedding") -> Column:
    """Vectors that take part: without null or non-finite components, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.directions = np.random.default_rng(20).standard_normal((x.shape[1], PROJECTIONS))
        values = x @ self.directions
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        self.spread = float(np.median(values.std(axis=0))) or float(np.abs(values).max()) or 1.0

    def windows(self, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window in each array."""
        half = WIDTH * radius / 2
        low = np.stack([np.searchsorted(s, q[:, i] - half, "left") for i, s in enumerate(self.sorted)], axis=1)
        high = np.stack([np.searchsorted(s, q[:, i] + half, "right") for i, s in enumerate(self.sorted)], axis=1)
        return low, high

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
        n, need = len(self.ids), math.ceil(THRESHOLD * PROJECTIONS)
        projected = q @ self.directions
        # one query's state at a time; windows of all queries and radii are found together, a radius at a time
        radii = [FIRST * self.spread]
        bounds = [self.windows(projected, radii[0])]
        for j, (own, vector) in enumerate(zip(query_ids, q)):
            count = np.zeros(n, np.int32)
            checked = self.ids == own
            found, distance = np.empty(0, np.int64), np.empty(0)
            old_low = old_high = None
            level = 0
            while True:
                if level == len(radii):
                    radii.append(radii[-1] * GROWTH)
                    bounds.append(self.windows(projected, radii[-1]))
                low, high = bounds[level][0][j], bounds[level][1][j]
                if old_low is None:
                    pieces = [o[a:b] for o, a, b in zip(self.order, low, high)]
                else:
                    pieces = [o[a:b] for o, a, b in zip(self.order, low, old_low)] + [o[a:b] for o, a, b in zip(self.order, old_high, high)]
                count += np.bincount(np.concatenate(pieces), minlength=n)
                new = np.flatnonzero((count >= need) & ~checked)
                if len(new):
                    checked[new] = True
                    found = np.append(found, new)
                    distance = np.append(distance, np.sqrt(((self.x[new] - vector) ** 2).sum(axis=1)))
                if checked.all() or (len(found) >= k and len(np.unique(self.ids[found[distance <= radii[level]]])) >= k):
                    break
                old_low, old_high = low, high
                level += 1
            best = np.lexsort((self.ids[found], distance))
            _, first = np.unique(self.ids[found[best]], return_index=True)
            best = best[np.sort(first)[:k]]
            yield pd.DataFrame({"query_id": own, "vec_id": self.ids[found[best]], "score": distance[best]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance, ties to smaller ids.

    vectors, queries: vec_id, embedding (array of numbers). A query's own vec_id is no candidate; a query with fewer than
    k candidates gets all. Vectors that are null, empty, all zero or hold null or non-finite components take no part, nor
    do rows without an id; vectors meet only those of their own length. An exactly repeated row counts once; an id with
    several different vectors is searched from each of them, and found once, at its smallest distance. Empty tables give
    an empty result; other columns are ignored.
    """
    ready = lambda df: (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & usable())
        .distinct()
        .withColumn("width", F.size("embedding"))
    )
    vectors, queries = ready(vectors), ready(queries)
    blocks = max(1, math.ceil(vectors.count() / BLOCK))
    chunks = max(1, math.ceil(queries.count() / CHUNK))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = vectors.select("vec_id", "embedding", "width", deal(blocks, 1).alias("block"), every(chunks).alias("chunk"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", "width", every(blocks).alias("block"), deal(chunks, 2).alias("chunk"))

    def both(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(data) or not len(asked):
            return none
        block = Block(data["vec_id"].to_numpy(), np.stack(data["embedding"].to_numpy()))
        return pd.concat([none, *block.search(asked["query_id"].to_numpy(), np.stack(asked["embedding"].to_numpy()), k)])

    keys = ["width", "block", "chunk"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(both, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
