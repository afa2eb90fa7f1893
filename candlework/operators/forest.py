"""Random forests for many fits at once, grown level by level from histograms.

A sweep fits a forest for every training length and threshold. Here all of them grow together: a stored table has each bar
once, its features as bin numbers and its label under every fit. For every level one scan counts, per (fit, tree, node,
feature, bin), the weighted rows of each class; Spark adds the counts up and picks the best split of each node in SQL, and
the next scan walks one level further. So a sweep of any number of fits costs one scan a level, and one scan to score.
A batch walks all trees of a fit at once: each feature's bin leaves some of the nodes a tree may end in, as bits of a number.

Bootstrap weights are Poisson numbers from a hash of the row, the fit and the tree, so that a row's weight is the same in
every scan and can be stated in SQL; rows of weight 0 are out of the bag of that tree. The model is one table of nodes. On
the driver and in broadcasts it is bounded by fits x trees x 2^depth, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlework.schema import CODE_COLUMNS
from candlework.session import stored

#: A prime: weights come from products modulo it, exact in 64 bits in any engine.
PRIME = (1 << 31) - 1
#: Of PRIME, where the Poisson numbers of mean 1 step from 0 to 1, 1 to 2 and so on.
POISSON_STEPS = [math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(8)]
#: Where codes split.
CODE_EDGES = [-1.0, 0.0, 1.0]
_CELLS = 1 << 24  # of histograms held at a time, 128 MB
_ROWS = 1 << 16  # held by a task at a time
_WALKED = 1 << 10  # rows walked together, whose exits stay in a core's cache
_DEEPEST = 6  # levels whose exits are the bits of one number
_SHARE = 19  # bits of a place that are left out to look up how often a row is drawn


def row_hash(keys: Sequence[Column]) -> Column:
    """1 to 2^28: the first seven hex digits of the MD5 of the keys, which must identify a row."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 7), 16, 10).cast("long") + 1).alias("hash")


def factor(fit: int, tree: int) -> int:
    """What a row's hash is multiplied with, modulo PRIME, for its place in the bootstrap sample of a tree."""
    return pow(48271, 7919 * fit + tree + 11, PRIME)


def _steps_below(place: np.ndarray) -> np.ndarray:
    return sum((place >= step).astype(float) for step in POISSON_STEPS)


_FIRST = np.arange(1 << 31 - _SHARE, dtype=np.int64) << _SHARE
#: How often a row is drawn by its place without the last bits; -1 where those decide.
_BY_SHARE = np.where(_steps_below(_FIRST) == _steps_below(_FIRST + (1 << _SHARE) - 1), _steps_below(_FIRST), -1.0)


def _drawn(hashes: np.ndarray, fit: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree, as whole doubles."""
    place = hashes.astype(np.int64, copy=False) * factor(fit, tree)
    place = (place & PRIME) + (place >> 31)  # below 2 * PRIME, as a product is below its square
    place = np.minimum(place.view(np.uint64), (place - PRIME).view(np.uint64)).view(np.int64)  # less than nothing wraps around
    drawn = _BY_SHARE.take(place >> _SHARE)
    open_ones = np.flatnonzero(drawn < 0)
    drawn[open_ones] = _steps_below(place[open_ones])
    return drawn


def weights(hashes: np.ndarray, fit: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    return _drawn(hashes, fit, tree).astype(np.int64)


@dataclass
class Forests:
    """Arrays by (fit, tree, node): the root is node 1, the children of n are 2n and 2n + 1. A feature of -1 is a leaf, a
    decision of -1 a node without rows. A row goes left if its value is at most the edge of the split's bin."""

    features: list[str]
    edges: list[list[float]]
    classes: int
    feature: np.ndarray
    bin: np.ndarray
    decision: np.ndarray
    gain: np.ndarray = field(repr=False)
    _tables: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def depth(self) -> int:
        return self.feature.shape[2].bit_length() - 2

    def complete(self, fit: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """The tree with all levels: by node feature * 256 + bin, where a leaf sends every row left, and by last node the
        decision of the leaf above it."""
        feature, cut, decision = self.feature[fit, tree].astype(np.int32), self.bin[fit, tree].astype(np.int32), self.decision[fit, tree]
        split = np.where(feature >= 0, feature * 256 + cut, 255).astype(np.int32)
        last = np.arange(1 << self.depth, 2 << self.depth)
        leaf = last.copy()
        for up in range(1, self.depth + 1):
            above = last >> up
            leaf = np.where(feature[above] < 0, above, leaf)
        return split, decision[leaf]

    def walk(self, x: np.ndarray, fit: int, tree: int, levels: int) -> np.ndarray:
        """The node of each row after at most so many levels."""
        split = self.complete(fit, tree)[0]
        node = _walked(x, split, levels)
        for up in range(levels, 0, -1):  # rows that stopped at a leaf have been sent on: back up
            above = node >> up
            node = np.where((above > 0) & (self.feature[fit, tree][above] < 0), above, node)
        return node

    def masks(self, fit: int, levels: int) -> list[tuple[int, np.ndarray]]:
        """(feature, table by bin and tree) of the features that a fit's trees ask for in their first levels.

        A number has a bit for each node at the end of those levels, from the left. A table gives what a row's bin leaves of them:
        where a node sends the row right, all on its left are gone. Of what all features leave, a row is at the lowest bit.
        """
        if (fit, levels) not in self._tables:
            kind, trees = np.uint32 if levels < _DEEPEST else np.uint64, self.feature.shape[1]
            tables = {}
            for tree, node in zip(*np.nonzero(self.feature[fit, :, : 1 << levels] >= 0)):
                f, under = int(self.feature[fit, tree, node]), levels + 1 - int(node).bit_length()  # levels below the node
                if f not in tables:
                    tables[f] = np.full((len(self.edges[f]) + 1, trees), ((1 << (1 << levels)) - 1), kind)
                left = ((1 << (1 << under - 1)) - 1) << ((int(node) << under) - (1 << levels))
                tables[f][int(self.bin[fit, tree, node]) + 1 :, tree] &= kind(((1 << (1 << levels)) - 1) & ~left)
            self._tables[fit, levels] = sorted(tables.items())
        return self._tables[fit, levels]

    def exits(self, x: np.ndarray, fit: int, levels: int) -> Iterator[tuple[slice, np.ndarray]]:
        """The lowest bit of each row and tree after so many levels, a few rows at a time. x: by feature and row."""
        tables, trees = self.masks(fit, levels), self.feature.shape[1]
        kind = np.uint32 if levels < _DEEPEST else np.uint64
        for first in range(0, x.shape[1], _WALKED):
            some = slice(first, min(first + _WALKED, x.shape[1]))
            at = np.full((some.stop - first, trees), ((1 << (1 << levels)) - 1), kind)
            left = np.empty_like(at)
            for f, table in tables:
                table.take(x[f, some], axis=0, out=left, mode="clip")
                at &= left
            yield some, at & (~at + kind(1))

    def votes(self, x: np.ndarray, fit: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Votes for each class; with hashes, only of trees that have the row out of their bag."""
        out = np.zeros((self.classes, len(x)), np.int64)
        trees = self.feature.shape[1]
        if self.depth > _DEEPEST:
            for tree in range(trees):
                split, decision = self.complete(fit, tree)
                decided = decision[_walked(x, split, self.depth) - (1 << self.depth)]
                if hashes is not None:
                    decided = np.where(weights(hashes, fit, tree) == 0, decided, -1)
                for c in range(self.classes):
                    out[c] += decided == c
            return np.ascontiguousarray(out.T)
        if (fit, "decided") not in self._tables:
            decided = np.stack([self.complete(fit, tree)[1] for tree in range(trees)])
            bits = np.left_shift(np.uint64(1), np.arange(1 << self.depth, dtype=np.uint64))
            self._tables[fit, "decided"] = [np.where(decided == c, bits, np.uint64(0)).sum(1, dtype=np.uint64) for c in range(self.classes)]
        for some, at in self.exits(np.ascontiguousarray(x.T).astype(np.intp), fit, self.depth):
            if hashes is not None:
                at[np.stack([_drawn(hashes[some], fit, tree) != 0 for tree in range(trees)], axis=1)] = 0
            for c, of_class in enumerate(self._tables[fit, "decided"]):
                out[c, some] = np.count_nonzero(at & of_class.astype(at.dtype), axis=1)
        return np.ascontiguousarray(out.T)


def _walked(x: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row so many levels down a tree that has them all."""
    node, first = np.ones(len(x), np.int32), np.arange(0, x.size, x.shape[1], dtype=np.int32) if len(x) else np.zeros(0, np.int32)
    flat = x.ravel()
    for _ in range(levels):
        at = split[node]
        node = 2 * node + (flat[first + (at >> 8)] > (at & 255))
    return node


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """Where each feature may split: codes at their values, others at quantiles. One aggregate; features x bins numbers."""
    shares = [i / bins for i in range(1, bins)]
    others = [f for f in features if f not in CODE_COLUMNS]
    row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in others]).first() if others else {}
    return [CODE_EDGES if f in CODE_COLUMNS else sorted(set(row[f] or [])) for f in features]


def _binned(features: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, features[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _bytes(column: pa.Array, width: int, kind: type) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), kind)
    _, ends, values = column.buffers()
    first = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(values, kind, len(column) * width, first).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of single bytes as binary values, without a Python object for each."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def evenly(rows: DataFrame) -> DataFrame:
    """Rows dealt over all shuffle partitions, as their cost is in computing and not in bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def binned(rows: DataFrame, features: Sequence[str], edges: list[list[float]], label_of_fit: Sequence[Column], key: Sequence[Column],
           upto: tuple[str, Sequence[int]] | None = None) -> DataFrame:
    """(hash, x, y), stored: bin numbers of complete rows, and their label under every fit, -1 where a fit does not have them.

    ``upto`` names a column and values of it: for each, in their order, there is a fit of every label, which has the rows up to
    that value. So a row's labels are stated once, not once a fit.
    """
    complete = rows.dropna("any", subset=list(features))
    values = F.array(*[F.col(f).cast("double") for f in features])
    labels = F.array(*[F.coalesce(y.cast("byte"), F.lit(-1).cast("byte")) for y in label_of_fit])
    width, different = len(features), len(label_of_fit)
    last = [F.col(upto[0]).cast("long").alias("_upto")] if upto else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("y"), different).astype(np.int8)
            if upto:
                at = batch.column("_upto").to_numpy(zero_copy_only=False)
                y = np.concatenate([np.where((at <= value)[:, None], y, np.int8(-1)) for value in upto[1]], axis=1)
            some = np.flatnonzero((y >= 0).any(1))  # rows of any fit
            x = _binned(_matrix(batch.column("f"), width)[some], edges)
            yield pa.record_batch({"hash": batch.column("hash").take(pa.array(some)), "x": _binary(x), "y": _binary(y[some])})

    out = complete.select(row_hash(key), values.alias("f"), labels.alias("y"), *last)
    # dealt evenly: every level scans these rows, and each costs a walk for every fit and tree
    return stored(evenly(out.mapInArrow(run, "hash long, x binary, y binary")), "forest-rows")


def _tried(model: Forests, fit: int, trees: np.ndarray, nodes: np.ndarray, tried: int, seed: int) -> np.ndarray:
    """The features tried at each node, by a hash of fit, tree and node."""
    width = len(model.features)
    if tried >= width:
        return np.tile(np.arange(width), (len(nodes), 1))
    h = ((nodes * 1_000_003 + trees * 7_919 + fit * 104_729 + seed)[:, None] * 64 + np.arange(width)).astype(np.uint64)
    for shift in (33, 29, 32):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :tried], axis=1)


def _histograms(model: Forests, level: int, tried: int, seed: int):
    """Cells (fit, tree, node, feature, bin, n0, n1, ...) of the nodes of a level, counted over all rows of a task."""
    fits, trees = model.feature.shape[:2]
    bins = max((len(e) for e in model.edges), default=0) + 1

    size = bins * model.classes

    def alive(fit: int, tree: int) -> np.ndarray:
        """1 for the nodes of this level, 0 for those below a leaf: their rows have stopped above."""
        node = np.arange(1 << level, 2 << level)
        return (~np.any([model.feature[fit, tree][node >> up] < 0 for up in range(1, level + 1)], axis=0)).astype(float) if level else np.ones(1)

    def tried_at(fit: int, tree: int) -> np.ndarray:
        return _tried(model, fit, np.full(1 << level, tree), np.arange(1 << level, 2 << level), tried, seed)

    def cells_of(n: np.ndarray, feature: np.ndarray, fit: int, tree: int) -> pa.RecordBatch:
        """The cells with rows; n: by feature tried, node of the level, bin and class."""
        n = n.reshape(-1, model.classes)
        full = np.flatnonzero(n.any(1))
        column, at = np.divmod(full, bins << level)
        at, bin_no = np.divmod(at, bins)
        return pa.record_batch(
            {"fit": np.full(len(full), fit, np.int32), "tree": np.full(len(full), tree, np.int32), "node": at + (1 << level), "feature": feature[at, column].astype(np.int32), "bin": bin_no.astype(np.int32)}
            | {f"n{c}": n[full, c].astype(np.int64) for c in range(model.classes)}
        )

    def places(x: np.ndarray, fit: int) -> np.ndarray:
        """The node of this level, from the left, by tree and row."""
        place = np.zeros((trees, x.shape[1]), np.int64)
        if level > _DEEPEST:
            rows = np.ascontiguousarray(x.T)
            for tree in range(trees):
                place[tree] = _walked(rows, model.complete(fit, tree)[0], level) - (1 << level)
        elif level:
            for some, at in model.exits(x.astype(np.intp), fit, level):
                # a power of two as a floating number has its exponent there
                if at.itemsize == 4:
                    place[:, some] = ((at.astype(np.float32).view(np.int32) >> 23) - 127).T
                else:
                    place[:, some] = ((at.astype(np.float64).view(np.int64) >> 52) - 1023).T
        return place

    def counted(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, sums: dict | None) -> Iterator[pa.RecordBatch]:
        """Adds the rows to the sums by (fit, tree), or yields their cells."""
        for fit in range(fits):
            mine = np.flatnonzero(y[:, fit] >= 0)
            if not len(mine):
                continue
            own, h = np.ascontiguousarray(x[mine].T), hashes[mine]
            # a row's bins with its class, by feature and row
            cells = own.astype(np.int64) * model.classes + y[mine, fit]
            by_row = cells.ravel()
            place = places(own, fit)
            for tree in range(trees):
                w, at, going = _drawn(h, fit, tree), place[tree], alive(fit, tree)
                if not going.all():
                    w *= going.take(at)
                drawn = np.flatnonzero(w > 0)
                if not len(drawn):
                    continue
                if sums is None:
                    feature, step = tried_at(fit, tree), max(1, _CELLS // (size << level))
                elif (fit, tree) not in sums:
                    feature = tried_at(fit, tree)
                    sums[fit, tree] = np.zeros((feature.shape[1], size << level)), feature
                if sums is not None:
                    n, feature = sums[fit, tree]
                    step = feature.shape[1]
                if level:
                    w, at = w.take(drawn), at.take(drawn)
                    first = at * size
                for j in range(0, feature.shape[1], step):
                    some = feature[:, j : j + step]
                    if sums is None:
                        n = np.zeros((some.shape[1], size << level))
                    for k in range(some.shape[1]):
                        if level:
                            where = (some[:, k] * cells.shape[1]).take(at, mode="clip")
                            where += drawn
                            cell = by_row.take(where, mode="clip", out=where)
                            cell += first
                        else:
                            cell = cells[some[0, k]]
                        n[k] += np.bincount(cell, w, size << level)
                    if sums is None:
                        yield cells_of(n, some, fit, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        # whatever its rows, a task gives each cell once, unless the cells of a level are too many to hold
        sums = {} if fits * trees * min(tried, len(model.features)) * size << level <= _CELLS else None

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: whole[c].combine_chunks()
            yield from counted(_bytes(column("x"), len(model.features), np.uint8), _bytes(column("y"), fits, np.int8), column("hash").to_numpy(), sums)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _ROWS:
                yield from flush()
                held = []
        if sum(b.num_rows for b in held):
            yield from flush()
        for (fit, tree), (n, feature) in (sums or {}).items():
            yield cells_of(n, feature, fit, tree)

    return run


def best_splits(cells: DataFrame, classes: int) -> DataFrame:
    """(fit, tree, node, t0.., feature, bin, gain, l0..): every node's class counts, and the split with the largest fall of
    the Gini impurity, the first feature and bin of equal ones; null where no split lowers it."""
    node = ["fit", "tree", "node"]
    names = [f"n{c}" for c in range(classes)]
    summed = cells.groupBy(*node, "feature", "bin").agg(*[F.sum(c).alias(c) for c in names])
    along = Window.partitionBy(*node, "feature").orderBy("bin")
    whole = Window.partitionBy(*node, "feature")
    rows = summed.select(*node, "feature", "bin", *[F.sum(c).over(along).alias(f"l{i}") for i, c in enumerate(names)], *[F.sum(c).over(whole).alias(f"t{i}") for i, c in enumerate(names)])

    def purity(counts: list[Column]) -> Column:
        total = sum(counts, F.lit(0)).cast("double")
        return F.coalesce(F.try_divide(sum((c.cast("double") * c for c in counts), F.lit(0.0)), total), F.lit(0.0))

    left, every = [F.col(f"l{i}") for i in range(classes)], [F.col(f"t{i}") for i in range(classes)]
    right = [t - x for t, x in zip(every, left)]
    gain = F.round(purity(left) + purity(right) - purity(every), 9)
    best = F.max(F.when(gain > 0, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), *left)))
    chosen = rows.groupBy(*node).agg(best.alias("best"), *[F.max(f"t{i}").alias(f"t{i}") for i in range(classes)])
    return chosen.select(*node, *[f"t{i}" for i in range(classes)], (-F.col("best.feature")).alias("feature"), (-F.col("best.bin")).alias("bin"), "best.gain", *[f"best.l{i}" for i in range(classes)])


def grow(rows: DataFrame, features: Sequence[str], edges: list[list[float]], fits: int, classes: int = 3, trees: int = 100, depth: int = 5, tried: int | None = None, seed: int = 100) -> Forests:
    """Forests of all fits over rows of ``binned``. ``tried`` features a node, the root of their number by default.

    The loop is over levels. A fit without rows has no nodes. Class counts tie to the smallest class.
    """
    tried = tried or max(1, math.isqrt(len(features)))
    shape = (fits, trees, 2 << depth)
    model = Forests(list(features), edges, classes, np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.full(shape, -1, np.int8), np.zeros(shape))
    schema = "fit int, tree int, node long, feature int, bin int, " + ", ".join(f"n{c} long" for c in range(classes))
    for level in range(depth):
        found = best_splits(rows.mapInArrow(_histograms(model, level, tried, seed), schema), classes).toArrow()
        if not found.num_rows:
            break
        at = tuple(found[c].to_numpy() for c in ("fit", "tree", "node"))
        total = np.stack([found[f"t{c}"].to_numpy() for c in range(classes)], axis=1)
        model.decision[at] = total.argmax(1)
        split = found["feature"].is_valid().to_numpy()
        if not split.any():
            break
        fit, tree, node = (a[split] for a in at)
        model.feature[fit, tree, node] = found["feature"].drop_null().to_numpy()
        model.bin[fit, tree, node] = found["bin"].drop_null().to_numpy()
        model.gain[fit, tree, node] = found["gain"].drop_null().to_numpy()
        left = np.stack([found[f"l{c}"].drop_null().to_numpy() for c in range(classes)], axis=1)
        model.decision[fit, tree, 2 * node] = left.argmax(1)
        model.decision[fit, tree, 2 * node + 1] = (total[split] - left).argmax(1)
    return model


def node_table(spark: SparkSession, model: Forests) -> DataFrame:
    """(fit, tree, node, feature, below, decision, gain): the forests as rows; feature and below are null in leaves, a row
    goes to node 2n if its value is at most ``below``, else to 2n + 1."""
    fit, tree, node = np.nonzero(model.decision >= 0)
    feature = model.feature[fit, tree, node]
    rows = [
        (int(a), int(b), int(c), model.features[f] if f >= 0 else None, float(model.edges[f][k]) if f >= 0 else None, int(d), float(g))
        for a, b, c, f, k, d, g in zip(fit, tree, node, feature, model.bin[fit, tree, node], model.decision[fit, tree, node], model.gain[fit, tree, node])
    ]
    return spark.createDataFrame(rows, "fit int, tree int, node int, feature string, below double, decision int, gain double")


def from_nodes(nodes: DataFrame, features: Sequence[str], edges: list[list[float]], classes: int, shape: tuple[int, int, int]) -> Forests:
    """The forests of a node table."""
    model = Forests(list(features), edges, classes, np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.full(shape, -1, np.int8), np.zeros(shape))
    for r in nodes.collect():
        at = (r.fit, r.tree, r.node)
        model.decision[at], model.gain[at] = r.decision, r.gain
        if r.feature is not None:
            model.feature[at] = model.features.index(r.feature)
            model.bin[at] = edges[model.feature[at]].index(r.below)
    return model


def importances(spark: SparkSession, model: Forests) -> DataFrame:
    """(fit, feature, importance): the share of each feature in a fit's falls of impurity, all features listed."""
    rows = []
    for fit in range(model.feature.shape[0]):
        inner = model.feature[fit] >= 0
        total = np.bincount(model.feature[fit][inner], model.gain[fit][inner], len(model.features))
        rows += [(fit, f, float(v)) for f, v in zip(model.features, total / total.sum() if total.sum() else total)]
    return spark.createDataFrame(rows, "fit int, feature string, importance double")


def predict(table: DataFrame, model: Forests, name: str = "predictions", missing: float | None = None, keep: Sequence[str] | None = None,
            within: tuple[str, Sequence[tuple[int, int]]] | None = None, packed: bool = False) -> DataFrame:
    """The table, or the columns of it to keep, with an array of one prediction a fit, in one scan; ties go to the smallest class.

    A fit without trees predicts -1. A row with a missing feature counts it as ``missing``, or gets -1 everywhere if that is
    None. Every tree walks a whole batch at a time. ``within`` names a column and the first and last value of it that each fit
    is asked for; it predicts -1 elsewhere. ``packed`` gives the predictions as a byte each in a binary value.
    """
    width, fits, kept = len(model.features), model.feature.shape[0], list(table.columns if keep is None else keep)
    shared = table.sparkSession.sparkContext.broadcast(model)
    values = F.array(*[F.col(f).cast("double") for f in model.features])
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([*[table.schema[c] for c in kept], T.StructField(name, kind)])
    asked = [F.col(within[0]).cast("long").alias("_within")] if within else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value
        for batch in batches:
            f = _matrix(batch.column("_values"), width).astype(np.float64)
            hole = np.isnan(f)
            x = _binned(np.where(hole, 0.0 if missing is None else missing, f), forests.edges)
            out = np.full((len(f), fits), -1, np.int8 if packed else np.int32)
            at = batch.column("_within").to_numpy(zero_copy_only=False) if within else None
            for fit in range(fits):
                mine = slice(None) if at is None else np.flatnonzero((at >= within[1][fit][0]) & (at <= within[1][fit][1]))
                votes = forests.votes(x[mine], fit)
                out[mine, fit] = np.where(votes.any(1), votes.argmax(1), -1)
            if missing is None:
                out[hole.any(1)] = -1
            column = _binary(out) if packed else pa.ListArray.from_arrays(np.arange(0, out.size + 1, fits, dtype=np.int32), out.ravel())
            yield pa.record_batch({c: batch.column(c) for c in kept} | {name: column})

    return table.select(*kept, *asked, values.alias("_values")).mapInArrow(run, schema)


def out_of_bag(rows: DataFrame, model: Forests) -> DataFrame:
    """(hash, fit, label, votes, prediction) of every training row of every fit: votes of the trees that did not draw it, -1
    for a row that every tree drew. rows: as ``binned`` gives them."""
    fits = model.feature.shape[0]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, h = _bytes(batch.column("x"), len(forests.features), np.uint8), _bytes(batch.column("y"), fits, np.int8), batch.column("hash").to_numpy()
            for fit in range(fits):
                mine = np.flatnonzero(y[:, fit] >= 0)
                votes = forests.votes(x[mine], fit, h[mine])
                yield pa.record_batch({"hash": h[mine], "fit": np.full(len(mine), fit, np.int32), "label": y[mine, fit].astype(np.int32), "votes": votes.sum(1), "prediction": np.where(votes.any(1), votes.argmax(1), -1).astype(np.int32)})

    return rows.mapInArrow(run, "hash long, fit int, label int, votes long, prediction int")


def tune_tried(rows: DataFrame, features: Sequence[str], edges: list[list[float]], fits: int = 1, classes: int = 3, trees: int = 50, depth: int = 5, start: int | None = None, step: float = 2.0, improve: float = 0.05, seed: int = 100) -> list[tuple[int, float]]:
    """(features tried, out-of-bag error) of every number tried, the best first: from ``start`` down and up by the factor
    ``step`` as long as the error falls by the share ``improve``. Numbers tried are few: each is a whole fit."""
    errors: dict[int, float] = {}

    def error(tried: int) -> float:
        if tried not in errors:
            model = grow(rows, features, edges, fits, classes, trees, depth, tried, seed)
            judged = out_of_bag(rows, model).where("votes > 0").agg(F.avg((F.col("prediction") != F.col("label")).cast("int"))).first()[0]
            errors[tried] = judged if judged is not None else math.nan
        return errors[tried]

    first = start or max(1, math.isqrt(len(features)))
    error(first)
    for direction in (1 / step, step):
        at = first
        while True:
            further = max(1, math.floor(at * direction)) if direction < 1 else min(len(features), math.ceil(at * direction))
            if further == at or not error(further) < error(at) * (1 - improve):
                break
            at = further
    return sorted(errors.items(), key=lambda e: (e[1], e[0]))
