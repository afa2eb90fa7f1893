"""Audit of how filters interact: survival words and positional population counts.

Which of five filters a document fails is a mask of five bits. The document becomes one 32-bit word with a bit for every
subset of the filters, set where the document survives all filters of the subset: where mask and subset have no filter in
common. How many documents survive each subset is then one positional count over all words, made by carry-save adders:
three words of equal weight become a sum word and a carry word of twice the weight, until few words of every weight are
left, whose bits are counted. Counts are summed by Spark per part and label.

Everything an audit asks follows from the survivors of subsets: of any order of the filters, what is left after a step is
the survivors of the filters so far.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_SYMBOLS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
#: A text with more than one in so many rows is joined by broadcast: at most so many texts.
HOT = 200
#: By mask, the subsets that share no filter with it.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)


def failures(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # on space and \\t to \\r
    few = len(words) < LEAST_WORDS
    repeats = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * code_points
    return few | repeats << 1 | capitals << 2 | (_SYMBOLS.search(text) is not None) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        points = pc.utf8_length(text).to_numpy(zero_copy_only=False)
        masks, digests = np.zeros(batch.num_rows, np.int32), []
        for i, own in enumerate(text.cast(pa.binary())):
            data = own.as_py()
            masks[i] = failures(data, int(points[i]))
            digests.append(hashlib.sha256(data).digest())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "part": batch.column("part"), "mask": masks, "digest": pa.array(digests, pa.binary())})


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): filters A to D of every text, and the text's SHA-256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask): filter E added where a smaller doc_id has the same text. rows: stored, as `judged` gives them.

    Only texts that occur twice are joined; those with more than one row in HOT, at most HOT texts, are broadcast.
    """
    again = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "audit-copies")
    many = rows.count() // HOT
    hot = again.where(F.col("n") > many).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    cold = again.where(F.col("n") <= many).select("digest", "first")
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    copy = lambda first: F.col("mask") + F.when(F.col("doc_id") > F.col(first), 16).otherwise(0)
    frequent = marked.where("hot_digest is not null").select("doc_id", "part", copy("hot_first").alias("mask"))
    others = marked.where("hot_digest is null").select("doc_id", "part", "mask", "digest").join(cold, "digest", "left")
    return frequent.unionByName(others.select("doc_id", "part", copy("first").alias("mask")))


def positional(words: np.ndarray) -> np.ndarray:
    """How many words have each of 32 bits set, by carry-save adders."""
    total, weight, layers = np.zeros(32, np.int64), 0, {0: [words]}
    while layers:
        own = np.concatenate(layers.pop(weight, [np.zeros(0, np.uint32)]))
        carried = layers.setdefault(weight + 1, [])
        while len(own) > 8:
            third = len(own) // 3
            a, b, c = own[:third], own[third : 2 * third], own[2 * third : 3 * third]
            either = a ^ b
            carried.append(a & b | c & either)
            own = np.concatenate([either ^ c, own[3 * third :]])
        total += ((own[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).sum(0, dtype=np.int64) << weight
        if not carried:
            layers.pop(weight + 1)
        weight += 1
    return total


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        own = part.indices.to_numpy(zero_copy_only=False)
        words = SURVIVAL[batch.column("mask").to_numpy(zero_copy_only=False)]
        labels = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=len(part.dictionary)))
        names, counts = [], []
        for i, end in enumerate(ends):
            at = order[ends[i - 1] if i else 0 : end]
            names.append(part.dictionary[i].as_py())
            counts.append(np.concatenate([positional(words[at]), *[positional(words[at][label[at]]) for label in labels]]))
        if names:
            yield pa.record_batch({"part": pa.array(names, pa.string()), "counts": pa.array(counts, pa.list_(pa.int64()))})


def survivors(rows: DataFrame) -> DataFrame:
    """(part, counts): survivors of every subset, of all rows, then of good and then of toxic ones; rows: part, mask, good, toxic."""
    counts = rows.select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic").mapInArrow(_survivors, "part string, counts array<long>")
    return counts.groupBy("part").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(3 * SUBSETS)]).alias("counts"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row per source,
    order of the five filters and step.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. A null text is read as empty, a null source as an empty one.
    A null doc_id is no smaller and no larger than others, has no labels, and its copies do not fail E. A repeated
    document is one each time; equal ids do not make each other copies. Of repeated labels of an id any 1 counts. An empty
    table gives no rows, a part without labels zeros. A very long text is judged whole. Other columns are ignored.
    """
    rows = with_copies(stored(judged(docs), "audit-judged"))
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(named.where("good or toxic"), F.col("doc_id") == F.col("labelled_id"), "left")
    no = F.lit(False)
    counted = survivors(rows.select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")))

    rows = counted.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))
    places = [(F.instr("filter_order", x), 1 << i) for i, x in enumerate(FILTERS)]
    total = lambda holds: sum((F.when(holds(at), bit).otherwise(0) for at, bit in places), F.lit(0))
    rows = rows.withColumns({"before": total(lambda at: at < F.col("step")), "own": total(lambda at: at == F.col("step"))})
    left = lambda subset, kind=0: F.col("counts")[subset + kind * SUBSETS]
    before, after, own, every = F.col("before"), F.col("before") + F.col("own"), F.col("own"), F.lit(SUBSETS - 1)
    removed = left(before) - left(after)
    values = {
        "kept": left(after),
        "removed": removed,
        "redundant": left(F.lit(0)) - left(own) - removed,
        "unique_fails": left(every - own) - left(every),
        "good_lost": left(before, 1) - left(after, 1),
        "toxic_lost": left(before, 2) - left(after, 2),
        "shapley": F.array(*[_shapley(i) for i in range(len(FILTERS))])[F.log2(own).cast("int")],
    }
    return rows.select("part", "filter_order", "step", *[v.cast("long").alias(k) for k, v in values.items()])


def _shapley(number: int) -> Column:
    """What a filter removes, summed over all orders: |S|! (4 - |S|)! orders have exactly the filters S before it."""
    others = [s for s in range(SUBSETS) if not s >> number & 1]
    times = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
    return sum(((F.col("counts")[s] - F.col("counts")[s | 1 << number]) * times(s) for s in others), F.lit(0))
