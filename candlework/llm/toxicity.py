"""Toxicity by two class-conditional Kneser-Ney language models.

Words are lower-cased runs of letters and digits, known by 64-bit hashes. Each class has an
interpolated Kneser-Ney model of order 2: in how many texts a pair of words occurs, discounted, over the number of different words a word
follows (its continuation count) in that class, over the continuation counts of both classes together. The last level is
shared, so an expression that is rare in both classes gets nearly the same probability from both. A text's features are
its length-normalised log-likelihood under the toxic model minus that under the ordinary one, over the whole text and
over its most toxic run of words, for order 2 and for the order below alone; a logistic curve turns the features into a score.

Counts cover every labelled text that may be learned from and are summed by Spark: of pairs in buckets by the pair, then of
words, contexts and the pairs that outlive the discount in buckets by the item, both as compressed blocks of sorted keys
(see `slices`). All words, and all pairs that outlive the discount, stay in one stored table of blocks that grows with the
corpus.

For scoring, the most frequent items are broadcast, up to a fixed number, and a bitmap of where the others may lie, sized by
their number up to a bound. What else a run of texts may need it asks for, in one scan, as blocks of distinct items; the
next scan reads the answers to its own runs, known by a hash of what they asked. No text is shuffled, and the sizes decide
how much is asked, never a score. The curve alone is fitted on a bounded sample, each text scored by the models of the half
of the rows that it is not in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlework.llm.common import carried, documents_by_id, held_out, labelled, logistic, prefiltered, shared_path, slices, stored, text_of
from candlework.llm.recompression import hashed_words
from candlework.llm.slices import block, opened

#: Most items broadcast with their values, about 1 MB a model: few, so that the work grows alike at every size.
CACHE = 1 << 15
#: log2 of the fewest and of the most bits that tell which other items may be known: eight an item, up to 128 MB.
BITMAP_BITS, MOST_BITMAP_BITS = 20, 30
#: Taken off every count and continuation count: what occurs no more often in a class rests on the shared counts alone.
DISCOUNT = 2
#: Words of the run whose ratios give the second feature.
RUN = 8
#: A word's log-ratio beyond which it counts as clearly toxic.
CLEAR = 1.5
FEATURES = 6
#: Characters of the runs of texts that are counted, and ask, together.
TEXTS = 1 << 23
#: Words whose values are held at a time, or those of one text.
WORDS = 1 << 17
CURVE_ROWS = 20_000
#: Bytes of lower-cased text that words do not have.
_OUTSIDE = np.array([not (97 <= b <= 122 or 48 <= b <= 57 or b >= 128) for b in range(256)])
#: Models: of either half of the rows and of all rows, each ordinary and toxic.
SCOPES = ("0", "1", "all")


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text after one 0 as its first context, and where each begins (and the end)."""
    lower = [t.lower().encode("utf-8", "replace") for t in texts]
    start, (name,) = hashed_words(b"\n".join([*lower, b""]), _OUTSIDE, 1)
    first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in lower]))
    at = first + np.arange(len(first))
    out = np.zeros(at[-1], np.uint64)
    out[np.arange(len(name)) + np.repeat(np.arange(1, len(first)), np.diff(first))] = name
    return out.view(np.int64), at


def _real(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions but the first end a pair that lies within a text."""
    real = np.ones(len(word), bool)
    real[at[:-1]] = False
    return real[1:]


def _pair_items(word: np.ndarray) -> np.ndarray:
    """The item of the pair that ends at every position but the first, as `_pair_item` has it."""
    return _items_of(word[:-1], word[1:]).view(np.int64)


def _items_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    c, w = context.view(np.uint64), word.view(np.uint64)
    return c ^ (w << np.uint64(1) | w >> np.uint64(63))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group = batch.column("y").to_numpy(zero_copy_only=False) + 2 * batch.column("half").to_numpy(zero_copy_only=False)
        for start, texts in slices(batch, "text", TEXTS):
            word, at = _words(texts)
            if len(word) < 2:
                continue
            real = _real(word, at)
            owner = np.repeat(np.arange(len(texts)), np.diff(at))[1:][real]
            kind = group[start : start + len(texts)].astype(np.int32)[owner]
            context, word = word[:-1][real], word[1:][real]
            order = np.lexsort((owner, kind, word, context))
            context, word, kind, owner = context[order], word[order], kind[order], owner[order]
            differs = lambda *columns: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            once = differs(context, word, owner) if len(owner) else np.zeros(0, bool)  # a pair counts once per text
            context, word, kind = context[once], word[once], kind[once]
            if len(word):
                first = np.flatnonzero(differs(context, word, kind))
                n = np.diff(np.append(first, len(word)))
                yield pa.record_batch({"context": context[first], "word": word[first], "kind": kind[first], "n": n.astype(np.int64)})


#: Columns of an item's counts. Of a word: its continuation counts for ordinary and toxic texts of half 0, of half 1 and of
#: all, the sums of the counts of the pairs it begins for the first four, what the discount takes off those for all six. Of a
#: pair: its counts in the first six.
_COUNTS = 16
_BLOCK = [np.uint64, np.uint8, *[np.int64] * _COUNTS]


#: Buckets over which the pairs of one context are dealt.
_SPREAD = 16


def _buckets(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_buckets(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row a bucket: its rows of the columns as a block, in the order they come in."""
    order = np.argsort(bucket, kind="stable")
    used, start = np.unique(bucket[order], return_index=True)
    end = np.append(start[1:], len(order))
    blocks = [block(*[np.ascontiguousarray(c[order[i:j]]) for c in columns]) for i, j in zip(start, end)]
    return pa.record_batch({"bucket": pa.array(used, pa.int32()), "n": pa.array(end - start, pa.int32()), "data": pa.array(blocks, pa.binary())})


def _gathered(rows: pa.Table, kinds: list[type]) -> list[np.ndarray]:
    parts = [opened(d.as_py(), n, *kinds) for d, n in zip(rows["data"], rows["n"].to_pylist())]
    return [np.concatenate(c) for c in zip(*parts)]


def _sums(keys: list[np.ndarray], columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, ascending by the first, and the sums of the rows of columns with each."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    start = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])[: len(order)])
    return [k[start] for k in keys], np.add.reduceat(columns[order], start, axis=0) if len(start) else columns[:0]


def _counts(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Columns of _BLOCK: what different pairs, with their counts of the four kinds, add to items."""
    six = np.column_stack([counts, counts[:, 0] + counts[:, 2], counts[:, 1] + counts[:, 3]])
    words, n = _sums([word.view(np.uint64)], (six > 0).astype(np.int64))
    contexts, s = _sums([context.view(np.uint64)], np.column_stack([counts, np.minimum(six, DISCOUNT)]))
    lasting = (six[:, 4:] > DISCOUNT).any(1)
    pairs, k = _sums([_items_of(context[lasting], word[lasting])], six[lasting])
    item = np.concatenate([words[0], contexts[0], pairs[0]])
    is_word = np.repeat([1, 0], [len(words[0]) + len(contexts[0]), len(pairs[0])]).astype(np.uint8)
    out = np.zeros((len(item), _COUNTS), np.int64)
    out[: len(n), :6] = n
    out[len(n) : len(n) + len(s), 6:] = s
    out[len(item) - len(k) :, :6] = k
    (item, is_word), out = _sums([item, is_word], out)
    return [item, is_word, *out.T]


def _pair_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _counter(batches):
            context, word = (part.column(c).to_numpy() for c in ("context", "word"))
            # a context's pairs lie together, in as many buckets as keep a frequent one from filling its task
            bucket = context.view(np.uint64) % np.uint64(max(1, buckets // _SPREAD)) * np.uint64(_SPREAD) + word.view(np.uint64) % np.uint64(_SPREAD)
            yield _in_buckets(bucket.astype(np.int64), [context, word, part.column("kind").to_numpy().astype(np.uint8), part.column("n").to_numpy()])

    return run


def _item_blocks(buckets: int):
    """Of a bucket of pairs: its counts by bucket of the item."""

    def run(rows: pa.Table) -> pa.Table:
        context, word, kind, n = _gathered(rows, [np.int64, np.int64, np.uint8, np.int64])
        (context, word), counts = _sums([context, word], np.where(kind[:, None] == np.arange(4), n[:, None], 0))
        columns = _counts(context, word, counts)
        return pa.Table.from_batches([_in_buckets((columns[0] % np.uint64(buckets)).astype(np.int64), columns)])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One block a bucket of items: the sums of its blocks, items ascending."""
    item, is_word, *counts = _gathered(rows, _BLOCK)
    (item, is_word), counts = _sums([item, is_word], np.column_stack(counts))
    return pa.table({"bucket": rows["bucket"].slice(0, 1), "n": pa.array([len(item)], pa.int32()), "data": pa.array([block(item, is_word, *[np.ascontiguousarray(c) for c in counts.T])], pa.binary())})


_BLOCKS = "bucket int, n int, data binary"


def _values(counts: np.ndarray, scope: str) -> np.ndarray:
    """Six values an item, see Model."""
    at = 2 * SCOPES.index(scope)
    sums = counts[:, 6:8] + counts[:, 8:10] if scope == "all" else counts[:, 6 + at : 8 + at]
    return np.column_stack([counts[:, at : at + 2], sums, counts[:, 10 + at : 12 + at]]).astype(np.float32)


def _opened(blocks: DataFrame) -> DataFrame:
    """(item, often, is_word, v_0, v_1, v_all): the items of blocks as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, n in zip(batch.column("data"), batch.column("n").to_pylist()):
                item, is_word, *counts = opened(data.as_py(), n, *_BLOCK)
                counts = np.column_stack(counts)
                values = {f"v_{s}": pa.array(list(_values(counts, s)), pa.list_(pa.float32())) for s in SCOPES}
                yield pa.record_batch({"item": item.view(np.int64), "often": counts[:, 4:10].sum(1), "is_word": is_word.astype(bool)} | values)

    return blocks.mapInArrow(run, "item long, often long, is_word boolean, v_0 array<float>, v_1 array<float>, v_all array<float>")


class Model:
    """Sums over all words of one scope; columns are ordinary, toxic. Values of items are rows of a table:

    of a word: continuation counts, sums of the counts of the pairs it begins, what the discount takes off those;
    of a pair: counts.
    """

    def __init__(self, total: np.ndarray, taken: np.ndarray):
        self.shared = max(1.0, total.sum())
        self.total = np.maximum(1.0, total)
        self.rest = np.maximum(taken / self.total, 1e-9)

    def ratios(self, context: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary), given the context and without; 0 for words neither has seen."""
        n = word[:, :2].astype(np.float64)
        both = n.sum(1, keepdims=True)
        low = np.maximum(n - DISCOUNT, 0) / self.total + self.rest * both / self.shared
        seen = np.maximum(context[:, 2:4], 1).astype(np.float64)
        weight = np.where(context[:, 2:4] > 0, context[:, 4:6] / seen, 1)
        p = np.maximum(pair[:, :2].astype(np.float64) - DISCOUNT, 0) / seen + weight * low
        logs = np.log(np.maximum(np.stack([p, low]), 1e-30))
        return np.where(both[:, 0] > 0, logs[:, :, 1] - logs[:, :, 0], 0.0)

    def features(self, word: np.ndarray, pair: np.ndarray, real: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text: mean ratio given contexts, and without, mean excess of clear ratios, the means over the most toxic
        run, given contexts and without, and the log of the summed excess. All 0 for a text without words."""
        out = np.zeros((len(at) - 1, FEATURES))
        ratio = np.where(real, self.ratios(word[:-1], word[1:], pair), 0.0)
        total = np.zeros((3, len(word) + 1))
        np.cumsum(np.vstack([ratio, np.maximum(ratio[1:] - CLEAR, 0)]), axis=1, out=total[:, 2:])
        for i in range(len(out)):
            run = total[:, at[i] + 1 : at[i + 1] + 1]
            n = run.shape[1] - 1
            if n:
                width = min(RUN, n)
                whole = run[:, -1] - run[:, 0]
                out[i] = np.concatenate([whole / n, (run[:2, width:] - run[:2, :-width]).max(1) / RUN, [np.log1p(whole[2])]])
        return out


class Known:
    """Items with their values, sorted, and the bitmap of items that may be known elsewhere."""

    def __init__(self, items: np.ndarray, values: np.ndarray, bitmap: np.ndarray | None = None):
        order = np.argsort(items)
        self.items, self.values, self.bitmap = items[order], values[order], bitmap

    def places(self, items: np.ndarray) -> np.ndarray:
        """Row of each item, -1 where there is none."""
        if not len(self.items):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        return np.where(self.items[at] == items, at, -1)

    def put(self, items: np.ndarray, out: np.ndarray) -> None:
        at = self.places(items)
        out[at >= 0] = self.values[at[at >= 0]]

    def elsewhere(self, items: np.ndarray) -> np.ndarray:
        """Which items are not here and may be known elsewhere."""
        if self.bitmap is None:
            return np.zeros(len(items), bool)
        bit = items & (64 * len(self.bitmap) - 1)
        out = (self.bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)) != 0
        out[out] = self.places(items[out]) < 0
        return out


def _items(pairs: DataFrame) -> tuple[DataFrame, dict[str, Model]]:
    """All items (item, often, is_word, v_0, v_1, v_all) and the models of all scopes, from the counts of pairs (context, word,
    k0..k3: ordinary and toxic of half 0, of half 1). A pair with no count above the discount adds nothing to a score."""
    buckets = _buckets(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(f"k{k}").to_numpy().astype(np.int64) for k in range(4)])
            columns = _counts(batch.column("context").to_numpy(), batch.column("word").to_numpy(), counts)
            yield _in_buckets((columns[0] % np.uint64(buckets)).astype(np.int64), columns)

    items = _opened(pairs.mapInArrow(run, _BLOCKS).groupBy("bucket").applyInArrow(_added, _BLOCKS))
    return items, _models(items)


def _models(items: DataFrame) -> dict[str, Model]:
    n = {f"{s}_{y}": F.col(f"v_{s}")[y].cast("double") for s in SCOPES for y in (0, 1)}
    row = items.where("is_word").agg(*[F.sum(v).alias(f"n_{k}") for k, v in n.items()], *[F.sum(F.least(v, F.lit(float(DISCOUNT)))).alias(f"t_{k}") for k, v in n.items()]).first()
    of = lambda c, s: np.array([row[f"{c}_{s}_{y}"] or 0.0 for y in (0, 1)])
    return {s: Model(of("n", s), of("t", s)) for s in SCOPES}


def _known(items: DataFrame) -> tuple[Known, DataFrame | None]:
    """What is broadcast of items (item, often, v), and the rest of them, None if there is none."""
    counts = items.groupBy("often").count().toArrow()
    often, number = counts["often"].to_numpy(), counts["count"].to_numpy()
    order = np.argsort(-often)
    fits = int((np.cumsum(number[order]) <= CACHE).sum())
    least = int(often[order[fits - 1]]) if fits else int(often.max(initial=0)) + 1
    top = items.where(F.col("often") >= least).select("item", "v").toArrow().combine_chunks()
    width = len(top["v"][0]) if len(top) else 0
    values = top["v"].combine_chunks().flatten().to_numpy().reshape(len(top), width) if len(top) else np.zeros((0, 0), np.float32)
    if fits == len(often):
        return Known(top["item"].to_numpy(), values), None
    rest = items.where(F.col("often") < least).select("item", "v")
    left = int(number[order[fits:]].sum())
    bits = min(MOST_BITMAP_BITS, max(BITMAP_BITS, (8 * left - 1).bit_length()))
    bit = F.col("item").bitwiseAND((1 << bits) - 1)
    found = rest.select(F.shiftright(bit, 6).alias("at"), bit.bitwiseAND(63).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Known(top["item"].to_numpy(), values, bitmap), rest


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """Runs of about TEXTS characters: their rows and texts. They do not depend on how the rows come in batches, which
    differs with the columns that a scan reads."""
    held, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            if size and size + len(text) > TEXTS:
                yield [*held, batch.slice(start, i - start)], texts
                held, texts, size, start = [], [], 0, i
            texts.append(text)
            size += len(text) + 8
        held.append(batch.slice(start))
    if texts:
        yield held, texts


class _Answers:
    """What the items that runs of texts asked for are worth, as a task reads it."""

    def __init__(self, path: str, shelves: int, width: int):
        self.fs, self.base = pafs.FileSystem.from_uri(path)
        self.shelves, self.width = shelves, width

    def to(self, asked: np.ndarray, buckets: int) -> Known:
        name = _ask_name(asked)
        rows = pq.ParquetDataset(f"{self.base}/shelf={name[0] % self.shelves}", filesystem=self.fs, partitioning=None).read()
        rows = rows.filter(pa.compute.and_(pa.compute.equal(rows["name_0"], name[0]), pa.compute.equal(rows["name_1"], name[1])))
        if len(set(rows["bucket"].to_pylist())) != len(np.unique(asked.view(np.uint64) % np.uint64(buckets))):
            raise ValueError("a run of texts finds no answers: two scans of the table gave its rows in another order; store it first")
        values = np.zeros((len(asked), self.width), np.float32)
        hit = np.zeros(len(asked), bool)
        own = (asked.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        for bucket, n, bits, data in zip(rows["bucket"].to_pylist(), rows["n"].to_pylist(), rows["hit"], rows["data"]):
            at = np.flatnonzero(own == bucket)
            at = at[np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(at)).astype(bool)]
            if n:  # equal runs have asked the same and are answered the same
                values[at] = np.column_stack(opened(data.as_py(), n, *[np.uint64] * self.width))
                hit[at] = True
        return Known(asked[hit], values[hit])


def _ask_name(asked: np.ndarray) -> tuple[int, int]:
    low, high = np.frombuffer(xxhash.xxh3_128_digest(asked.tobytes()), np.int64)
    return int(low) >> 1 & (1 << 62) - 1, int(high)


def _answered(asks: DataFrame, blocks: DataFrame, scopes: list[str], shelves: int) -> str:
    """Where the answers to asks (name_0, name_1, bucket, n, data) are stored, by shelf."""
    width = 6 * len(scopes)

    def run(asking: pa.Table, known: pa.Table) -> pa.Table:
        if known.num_rows:
            item, _, *counts = opened(known["data"][0].as_py(), known["n"][0].as_py(), *_BLOCK)
            counts = np.column_stack(counts)
            values = np.hstack([_values(counts, s) for s in scopes]).astype(np.uint64)
        else:
            item, values = np.zeros(0, np.uint64), np.zeros((0, width), np.uint64)
        n, bits, data = [], [], []
        for size, wanted in zip(asking["n"].to_pylist(), asking["data"]):
            (own,) = opened(wanted.as_py(), size, np.uint64)
            at = np.minimum(np.searchsorted(item, own), max(0, len(item) - 1))
            hit = item[at] == own if len(item) else np.zeros(len(own), bool)
            n.append(int(hit.sum()))
            bits.append(np.packbits(hit).tobytes())
            data.append(block(*[np.ascontiguousarray(c) for c in values[at[hit]].T]) if n[-1] else b"")
        names = {c: asking[c] for c in ("name_0", "name_1", "bucket")}
        return pa.table({"shelf": pa.array(asking["name_0"].to_numpy() % shelves, pa.int32())} | names | {"n": pa.array(n, pa.int32()), "hit": pa.array(bits, pa.binary()), "data": pa.array(data, pa.binary())})

    answers = asks.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(run, "shelf int, name_0 long, name_1 long, bucket int, n int, hit binary, data binary")
    path = shared_path(asks.sparkSession, "toxicity-answers")
    answers.repartition("shelf").write.partitionBy("shelf").option("compression", "zstd").parquet(path)
    return path


def _featured(rows: DataFrame, blocks: DataFrame, scopes: list[str], models: dict[str, Model]) -> tuple[DataFrame, list]:
    """The columns of rows but the text, and f, the features under each scope's model one after the other; broadcasts to destroy.

    rows: text, ..., scanned twice: the same scan gives the same runs of texts. blocks: the items.
    """
    kept = [c for c in rows.columns if c != "text"]
    known, rest = _known(_opened(blocks).select("item", "often", F.concat(*[f"v_{s}" for s in scopes]).alias("v")))
    size, buckets = 6 * len(scopes), _buckets(rows)
    own_models = [models[s] for s in scopes]
    shelves = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def laid_out(texts: list[str]):
        word, at = _words(texts)
        pair = _pair_items(word) if len(word) else word
        return word, pair, _real(word, at) if len(word) else np.zeros(0, bool), at

    def asked(word, pair, real, at) -> np.ndarray:
        """The distinct items that are not broadcast and may be known, ascending."""
        each = np.sort(np.concatenate([word, pair[real]]).view(np.uint64))
        each = each[np.concatenate([[True], each[1:] != each[:-1]])[: len(each)]].view(np.int64)
        return each[shared.value.elsewhere(each)]

    def of_some(word, pair, real, at, more: Known | None) -> np.ndarray:
        values = [np.zeros((len(x), size), np.float32) for x in (word, pair)]
        for x, out in zip((word, pair), values):
            for source in (shared.value, more):
                if source is not None and len(source.items):
                    source.put(x, out)
        if len(word) < 2:
            return np.zeros((len(at) - 1, FEATURES * len(scopes)))
        return np.hstack([m.features(values[0][:, 6 * i : 6 * i + 6], values[1][:, 6 * i : 6 * i + 6], real, at) for i, m in enumerate(own_models)])

    def features(word, pair, real, at, more: Known | None = None) -> np.ndarray:
        """Of some texts at a time, as the values of every word take much room."""
        out, i = [np.zeros((0, FEATURES * len(scopes)))], 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + WORDS, "right")) - 1)
            a, b = at[i], at[j]
            out.append(of_some(word[a:b], pair[a : b - 1], real[a : b - 1], at[i : j + 1] - a, more))
            i = j
        return np.vstack(out)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _runs(batches):
            wanted = asked(*laid_out(texts))
            if len(wanted):
                name = _ask_name(wanted)
                item = wanted.view(np.uint64)
                out = _in_buckets((item % np.uint64(buckets)).astype(np.int64), [item])
                yield pa.record_batch({"name_0": np.full(out.num_rows, name[0]), "name_1": np.full(out.num_rows, name[1])} | {c: out.column(c) for c in out.schema.names})

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("f", T.ArrayType(T.DoubleType()))])
    path = None
    if rest is not None:
        asks = rows.select("text").mapInArrow(asking, "name_0 long, name_1 long, bucket int, n int, data binary")
        path = _answered(asks, blocks, scopes, shelves)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = path and _Answers(path, shelves, size)
        for held, texts in _runs(batches):
            laid = laid_out(texts)
            wanted = asked(*laid) if answers else ()
            f = features(*laid, answers.to(wanted, buckets) if len(wanted) else None)
            for part in held:
                own, f = f[: part.num_rows], f[part.num_rows :]
                if part.num_rows:
                    yield pa.record_batch({c: part.column(c) for c in kept} | {"f": pa.array(list(own), pa.list_(pa.float64()))})

    return rows.mapInArrow(scored, schema), [shared]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, Model], np.ndarray]:
    """The blocks of items and the models of all rows that may be learned from, and the curve's weights, the constant first."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    usable = labelled(labels, "toxic")
    texts = prefiltered(text_of(docs, "doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)), usable, "doc_id")
    train = texts.join(usable, "doc_id").select("text", "y", half)
    buckets = _buckets(docs)
    pairs = train.mapInArrow(_pair_blocks(buckets), _BLOCKS).groupBy("bucket").applyInArrow(_item_blocks(buckets), _BLOCKS)
    blocks = stored(pairs.groupBy("bucket").applyInArrow(_added, _BLOCKS), "toxicity-items")
    models = _models(_opened(blocks))

    sample = usable.select("doc_id", "y", half).orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(CURVE_ROWS)
    rows = documents_by_id(docs, sample).select("y", "half", "text")
    featured, used = _featured(rows, blocks, ["1", "0"], models)
    curve = featured.select("y", F.slice("f", F.col("half") * FEATURES + 1, F.lit(FEATURES)).alias("f")).toArrow()
    for b in used:
        b.destroy()
    y = curve["y"].to_numpy()
    weights = np.array([-30.0] + [0.0] * FEATURES)
    if len(y):
        x = np.stack(curve["f"].to_pylist())
        spread = x.std(0) + 1e-9
        weights = logistic(x / spread, y, ridge=0.05)
        weights[1:] /= spread
    return blocks, models, weights


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio, peak_ratio), one row per row of docs.

    docs: doc_id, text; labels: doc_id, toxic. Labels of ids whose crc32 modulo 3 is 1 are never read. A null or empty
    text has ratios 0 and gets the curve's value there. A null doc_id is scored, not learned from. Labels other than 0 and
    1 are ignored, of repeated labels of an id the larger counts, repeated documents are scored each. Without any usable
    label all scores are nearly 0. Other columns are ignored.
    """
    scored = _scored(text_of(docs, F.col("doc_id").cast("long").alias("doc_id")), *fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "log_ratio", "peak_ratio")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they were."""
    rows, _ = carried(docs)
    return _scored(rows, *fit(docs, labels)).where(F.col("score") < threshold).select("row.*")


def _scored(rows: DataFrame, blocks: DataFrame, models: dict[str, Model], weights: np.ndarray) -> DataFrame:
    """The columns of rows but the text, log_ratio, peak_ratio and score of every row."""
    featured, _ = _featured(rows, blocks, ["all"], models)
    z = F.lit(float(weights[0]))
    for i in range(FEATURES):
        z = z + F.col("f")[i] * F.lit(float(weights[i + 1]))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return featured.select(*[c for c in rows.columns if c != "text"], F.col("f")[0].alias("log_ratio"), F.col("f")[3].alias("peak_ratio"), score.alias("score"))
