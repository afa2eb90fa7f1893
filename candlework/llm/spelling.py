"""Spelling variants by a trie over frequency vectors of letter groups.

The letters are dealt to groups of about equal frequency; a word's vector has how many letters of each group it has. One
inserted or deleted letter changes one count by one, one replaced letter raises one count and lowers another, or changes
nothing. The vectors form a trie, one group a level. A depth-first search for a word spends a budget of one surplus and
one deficit on the way down: at each level it goes on to the equal count, to the count above while it has its surplus, and
to the count below while it has its deficit. The words of the leaves it reaches are verified letter by letter.

Spark holds the upper levels: a word is filed under its first counts, and asks under every combination of them that the
budget allows, with what is left of it; of the two words of a pair only the one with the smaller key asks. A task holds the
lower levels of its keys' tries and searches all of a key's words together, level by level. Keys under which very many
words are filed are divided, and what asks goes to all their parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import stored, text_of

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: Of a document's words, one in so many loses a letter.
DAMAGED = 199
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 6, 5, 5
#: Levels of the trie, and how many of them Spark holds.
GROUPS, UPPER = 14, 4
#: Most words filed under one key that one task holds together.
PART = 200_000
#: Counts above this share a branch; the words are verified anyway.
MOST = 15
#: Different words counted in a task before they are sent on.
_HELD = 1 << 18
#: Rows gathered before they are searched, and searched at a time.
_GATHERED, _LOOKS = 100_000, 8_192


def damaged(run: str, doc_id: int | None) -> str:
    """The run, or without one letter if its hash with the document's id is divisible by DAMAGED."""
    h = zlib.crc32(run.encode(), zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":"))
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own: dict[str, int] = {}
            for run in LETTERS.findall(text.encode("utf-8", "replace").lower().decode()):  # bytes: A-Z alone
                own[run] = own.get(run, 0) + 1
            for run, n in own.items():
                word = damaged(run, doc_id)
                if len(word) >= LEAST_LETTERS:
                    held[word] = held.get(word, 0) + n
            if len(held) >= _HELD:
                yield pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
                held = {}
    if held:
        yield pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least LEAST_LETTERS letters that occur at least least_count times in all."""
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """Every letter's group: the most frequent letter left goes to the group with least. At most 90 letters are collected."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                total += np.bincount(np.frombuffer(word.encode("latin-1"), np.uint8), minlength=256)
        yield pa.record_batch({"letter": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    counts = words.select("word").mapInArrow(letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    weight, out = [0] * groups, {}
    for row in sorted(counts, key=lambda r: (-r.n, r.letter)):
        least = weight.index(min(weight))
        out[chr(row.letter)] = least
        weight[least] += row.n
    return out


def vectors(words: list[str], group_of: np.ndarray, groups: int) -> np.ndarray:
    """One row a word: its letters of every group, at most MOST each."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(owner * groups + group_of[letters], minlength=len(words) * groups)
    return np.minimum(counts, MOST).reshape(len(words), groups)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Trie:
    """Sorted vectors as tries, one for each root: at each level, the nodes' edges (node, count) and the nodes they lead to."""

    def __init__(self, root: np.ndarray, vector: np.ndarray):
        self.order = np.lexsort((*vector.T[::-1], root))
        node = root[self.order]
        self.edges = []
        for level in range(vector.shape[1]):
            found, node = np.unique(node * (MOST + 1) + vector[self.order, level], return_inverse=True)
            self.edges.append(found)
        self.start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])[: len(node)])
        self.end = np.append(self.start[1:], len(node))

    def search(self, root: np.ndarray, vector: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of vector, row that was given to the trie): all pairs below equal roots whose vectors differ by the budgets at most."""
        row, node = np.arange(len(vector)), root
        if not len(self.order):
            return row[:0], row[:0]
        for level, edges in enumerate(self.edges):
            own = vector[row, level]
            found = []
            for change, may in ((0, None), (1, surplus), (-1, deficit)):
                # a count at the bound stands for larger ones as well
                at = np.arange(len(row)) if may is None else np.flatnonzero(may & (own + change >= 0) & (own + change <= MOST))
                edge = node[at] * (MOST + 1) + own[at] + change
                place = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
                hit = edges[place] == edge
                at = at[hit]
                found.append((row[at], place[hit], surplus[at] & (change != 1), deficit[at] & (change != -1)))
            row, node, surplus, deficit = (np.concatenate(c) for c in zip(*found))
        size = (self.end - self.start)[node]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(row, size), self.order[np.repeat(self.start[node], size) + inside]


def _filed_and_asked(group_of: np.ndarray, groups: int, upper: int):
    """(key, asks, surplus, deficit, word, n): every word filed under its first counts, and asking under larger keys."""
    changes = [(i, j) for i in range(-1, upper) for j in range(-1, upper) if i != j or i == -1]  # one more in i, one less in j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = (MOST + 1) ** np.arange(upper)
        for batch in batches:
            if not batch.num_rows:
                continue
            top = vectors(batch.column("word").to_pylist(), group_of, groups)[:, :upper]
            own = top @ scale
            keys, rows, left = [], [], []
            for more, less in changes:
                ok = np.ones(len(top), bool)
                if more >= 0:
                    ok &= top[:, more] < MOST
                if less >= 0:
                    ok &= top[:, less] > 0
                key = own + (scale[more] if more >= 0 else 0) - (scale[less] if less >= 0 else 0)
                filed = more == less
                at = np.flatnonzero(ok & ((key > own) | filed))
                keys.append(key[at])
                rows.append(at)
                left.append(np.tile([[not filed, more < 0, less < 0]], (len(at), 1)))
            at, flags = np.concatenate(rows), np.concatenate(left)
            yield pa.record_batch({"key": np.concatenate(keys), "asks": flags[:, 0], "surplus": flags[:, 1], "deficit": flags[:, 2], "word": batch.column("word").take(pa.array(at)), "n": batch.column("n").take(pa.array(at))})

    return run


def _found(group_of: np.ndarray, groups: int, upper: int):
    """Over rows sorted by (key, part, asks): the pairs of words one edit apart, (word, n, other, other_n) both ways."""

    def pairs(rows: pa.Table, root: np.ndarray, compared: bool) -> Iterator[pa.RecordBatch]:
        """compared: the first key's filed words have been compared with each other."""
        words, n, asks = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["asks"].to_numpy()
        filed = np.flatnonzero(~asks)
        vector = vectors(words, group_of, groups)[:, upper:]
        budgets = [rows[c].to_numpy() for c in ("surplus", "deficit")]
        trie = Trie(root[filed], vector[filed])
        looks = np.flatnonzero(asks | (root > 0)) if compared else np.arange(len(words))
        for i in range(0, len(looks), _LOOKS):
            own = looks[i : i + _LOOKS]
            row, hit = trie.search(root[own], vector[own], *[b[own] for b in budgets])
            row, hit = own[row], filed[hit]
            once = asks[row] | (row < hit)
            good = [(a, b) for a, b in zip(row[once].tolist(), hit[once].tolist()) if one_edit(words[a], words[b])]
            if good:
                a, b = np.array(good).T
                x, y = pa.array([words[k] for k in a], pa.string()), pa.array([words[k] for k in b], pa.string())
                yield pa.record_batch({"word": pa.concat_arrays([x, y]), "n": np.concatenate([n[a], n[b]]), "other": pa.concat_arrays([y, x]), "other_n": np.concatenate([n[b], n[a]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, compared = [], 0, False
        for batch in chain(batches, [None]):
            if batch is not None:
                rest += [batch] if batch.num_rows else []
                held += batch.num_rows
            if not rest or batch is not None and held < _GATHERED:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            key, part, asks = (whole[c].to_numpy() for c in ("key", "part", "asks"))
            root = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))])
            cut = len(root) if batch is None else int(np.searchsorted(root, root[-1]))  # the last key may go on
            if cut:
                yield from pairs(whole.slice(0, cut), root[:cut], compared)
                rest, held, compared = whole.slice(cut).to_batches(), len(root) - cut, False
            else:
                # one key: what asks is answered as it comes, what is filed stays
                filed = int(np.searchsorted(asks, True))
                if filed < len(root):
                    yield from pairs(whole, root, compared)
                    rest, compared = whole.slice(0, filed).to_batches(), True
                held = 0

    return run


def near_words(words: DataFrame, groups: int = GROUPS, upper: int = UPPER, part: int = PART) -> DataFrame:
    """(word, n, other, other_n): all pairs of different words that are one edit apart, each both ways.

    words: word, n, distinct words of the letters of LETTERS, read twice.
    """
    dealt = letter_groups(words, groups)
    group_of = np.zeros(256, np.int64)
    for letter, group in dealt.items():
        group_of[ord(letter)] = group
    rows = words.mapInArrow(_filed_and_asked(group_of, groups, upper), "key long, asks boolean, surplus boolean, deficit boolean, word string, n long")
    filed = rows.where(~F.col("asks"))
    full = filed.groupBy("key").count().where(F.col("count") > part).select("key", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    full = stored(full, "spelling-full-keys")
    if full.isEmpty():
        ready = rows.withColumn("part", F.lit(0))
    else:
        # a word under a full key is filed in one part and asks in those after it; what asks from elsewhere asks in all
        columns = rows.columns
        cut = rows.join(F.broadcast(full), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        later = F.when(F.col("parts") - 1 > own, F.sequence(own + 1, F.col("parts") - 1)).otherwise(F.array().cast("array<int>"))
        everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
        ready = (
            cut.where(~F.col("asks")).select(*columns, own.alias("part"))
            .unionByName(cut.where("asks").select(*columns, F.explode(everywhere).alias("part")))
            .unionByName(cut.where(~F.col("asks")).withColumn("asks", F.lit(True)).select(*columns, F.explode(later).alias("part")))
        )
    ready = ready.repartition("key", "part").sortWithinPartitions("key", "part", "asks")
    return ready.mapInArrow(_found(group_of, groups, upper), "word string, n long, other string, other_n long")


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root): where following forms (word, form) ends. A form is always more frequent than its word, so paths end; each
    round doubles the step."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for i in range(most_rounds):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            return links
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"spelling-roots-{i}")
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root), one row per word of the vocabulary.

    A word's form is the most frequent of the words one edit away, the smallest in code-point order of equally frequent
    ones, if it occurs at least `times` times as often; root is where following forms ends, the word itself without a form.
    docs: doc_id, text. A null or empty text has no words; a null doc_id is read as the empty string in the hash that
    damages words; repeated documents count each. An empty table gives an empty result. A very long run of letters is a
    word like any other. Other columns are ignored.
    """
    words = stored(vocabulary(docs, least_count), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = stored(near.select(F.col("word").alias("near_word"), "n_near", "best.form", (-F.col("best.minus_n")).alias("form_n")), "spelling-near")
    out = words.join(near, F.col("word") == F.col("near_word"), "left")
    holds = F.col("form_n") >= times * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "spelling-forms")
    rooted = roots(out.where("form is not null")).withColumnRenamed("word", "formed")
    return out.join(rooted, F.col("word") == F.col("formed"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
