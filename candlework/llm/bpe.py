"""BPE encoding and decoding with a public vocabulary file (the JSON of the tokenizers library).

Every word starts as a doubly linked list of symbols; a priority queue holds the merges of neighbours by rank, then by
place. The best is taken, skipped if a neighbour has changed since, and the merged symbol's new neighbours are queued.
Decoding concatenates vocabulary strings, with a space between them as the file's missing decoder prescribes. Words recur,
so each Python worker keeps the encodings of recent words in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import slices, text_of

#: Most words in a worker's cache, about 400 bytes each.
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one above 255, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and word pattern of a vocabulary file. Raises ValueError on kinds of files it does not cover."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        kinds = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
        split = data["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["byte_fallback"] or model.get("ignore_merges") or data["decoder"] or data["post_processor"] or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{file}: only lower-casing BPE files with word ends are covered")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for string, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = string
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.inner = [self.ids.get(c) for c in letters]
        self.last = [self.ids.get(c + self.end) for c in letters]
        self.pattern = split["pattern"]["Regex"]


class Coder:
    """Encodes and decodes texts with one vocabulary; one per Python task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = regex.compile(vocabulary.pattern)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.recent: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word: queue of merges over a linked list of symbols."""
        v = self.v
        data = word.encode("utf-8", "replace")
        symbol = [v.inner[b] for b in data[:-1]] + [v.last[data[-1]]]
        symbol = [s for s in symbol if s is not None]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*found, i) for i in range(n - 1) if (found := v.merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, made, i = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j < 0 or v.merges.get((symbol[i], symbol[j]), (0, -1))[1] != made:
                continue  # stale: a neighbour was merged in the meantime
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := v.merges.get((made, symbol[k])):
                    heapq.heappush(queue, (*found, i))
            h = before[i]
            if h >= 0 and (found := v.merges.get((symbol[h], made))):
                heapq.heappush(queue, (*found, h))
        return [s for s in symbol if s >= 0]

    def known(self, word: str) -> list[int]:
        found = self.older.get(word)
        if found is None:
            found = self.merge(word)
        if len(self.recent) >= CACHE_WORDS // 2:
            self.older, self.recent = self.recent, {}
        self.recent[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        recent = self.recent.get
        for part in self.special.split(text) if self.special else [text]:
            if part in self.v.special:
                out.append(self.v.special[part])
                continue
            if not part.isascii():
                # lower-case by character: no final sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for word in self.word.findall(part.lower()):
                out += recent(word) or self.known(word)
                recent = self.recent.get
        return out

    def decode(self, ids: list[int]) -> str:
        strings = self.v.strings
        return " ".join([strings[i] for i in ids])


def encode_and_decode(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string), one row per row of docs.

    docs: doc_id, text; file: the vocabulary file, read on the driver and broadcast. A null or empty text, or one of white
    space alone, has no ids and decodes to "". Strings of special tokens in a text become their ids. Repeated documents
    and null ids are treated as any other; other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            for start, texts in slices(batch, "text", 1 << 20):
                ids = [coder.encode(t) for t in texts]
                at = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, at[-1])
                yield pa.record_batch({"doc_id": batch.column("doc_id")[start : start + len(texts)], "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), "decoded": pa.array([coder.decode(x) for x in ids], pa.string())})

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_and_decode's rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
