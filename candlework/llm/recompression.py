"""Long repeats across documents by recompression.

Words get 128-bit names by their content. A round first replaces each maximal run of one symbol by a name of (symbol,
length), then each pair of a left and a right symbol by a name of the pair; one hashed bit of a symbol's name tells its
side. Names are made from names, so all tasks give equal content equal names in every round without a dictionary, and
whether two symbols join depends on these two alone. A boundary that outlives r steps does so in every occurrence of the
few symbols around it, its context. Equal windows of words thus contain the same outliving boundaries wherever their
contexts lie within the window; only symbols at a window's ends differ with what surrounds it.

Of every window, the boundary of the highest of three steps whose context lies within is its anchor, the one with the largest hash
of its context if there are several. Neighbouring windows mostly share one. The table goes through three scans:

1. every slice of texts asks which of its anchors other slices have too: those shared symbols reveal possible repeats;
2. only windows on a shared anchor are verified, by 96 bits of names of all their words with their smallest doc_id;
3. windows that also start in a document with a smaller id remove the words they cover.

Anchors filter and never decide, so results are those of comparing all windows. Keys are asked for through blocks, see
`slices`; a passage that a third of all documents share is one key a slice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candlework.llm.slices import Answers, Slice, asked, buckets_for, each, packed

WINDOW = 13
#: Steps whose boundaries serve as anchors. After three, a context has 6 to 7 words and a text about one anchor every three
#: words; further steps make keys that fewer texts share by chance, but more of them.
STEPS = 3
_FAR = 1 << 60
_P = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of _P modulo 2^64.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Base, its inverse and hashed bytes of either name.
_NAMINGS = [(np.uint64(p), np.uint64(pow(p, -1, 1 << 64)), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(p))) for p in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_WHITE, _IS_WHITE = re.compile(rb"[\x20\x09-\x0d]"), np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_PIECE = 1 << 16
_SIDES = (np.arange(64) * 0x51A3).astype(np.uint64)


def _powers(of: np.uint64, n: int) -> np.ndarray:
    """of to the power of 0 to n."""
    return np.concatenate([np.ones(1, np.uint64), np.full(n, of)]).cumprod(dtype=np.uint64)


@lru_cache(maxsize=8)
def _piece_powers(of: int) -> np.ndarray:
    return _powers(np.uint64(of), 2 * _PIECE)


def _pieces(data: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about _PIECE bytes that end after white space, so that no word is cut; data ends with white space."""
    a = 0
    while a < len(data):
        b = min(a + _PIECE, len(data))
        b = _WHITE.search(data, b - 1).end()
        yield a, b
        a = b


def hashed_words(data: bytes, outside: np.ndarray, namings: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where words begin in data, and `namings` names of each. Words are runs of bytes that are not `outside`, a table of 256;
    white space is outside, and data ends with it.

    A name is a polynomial of hashed bytes modulo 2^64, taken from prefix sums, then mixed; the two have other bases and bytes.
    """
    starts, names = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(namings)]
    for a, b in _pieces(data):
        own = np.frombuffer(data, np.uint8, b - a, a)
        white = np.concatenate([[True], outside[own]])
        edge = np.flatnonzero(white[1:] != white[:-1])
        start, end = edge[::2], edge[1::2]
        starts.append(start + a)
        for (base, inverse, of_byte), out in zip(_NAMINGS, names):
            # only a word of a piece's length makes a longer piece
            power, back = (_piece_powers(int(x)) if len(own) <= 2 * _PIECE else _powers(x, len(own)) for x in (base, inverse))
            sums = np.empty(len(own) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(of_byte[own] * power[: len(own)], dtype=np.uint64, out=sums[1:])
            out.append(mix((sums[end] - sums[start]) * back[start]))
    return np.concatenate(starts), [np.concatenate(n) for n in names]


def named(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two names of every word of all texts, and where each text begins (and the end)."""
    start, (first, second) = hashed_words(b"\n".join([*texts, b""]), _IS_WHITE, 2)
    return first, second, np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))


def steps(name: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """After each step, run and pair in turn: (place, context from, context to) of the boundaries within texts that outlive
    it and whose context has at most `most` words. Ends when there are none."""
    texts = len(at) - 1
    size = np.diff(at) + 1
    end = np.cumsum(size)
    first, last = np.zeros(end[-1] if texts else 0, bool), np.zeros(end[-1] if texts else 0, bool)
    first[end - size] = last[end - 1] = True
    place = np.arange(len(first)) - np.repeat(np.arange(texts), size)
    low, high = place.copy(), place.copy()
    symbol = np.zeros(len(first), np.uint64)
    symbol[~last] = name  # of the symbol that begins here
    number = 0
    while not (first | last).all():
        before, after = np.roll(symbol, 1), symbol
        if number % 2 == 0:
            joined = before == after
        else:
            side = mix(symbol ^ _SIDES[number % len(_SIDES)]) >> np.uint64(63)
            joined = (np.roll(side, 1) == 0) & (side == 1)
        kept = first | last | ~joined
        low, high = np.where(first, -_FAR, np.roll(low, 1))[kept], np.where(last, _FAR, np.roll(high, -1))[kept]
        start = np.flatnonzero(kept)
        length = np.diff(np.append(start, len(kept))).astype(np.uint64)
        whole = symbol[start]
        longer = length > 1
        if number % 2 == 0:
            whole[longer] = mix(whole[longer] * _P + length[longer])
        else:
            whole[longer] = mix(whole[longer] * _P ^ mix(symbol[start[longer] + 1]))
        symbol, place, first, last = whole, place[kept], first[kept], last[kept]
        near = high - low <= most
        if not near.any():
            return
        yield place[near], low[near], high[near]
        number += 1


def _sums(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of names times powers, and the inverse powers: names of stretches in two look-ups."""
    power, inverse = _powers(_P, len(name)), _powers(_INVERSE, len(name))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(name * power[:-1], dtype=np.uint64)]), inverse


def _stretch(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[0][b] - sums[0][a]) * sums[1][a])


def windows(at: np.ndarray, width: int) -> np.ndarray:
    """Which words begin a window within their text."""
    out = np.zeros(at[-1], bool)
    for a, b in zip(at[:-1], at[1:]):
        out[a : max(a, b - width + 1)] = True
    return out


def anchors(name: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The anchor of the window at every word: the step in the upper 5 bits, then a hash of its context; the window's own hash
    where no boundary outlives a step. Without meaning where no window begins."""
    sums = _sums(name)
    best = np.zeros(len(name) + width, np.uint64)  # of the window that begins `width` words earlier
    wanted = windows(at, width)
    for number, (place, low, high) in reversed([*enumerate(islice(steps(name, at, width), STEPS), 1)]):
        if number < STEPS:  # only where windows are left
            left = np.concatenate([np.zeros(1, np.int64), np.cumsum(wanted)])
            some = left[low + 1] > left[np.maximum(high - width, 0)]
            place, low, high = place[some], low[some], high[some]
        own = _stretch(sums, low, high) ^ mix((place - low).astype(np.uint64) * _P)
        own = own >> np.uint64(5) | np.uint64(number) << np.uint64(59)
        size = high - low
        order = np.argsort(size, kind="stable")
        high, own = high[order], own[order]
        fits = np.searchsorted(size[order], width - np.arange(width), "right")  # contexts that leave so much room
        for back, n in enumerate(fits):
            np.maximum.at(best, high[:n] + back, own[:n])
        wanted &= best[width:] == 0
        if not wanted.any():
            break
    best = best[width:]
    alone = np.flatnonzero(wanted)
    best[alone] = _stretch(sums, alone, alone + width) >> np.uint64(5)
    return best


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, which of them have several owners, and each key's place among them; owners ascend."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(keys)) - 1 if len(start) else start
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[start], owner[order[start]] != owner[order[last]], place


def repeated_words(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    Removes every word that is covered by a window of `width` words whose sequence also starts in a document with a smaller
    doc_id, all judged on docs as they are. docs: doc_id, text. Words are runs of other bytes than space and \\t to \\r. A
    null or empty text has no words and the digest of the empty text; a text shorter than a window loses none. A null doc_id
    counts as larger than all others and equal to null. Rows with equal ids do not remove from each other. An empty table
    gives an empty result. A very long text is one slice, held whole with some arrays of 8 bytes a word. Other columns are
    ignored.
    """
    slices = packed(docs, "recompression-slices")
    buckets = buckets_for(slices)

    def anchored(own: Slice) -> tuple:
        first, second, at = named(own[2])
        there = np.flatnonzero(windows(at, width))
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[there]
        key = anchors(first, at, width)[there]
        return first, second, at, there, owner, *_distinct(key, owner)

    def ask_anchors(slices: Iterator[Slice]) -> Iterator[list[np.ndarray]]:
        for own in slices:
            yield [anchored(own)[5]]

    def in_several(columns: list[np.ndarray]) -> np.ndarray:
        _, place, n = np.unique(columns[0], return_inverse=True, return_counts=True)
        return n[place] > 1

    shared = asked(slices, ask_anchors, [], in_several, buckets, "recompression-shared")

    def verified(own: Slice, answers: Answers) -> tuple:
        """The windows on shared anchors (first word), their key each, and the distinct keys with a check and the smallest id."""
        first, second, at, there, owner, distinct, several, place = anchored(own)
        known = (answers.of(own[0], distinct, buckets) | several)[place]
        there, owner = there[known], owner[known]
        key = _stretch(_sums(first), there, there + width)
        check = (_stretch(_sums(second), there, there + width) >> np.uint64(32)).astype(np.uint32)
        ids = own[1][owner]
        order = np.lexsort((ids, check, key))
        new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)])[: len(order)]
        lead = order[new]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return at, there, ids, place, [key[lead], check[lead], ids[lead]]

    def ask_windows(slices: Iterator[Slice]) -> Iterator[list[np.ndarray]]:
        known = Answers(shared)
        for own in slices:
            yield verified(own, known)[4]

    def after_smaller(columns: list[np.ndarray]) -> np.ndarray:
        key, check, ids = columns
        order = np.lexsort((ids, check, key))
        new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)])[: len(order)]
        least = ids[order][new]
        out = np.empty(len(order), bool)
        out[order] = ids[order] > least[np.cumsum(new) - 1]
        return out

    later = asked(slices, ask_windows, [np.uint32, np.int64], after_smaller, buckets, "recompression-later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, removed = Answers(shared), Answers(later)
        for own in each(batches):
            at, there, ids, place, (key, check, least) = verified(own, known)
            goes = (removed.of(own[0], key, buckets)[place] | (ids > least[place])) if len(key) else np.zeros(0, bool)
            edge = np.zeros(at[-1] + 1, np.int64)
            np.add.at(edge, there[goes], 1)
            np.add.at(edge, there[goes] + width, -1)
            stays = np.cumsum(edge)[:-1] == 0
            rows = []
            for text, a, b in zip(own[2], at[:-1], at[1:]):
                words = text.split()
                kept = words if stays[a:b].all() else list(compress(words, stays[a:b]))
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, digest = zip(*rows) if rows else ((), (), ())
            doc_id = pa.array(own[1], mask=own[1] == np.iinfo(np.int64).max)
            yield pa.record_batch({"doc_id": doc_id, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return slices.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
