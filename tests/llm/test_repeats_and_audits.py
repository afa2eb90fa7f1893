"""Long repeats, spelling variants and the filter audit: brute force and edge cases on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlework.llm import filter_audit, recompression, slices, spelling

DOCS = "doc_id long, text string, source string, slice long, n long, part string, mask int, word string"
SPACE = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéÀ") for _ in range(rng.randint(2, 4))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows(words):
    """Texts with shared passages of many lengths, copies, runs of one word, odd white space, nulls, and one long varied text."""
    rng = random.Random(12)
    out, passages = [], [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for passage in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = passage
        if i % 9 == 0:
            text[3:3] = ["la"] * rng.randint(5, 40)
        out.append((i * 3, rng.choice([" ", "\n", " \t"]).join(text), f"s{i % 3}"))
    out += [(1000 + i, out[i][1], "s1") for i in range(30)]  # copies
    out += [(2000 + i, out[i][1] + " more $", None) for i in range(10)]
    # between \\t and space lie only these; a no-break space or a line separator is part of a word
    out += [(3000, "a\x0bb\x0cc\rd\x1ce\x85f g h " * 9, "s2"), (3001, "a b c d\x1ce\x85f g h " * 9, "s2")]
    out += [(4000, None, None), (4001, "", ""), (4002, " \n", "s1"), (None, out[5][1], "s0"), (None, out[5][1], "s0"), (None, None, None)]
    out += [(5000, "twice the same id " * 9, "s0"), (5000, "twice the same id " * 9, "s0"), (4999, "twice the same id " * 5, "s2")]
    out += [(6000, " ".join(rng.choice(words) for _ in range(60_000)), "s1"), (-7, out[2][1], "s1"), (6001, "x" * 100_000 + " y", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "p", 3, "w") for i, t, s in rows], DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    found = [(i, k % 2, int(k % 3 == 0), "zz") for k, (i, _, _) in enumerate(rows) if k % 4]
    return spark.createDataFrame(found + [(0, 0, 1, "a"), (0, 1, 0, "b"), (None, 1, 1, "c"), (3, None, None, "d"), (-99, 1, 1, "e")], "doc_id long, quality int, toxic int, text string").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def repeats_by_force(rows, width=13):
    far = 1 << 62
    split = [(far if i is None else i, SPACE.findall(t or "")) for i, t, _ in rows]
    first = {}
    for i, words in split:
        for p in range(len(words) - width + 1):
            key = tuple(words[p : p + width])
            first[key] = min(first.get(key, far), i)
    out = []
    for i, words in split:
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - width + 1):
            if first[tuple(words[p : p + width])] < i:
                gone[p : p + width] = True
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((None if i == far else i, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats_match_all_windows(docs, rows):
    got = [tuple(r) for r in recompression.repeated_words(docs).collect()]
    want = repeats_by_force(rows)
    assert Counter(got) == Counter(want)
    assert sum(r[2] > 0 for r in want) > 60 and any(0 < r[2] < r[1] for r in want)


def test_repeats_across_slices(spark, docs, rows, monkeypatch):
    """Small slices: nearly every repeat lies in two of them, and answers come from buckets."""
    monkeypatch.setattr(recompression, "packed", lambda d, label: slices.packed(d, label, 2_000))
    got = [tuple(r) for r in recompression.repeated_words(docs).collect()]
    assert Counter(got) == Counter(repeats_by_force(rows))


def test_repeats_of_nothing(spark, none):
    assert recompression.repeated_words(none).count() == 0
    one = spark.createDataFrame([(1, "too short for a window")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in recompression.repeated_words(one).collect()] == [(1, 5, 0)]


def test_anchors_depend_on_the_window_alone():
    """Equal windows have equal anchors whatever surrounds them, also at the ends of texts and inside runs."""
    rng = random.Random(5)
    window = [b"w%d" % rng.randrange(4) for _ in range(13)]
    for inner in (window, [b"a"] * 13, [b"a"] * 12 + [b"b"], [b"a", b"b"] * 6 + [b"a"]):
        found = set()
        for _ in range(60):
            before = [rng.choice([b"a", b"b", *window]) for _ in range(rng.randint(0, 9))]
            after = [rng.choice([b"a", b"b", *window]) for _ in range(rng.randint(0, 9))]
            other = [b"z"] * rng.randint(0, 3)
            name, _, at = recompression.named([b" ".join(other), b" ".join(before + inner + after), b""])
            found.add(int(recompression.anchors(name, at, 13)[len(other) + len(before)]))
        assert len(found) == 1


def test_blocks_return_their_columns():
    rng = np.random.default_rng(1)
    for n in (1, 7, 5_000):
        columns = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)), rng.integers(0, 99, n).astype(np.uint32), rng.integers(-9, 9, n)]
        back = slices.opened(slices.block(*columns), n, np.uint64, np.uint32, np.int64)
        assert all((a == b).all() for a, b in zip(columns, back))


def words_by_force(rows):
    counts = Counter()
    for i, text, _ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def edits(word):
    """All words one edit away."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters if c != word[i])


def variants_by_force(counts):
    best, out = {}, []
    for word in counts:
        near = {x for x in edits(word) if x in counts} if len(word) < 99 else set()
        top = min(near, key=lambda x: (-counts[x], x), default=None)
        form = top if top is not None and counts[top] >= 5 * counts[word] else None
        best[word] = form
        out.append([word, counts[word], len(near), form, counts[form] if form else None])
    for row in out:
        root = row[0]
        while best[root]:
            root = best[root]
        row.append(root)
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def written(rows, words):
    """Many texts whose words are spelled wrong now and then."""
    rng = random.Random(13)
    more = []
    for i in range(300):
        found = []
        for _ in range(60):
            word = rng.choice(words[:120])
            if rng.random() < 0.08:
                word = rng.choice(list(edits(word)))[:40] if rng.random() < 0.3 else word[:-1] + "x"
            found.append(word.upper() if rng.random() < 0.1 else word)
        more.append((10_000 + i, "; ".join(found), "s1"))
    # a chain of forms: 5, 25 and 125 times
    more += [(20_000 + i, "chaining " * 125 + "chainine " * 25 + "chaixine " * 5, "s1") for i in range(1)]
    return rows + more


def test_variants_match_all_edits(spark, written):
    docs = spark.createDataFrame([(i, t, s, 1, 2, "p", 3, "w") for i, t, s in written], DOCS).repartition(3)
    want = variants_by_force(words_by_force(written))
    got = Counter(tuple(r) for r in spelling.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == want
    roots = {r[0]: (r[3], r[5]) for r in want}
    assert roots["chaixine"] == ("chainine", "chaining") and sum(r[3] is not None for r in want) > 20


@pytest.mark.parametrize("upper, part, gathered", [(1, 200_000, 100_000), (3, 4, 50), (0, 16, 10)])
def test_variants_with_divided_keys(spark, written, monkeypatch, upper, part, gathered):
    """Full keys are divided, and rows are searched in small pieces: the pairs are the same."""
    monkeypatch.setattr(spelling, "_GATHERED", gathered)
    counts = dict(sorted(words_by_force(written).items())[:400])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = Counter((r.word, r.other) for r in spelling.near_words(words, upper=upper, part=part).collect())
    assert got == Counter((w, x) for w in counts if len(w) < 99 for x in {x for x in edits(w) if x in counts})
    assert len(got) > 20


def test_variants_of_nothing(spark, none):
    assert spelling.spelling_variants(none).count() == 0
    few = spark.createDataFrame([(1, "seldom"), (2, None), (3, "")], "doc_id long, text string")
    assert spelling.spelling_variants(few).count() == 0


def test_vector_bound_loses_no_pair():
    """Counts above the bound of the vectors share a branch."""
    words = ["a" * 15, "a" * 16, "a" * 17, "a" * 16 + "b", "b" + "a" * 16, "a" * 14]
    group_of = np.zeros(256, np.int64)
    group_of[ord("b")] = 1
    vector = spelling.vectors(words, group_of, 2)
    trie = spelling.Trie(np.zeros(len(words), np.int64), vector)
    yes = np.ones(len(words), bool)
    pairs = {(a, b) for a, b in zip(*(x.tolist() for x in trie.search(np.zeros(len(words), np.int64), vector, yes, yes))) if spelling.one_edit(words[a], words[b])}
    assert pairs == {(i, j) for i in range(6) for j in range(6) if words[j] in set(edits(words[i]))}


def audit_by_force(rows, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, s in rows:
        t = t or ""
        words = SPACE.findall(t)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        judged.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                failing = sum(x in j[1] for j in own)
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(j[1] == {x} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_audit_matches_every_order(docs, rows, labels):
    got = {(r[0], r[1], r[2]): list(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    want = audit_by_force(rows, [tuple(r) for r in labels.collect()])
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_with_frequent_copies(spark, monkeypatch):
    """The most frequent texts are joined by broadcast, others by a shuffle: E is the same."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["one", "two", "x" * rng.randint(1, 40)]), f"s{i % 2}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = audit_by_force(rows, [])
    for hot in (2, 100, 1_000_000):
        monkeypatch.setattr(filter_audit, "HOT", hot)
        assert {(r[0], r[1], r[2]): list(r)[3:] for r in filter_audit.audit(docs, labels).collect()} == want


def test_audit_of_nothing(none, labels):
    assert filter_audit.audit(none, labels).count() == 0


def test_positional_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 8, 9, 100, 12_345):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32) & rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
