"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits by majority over the hashes of a text's word shingles. To find all pairs of fingerprints that
differ in at most r bits, each is cut into segments with radii t_i, sum of (t_i + 1) = r + 1: a pair within r bits is
within t_i bits in at least one segment i. Every distinct fingerprint is filed under its segments, and asks for the keys
in a small Hamming ball round each of them; of the two sides of a pair only the smaller key asks. Matches are verified on
all bits. Verified links are cut down to a spanning forest where they are found, so a dense group of k near copies
never yields k^2 rows, and components come from alternating large and small stars.

Equal texts have equal fingerprints and meet only once, as one distinct fingerprint. Keys under which very many are filed
are split into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import prefiltered, slices, stored, text_of

SEED = 42
RADIUS = 4
#: Of 128 bits: candidates whose shingles are then compared. Texts that share 0.8 of their shingles differ in about 19.
WIDE_RADIUS = 24
#: Least Jaccard similarity of the shingle sets of near-duplicates.
SIMILAR = 0.8
#: Most fingerprints filed under one key that one task compares with each other.
PART = 20_000
#: Pairs compared at a time.
_BLOCK = 1 << 22
#: Links a task gathers before it cuts them down; what stays is at most two a node.
LINKS = 1 << 18
#: Of a cluster whose nodes are compared pair by pair: nodes that need no further part, parts that nodes alone may make,
#: and most shingles of a part, which may make more.
CLUSTER_PART, CLUSTER_PARTS, PART_SHINGLES = 64, 32, 1 << 21


def _mixed(h: np.ndarray) -> np.ndarray:
    """Further 64 bits from a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of all runs of `words` words, in order; of the whole text if it is shorter, none without words."""
    found = text.encode("utf-8", "replace").lower().split()  # both act on ASCII alone, white space is \\t\\n\\v\\f\\r and space
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    if len(found) >= words:
        start, end = start[: len(found) - words + 1], end[words - 1 :]
    else:
        start, end = start[:1], end[-1:]
    out, digest = np.empty(len(start), np.uint64), xxhash.xxh64_intdigest
    for i in range(0, len(start), 1 << 16):
        out[i : i + (1 << 16)] = [digest(joined[a:b], SEED) for a, b in zip(start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist())]
    return out


def _majority(found: np.ndarray, width: int) -> np.ndarray:
    ones = np.zeros((width, 64), np.int64)
    for i in range(0, len(found), 1 << 16):
        hashes = found[i : i + (1 << 16)]
        for j in range(width):
            ones[j] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            hashes = _mixed(hashes)
    return np.packbits(ones.ravel() * 2 > len(found), bitorder="little").view(np.uint64)


def fingerprint(text: str, words: int = 4, width: int = 1) -> np.ndarray:
    """width numbers of 64 bits, each bit 1 where over half the shingles' hashes have 1; all 0 without words."""
    return _majority(shingles(text, words), width)


def _named_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_no, fp0, fp1, set0, set1): a fingerprint of 128 bits and a hash of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "text"):
                found = [shingles(t, words) for t in texts]
                fp = np.stack([_majority(f, 2) for f in found]).view(np.int64)
                name = np.stack([np.frombuffer(xxhash.xxh128_digest(np.unique(f).tobytes()), np.int64) for f in found])
                own = batch.slice(start, len(texts))
                yield pa.record_batch({c: own.column(c) for c in ("doc_id", "row_no")} | {"fp0": fp[:, 0], "fp1": fp[:, 1], "set0": name[:, 0], "set1": name[:, 1]})

    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"), "row_no")
    return rows.mapInArrow(run, "doc_id long, row_no long, fp0 long, fp1 long, set0 long, set1 long")


def fingerprints(docs: DataFrame, words: int = 4, width: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp0, fp1, ... up to width, long columns to carry): the fingerprint as signed longs."""
    kept = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "text"):
                values = np.stack([fingerprint(t, words, width) for t in texts]).view(np.int64)
                yield pa.record_batch({c: batch.column(c)[start : start + len(texts)] for c in kept} | {f"fp{j}": values[:, j] for j in range(width)})

    schema = ", ".join(f"{c} long" for c in [*kept, *[f"fp{j}" for j in range(width)]])
    return text_of(docs, *[F.col(c).cast("long").alias(c) for c in kept]).mapInArrow(run, schema)


def segments(n: int, radius: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of n segments whose radii add up to radius + 1 - n."""
    cuts = [round(bits * i / n) for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i], (radius + 1) // n - 1 + (i < (radius + 1) % n)) for i in range(n)]


def segments_for(count: int, radius: int) -> int:
    """Segments of a 64-bit fingerprint so that a key has a few fingerprints: about 64 / log2(count)."""
    return min(radius + 1, max(2, round(64 / max(8.0, np.log2(max(2, count)) + 2))))


def _filed_and_asked(cut: list[tuple[int, int, int]], names: list[str], carry: list[str]):
    """Rows (key, node, asks, fingerprint, columns to carry): filed under the segments, asking for larger keys in the balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                node = part.column("node").to_numpy(zero_copy_only=False)
                fp = [part.column(c).to_numpy(zero_copy_only=False) for c in [*names, *carry]]
                bit = np.unpackbits(np.stack(fp[: len(names)], axis=1).view(np.uint8), axis=1, bitorder="little")
                keys, rows, asks = [], [], []
                for number, (first, bits, radius) in enumerate(cut):
                    own = bit[:, first : first + bits].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                    masks = [0] + [sum(1 << b for b in flip) for size in range(1, radius + 1) for flip in combinations(range(bits), size)]
                    for mask in masks:
                        key = own ^ mask
                        at = np.arange(len(own)) if mask == 0 else np.flatnonzero(key > own)
                        keys.append(key[at] | number << 48)
                        rows.append(at)
                        asks.append(np.full(len(at), mask != 0))
                at = np.concatenate(rows)
                yield pa.record_batch({"key": np.concatenate(keys), "node": node[at], "asks": np.concatenate(asks)} | {c: v[at] for c, v in zip([*names, *carry], fp)})

    return run


def stars(a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Of the pairs given, the places of those of every node with its smallest partner and with the one that differs least."""
    u, v, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([differ, differ])
    out = []
    for order in (np.lexsort((v, u)), np.lexsort((v, d, u))):
        out.append(order[np.concatenate([[True], u[order][1:] != u[order][:-1]])] % len(a))
    places = np.unique(np.concatenate(out))
    pairs = np.stack([np.minimum(a[places], b[places]), np.maximum(a[places], b[places])])
    return places[np.unique(pairs, axis=1, return_index=True)[1]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked to) for every other node: links with the same components as the links given."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(node))
    return node[other], node[label[other]]


def _verified(cut: list[tuple[int, int, int]], radius: int, names: list[str], pick: str):
    """Over rows sorted by (key, part, asks, node): a forest of the verified links that `pick` names, or stars of them.

    A pair counts in the first segment alone in which it is found, and the links of a task are cut down together.
    """
    wide = [*names, *(["component"] if pick == "between" else [])]
    masks = [[(w, np.uint64(sum(1 << (b - 64 * w) for b in range(max(first, 64 * w), min(first + bits, 64 * w + 64))))) for w in range(first // 64, (first + bits - 1) // 64 + 1)] for first, bits, _ in cut]

    def links(group: np.ndarray, number: np.ndarray, asks: np.ndarray, node: np.ndarray, fp: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        first = np.concatenate([[True], group[1:] != group[:-1]])
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(group)))
        filed = np.add.reduceat(~asks, start)
        which = np.cumsum(first) - 1
        # a filed row meets those filed after it, an asking row all that are filed
        low = np.where(asks, start[which], np.arange(len(group)) + 1)
        meets = np.maximum(0, start[which] + filed[which] - low)
        meets[(length == 1)[which]] = 0
        total = np.cumsum(meets)
        at = 0
        while at < len(group):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BLOCK, "right")))
            n = meets[at:stop]
            left = np.repeat(np.arange(at, stop), n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:stop], n)
            differ = sum(np.bitwise_count(f[left] ^ f[right]).astype(np.int16) for f in fp[: len(names)])
            near = (differ <= radius) & (node[left] != node[right])
            if pick == "between":
                near &= fp[-1][left] != fp[-1][right]
            left, right, differ = left[near], right[near], differ[near]
            for earlier in range(int(number[at:stop].max())):
                apart = sum(np.bitwise_count((fp[w][left] ^ fp[w][right]) & mask) for w, mask in masks[earlier]) > cut[earlier][2]
                new = apart | (number[left] <= earlier)
                left, right, differ = left[new], right[new], differ[new]
            if len(left):
                yield fewest(node[left], node[right], differ)
            at = stop

    def fewest(a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, ...]:
        if pick == "stars":
            some = stars(a, b, differ)
            return a[some], b[some], differ[some]
        a, b = forest(a, b)
        return a, b, np.zeros(len(a), np.int16)

    def joined(rows: list[pa.RecordBatch]) -> tuple:
        whole = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: whole[c].to_numpy()
        key, part = column("key"), column("part")
        new = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        return np.concatenate([[0], np.cumsum(new)]), key >> 48, column("asks"), column("node"), [column(c).view(np.uint64) for c in wide]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            held += batch.num_rows
            if held < 200_000:
                continue
            group, number, asks, node, fp = joined(rest)
            end = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if end:
                yield from links(group[:end], number[:end], asks[:end], node[:end], [f[:end] for f in fp])
                whole = pa.Table.from_batches(rest)
                rest, held = whole.slice(end).combine_chunks().to_batches(), len(group) - end
            else:
                held = 0  # one group so far: gather as much again before looking
        if rest:
            yield from links(*joined(rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, most = [], 0, LINKS
        for more in found(batches):
            kept.append(more)
            held += len(more[0])
            if held >= most:
                kept = [fewest(*map(np.concatenate, zip(*kept)))]
                held = len(kept[0][0])
                most = max(LINKS, 2 * held)
        if kept:
            a, b, _ = fewest(*map(np.concatenate, zip(*kept)))
            yield pa.record_batch({"a": a, "b": b})

    return run


def near_links(distinct: DataFrame, cut: list[tuple[int, int, int]], radius: int, pick: str = "forest") -> DataFrame:
    """(a, b): links between nodes with the same components as all pairs found whose fingerprints differ in <= radius bits.

    distinct: node, fp0, fp1, ..., few with equal fingerprints. With pick "stars" the rows are pairs found themselves, every
    node's with its smallest and with its nearest partner of those a task finds; under a key split into parts, they are of its
    part or the key's smallest. With "between" the links have the components of
    the pairs found whose nodes differ in the column component. Pairs whose distance is within the bound of `cut` (the sum
    of its radii + 1, less one) are all found.
    """
    names = [c for c in distinct.columns if c.startswith("fp")]
    carry = ["component"] if pick == "between" else []
    columns = ["key", "node", "asks", *names, *carry]
    schema = ", ".join(f"{c} {'boolean' if c == 'asks' else 'long'}" for c in columns)
    rows = distinct.select("node", *names, *carry).mapInArrow(_filed_and_asked(cut, names, carry), schema)
    full = rows.where(~F.col("asks")).groupBy("key").agg(F.count("*").alias("count"), F.min("node").alias("first")).where(F.col("count") > PART)
    full = stored(full.select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts"), "first"), "simhash-full-keys")
    if full.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        # what is filed under a full key lies in one part each and asks in all; of stars, only the smallest asks
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        rows = rows.join(full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        filed = rows.where(~F.col("asks"))
        asking = filed.where("parts > 1 and node = first" if pick == "stars" else "parts > 1")
        rows = (
            filed.select(*columns, own.alias("part"))
            .unionByName(rows.where(F.col("asks")).select(*columns, everywhere.alias("part")))
            .unionByName(asking.select("key", "node", F.lit(True).alias("asks"), *names, *carry, everywhere.alias("part")))
        )
    ready = rows.select(*columns, "part").repartition("key", "part").sortWithinPartitions("key", "part", "asks", "node")
    return ready.mapInArrow(_verified(cut, radius, names, pick), "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of its component for every node with a link, except the roots themselves.

    Alternates large stars (a node's larger neighbours go to its smallest) and small stars (its smaller ones do) until
    nothing changes; each round is stored, so lineage stays short and a lost executor costs one round.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components-0")
    state = None
    for i in range(1, most_rounds + 1):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(low).distinct(), f"components-{i}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs.

    Texts whose 64-bit fingerprints differ in at most radius bits are linked; component_id is the smallest doc_id
    reachable. A null or empty text has fingerprint 0 and is linked like any other. Null ids do not count as smallest; a
    component without any other id has component_id null. Repeated documents give a row each. An empty table gives an
    empty result. Other columns are ignored.
    """
    rows = stored(fingerprints(docs, words), "simhash-rows")
    distinct = stored(rows.groupBy("fp0").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp0")), "simhash-distinct")
    cut = segments(segments_for(distinct.count(), radius), radius)
    found = components(near_links(distinct.select("node", "fp0"), cut, radius)).withColumnRenamed("node", "linked")
    rooted = distinct.join(found, F.col("node") == F.col("linked"), "left").select("fp0", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp0", "component_id"), "simhash-named")
    return rows.join(named, "fp0").select("doc_id", F.col("fp0").alias("fp"), "component_id")


def similar(pairs: DataFrame, texts: DataFrame, words: int, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts (row_no, text) share at least `least` of their shingles, by the sets themselves."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-candidates")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("row_no")).distinct(), "simhash-candidate-ids")
    texts = prefiltered(text_of(texts, "row_no"), ids, "row_no")
    side = lambda c: texts.select(F.col("row_no").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last, of_last = None, None
            for i in range(batch.num_rows):
                a, b = batch.column("text_a")[i].as_py(), batch.column("text_b")[i].as_py()
                if b != last:
                    last, of_last = b, np.unique(shingles(b, words))
                of_a = np.unique(shingles(a, words))
                both = len(np.intersect1d(of_a, of_last, assume_unique=True))
                keep[i] = both >= least * (len(of_a) + len(of_last) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _similar_parts(cut: list[tuple[int, int, int]], radius: int, least: float):
    """Of the nodes of two parts of a cluster, or of one: a forest of the components that similar nodes link."""

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        column = lambda c: block[c].to_numpy()
        component, part, fp = column("component"), column("part"), [column(c).view(np.uint64) for c in ("fp0", "fp1")]
        sets = block["shingles"].to_pylist()
        size = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
        start = np.cumsum(size) - size
        names, token = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        own, step = np.zeros(len(names), bool), max(1, _BLOCK // max(1, int(size.max())))
        first, one = [s[0] for s in cut], key[1].as_py() == key[2].as_py()
        right = np.flatnonzero(part == key[2].as_py())
        a, b = [], []
        for i in np.flatnonzero(part == key[1].as_py()):
            at = right[right > i] if one else right
            # candidates as they are found by their keys: near on the whole and in a segment
            short, long = np.minimum(size[at], size[i]), np.maximum(size[at], size[i])
            at = at[(component[at] != component[i]) & (short > 0) & (short >= least * long)]
            differ = np.stack([f[at] ^ f[i] for f in fp], axis=1)
            near = np.bitwise_count(differ).sum(1, dtype=np.int64) <= radius
            at, bits = at[near], np.unpackbits(differ[near].view(np.uint8), axis=1, bitorder="little")
            at = at[(np.add.reduceat(bits, first, axis=1, dtype=np.int64) <= [s[2] for s in cut]).any(1)]
            if not len(at):
                continue
            mine = token[start[i] : start[i] + size[i]]
            own[mine] = True
            for j in range(0, len(at), step):
                some = at[j : j + step]
                n = size[some]
                begin = np.cumsum(n) - n
                both = np.add.reduceat(own[token[np.arange(n.sum()) + np.repeat(start[some] - begin, n)]], begin, dtype=np.int64)
                found = some[both >= least * (n + size[i] - both)]
                a.append(np.full(len(found), component[i]))
                b.append(component[found])
            own[mine] = False
        if not sum(map(len, a)):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return pa.table(dict(zip("ab", forest(np.concatenate(a), np.concatenate(b)))))

    return run


def similar_between(parted: DataFrame, texts: DataFrame, cut: list[tuple[int, int, int]], radius: int, words: int, least: float = SIMILAR) -> DataFrame:
    """(a, b): links of components with the same components as all pairs of nodes found by `near_links` that differ in theirs
    and whose texts (row_no, text) share at least `least` of their shingles.

    parted: node, fp0, fp1, component. Pairs just below `least` can be as many as the square of a group, and each of them has
    to be compared, but none becomes a row: forests of the pairs found by fingerprint give clusters, a cluster is dealt
    into parts, and two parts at a time are compared in a task, each text's shingles having been made once.
    """
    found = components(near_links(parted, cut, radius, "between"))
    inside = found.select("node", F.col("root").alias("cluster")).union(found.select("root", "root").distinct())
    inside = stored(inside.join(parted.select("node", "fp0", "fp1", "component"), "node"), "simhash-clusters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in slices(batch, "text"):
                sets = [np.unique(shingles(t, words)) for t in some]
                yield pa.record_batch({"row_no": batch.column("row_no").slice(start, len(some)), "size": np.array([len(s) for s in sets]), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    ids = inside.select(F.col("node").alias("row_no"))
    wanted = prefiltered(text_of(texts, "row_no"), ids, "row_no").join(ids, "row_no", "left_semi")
    sets = wanted.mapInArrow(run, "row_no long, size long, shingles binary").withColumnRenamed("row_no", "node")
    inside = stored(inside.join(sets, "node"), "simhash-sets")
    by_nodes = F.least(F.ceil(F.count("*") / CLUSTER_PART), F.lit(CLUSTER_PARTS))
    full = inside.groupBy("cluster").agg(F.greatest(by_nodes, F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    full = stored(full.where("parts > 1"), "simhash-full-clusters")
    dealt = inside.join(full, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "component", "fp0", "fp1", "shingles")
    return blocks.groupBy("cluster", "low", "high").applyInArrow(_similar_parts(cut, radius, least), "a long, b long")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest doc_id, all columns as they were.

    Texts are linked whose shingle sets have a Jaccard similarity of 0.8 or more. Candidates are the pairs whose
    fingerprints of 128 bits differ in at most 24. Ten segments ask for all keys one bit away: every pair within 19 bits is
    a candidate, and of those within 24 bits all that do not differ in two bits or more of every segment. Every node's
    smallest and nearest candidates that agree in a whole segment are compared first, two a node and segment at most; then all
    candidates that these links have not joined, in blocks of a cluster: no group of texts, similar or just below, yields a
    row for each of its pairs. Null ids rank last; of equal ids one row stays. Null and empty texts are equal to each other.
    """
    numbered = stored(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.monotonically_increasing_id().alias("row_no")), "simhash-numbered")
    rows = stored(_named_sets(numbered, words), "simhash-rows")
    # equal sets of shingles first: their row with the smallest id stands for all
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no", "fp0", "fp1")
    distinct = rows.groupBy("set0", "set1").agg(F.min(rank).alias("best")).select("best", F.col("best.row_no").alias("node"), "best.fp0", "best.fp1")
    distinct = stored(distinct, "simhash-distinct")
    cut = segments(10, 19, 128)
    same = [(first, bits, 0) for first, bits, _ in cut]
    links = stored(similar(near_links(distinct, same, radius, "stars"), numbered, words), "simhash-links")
    joined = components(links).withColumnRenamed("node", "linked")
    parted = distinct.join(joined, F.col("node") == F.col("linked"), "left").select("node", "fp0", "fp1", "best", F.coalesce("root", "node").alias("component"))
    parted = stored(parted, "simhash-parted")
    found = components(similar_between(parted, numbered, cut, radius, words)).withColumnRenamed("node", "linked")
    rooted = parted.join(found, F.col("component") == F.col("linked"), "left").select("best", F.coalesce("root", "component").alias("root"))
    kept = stored(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row_no").alias("row_no")), "simhash-kept")
    # what is kept grows with the input and is never broadcast
    return numbered.join(kept.hint("merge"), "row_no", "left_semi").select("row.*")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
