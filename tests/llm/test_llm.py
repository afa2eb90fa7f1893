"""The ten operators on small tables: edge cases, and brute force where SQL cannot express them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from candlework.llm import bpe, language, mixing, neighbours, quality, simhash, sketches, toxicity, urls, warc
from candlework.llm.common import below, prefix_sums

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row_no long"
LABELS = "doc_id long, quality int, toxic int, lang string"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark, words):
    """Ordinary, toxic, junk, repeated, null, empty, very long and odd texts, with columns that clash by name."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        if i % 5 == 0:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "scum", "moron"]))
            text = " ".join(parts)
        if i % 7 == 0:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"s{i % 4}", len(text), 9.0, 1))
    same = rows[1][1]
    rows += [(300, same, "en", "s0", 1, 0.0, 1), (301, same.upper(), "en", None, 1, 0.0, 1), (302, None, None, None, None, None, None)]
    rows += [(303, "", "en", "s1", 0, 0.0, 1), (304, " \t\n", "en", "s1", 3, 0.0, 1), (None, "no id here", "en", "s1", 3, 0.0, 1)]
    rows += [(305, "wort " * 50_000, "de", "s2", 1, 0.0, 1), (306, "x", "en", "s3", 1, 0.0, 1), (306, "x", "en", "s3", 1, 0.0, 1)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 7 != 0), int(i % 5 == 0), "zz") for i in range(300)] + [(None, 1, 1, "zz"), (1, 1, 0, "zz"), (2, None, None, "zz")]
    return spark.createDataFrame(rows, LABELS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)


def test_toxicity(docs, labels, none):
    out = toxicity.toxicity_scores(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    held = out[out["held_out"] & (out["doc_id"] < 300)]
    assert ((held["doc_id"] % 5 == 0) == (held["predicted"] == 1)).mean() > 0.9
    assert out[out["doc_id"].isin([302, 303, 304])]["score"].nunique() == 1
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == (out["predicted"] == 0).sum()
    assert toxicity.toxicity_scores(*none).count() == 0
    assert toxicity.toxicity_scores(docs, none[1]).agg(F.max("score")).first()[0] < 0.01


def test_quality(docs, labels, none):
    out = quality.quality_scores(docs, labels).toPandas()
    held = out[out["held_out"] & (out["doc_id"] < 300)]
    assert ((held["doc_id"] % 7 != 0) == (held["predicted"] == 1)).mean() > 0.95
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.quality_scores(*none).count() == 0
    assert quality.quality_scores(docs, none[1]).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)


def test_quality_reads_no_bad_label(docs, labels):
    """Labels of bad texts decide nothing, the prior neither."""
    both, good = (quality.quality_scores(docs, x).orderBy("doc_id", "score").toPandas() for x in (labels, labels.where("quality = 1")))
    assert both.equals(good)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_quality_prior_and_risk(share):
    """The estimated prior is near the share of a known mixture, and the fit's risk, by plain loops, is no larger nearby."""
    rng = np.random.default_rng(8)
    n = quality.N_FEATURES
    good = lambda k: rng.normal(0, 1, (k, n))
    bad = lambda k: np.column_stack([rng.normal(3, 1, (k, 2)), rng.normal(0, 1, (k, n - 2))])
    positive = good(3000)
    unlabelled = np.concatenate([good(round(6000 * share)), bad(round(6000 * (1 - share)))])
    rng.shuffle(unlabelled)
    prior = quality.estimated_prior(positive, unlabelled)
    assert prior == pytest.approx(share, abs=0.06)
    w, mean, spread = quality.minimise(positive, unlabelled, prior)

    def risk(w):
        g = lambda rows: [float(x @ w) for x in quality.expanded(rows, mean, spread)]
        loss = lambda z: math.log1p(math.exp(-abs(z))) + max(0.0, -z)
        up = sum(loss(z) for z in g(positive)) / len(positive)
        down = sum(loss(-z) for z in g(unlabelled)) / len(unlabelled) - prior * sum(loss(-z) for z in g(positive)) / len(positive)
        return prior * up + max(0.0, down)

    least = risk(w)
    assert least < risk(np.zeros(len(w)))
    assert all(least < risk(w + d) for d in rng.normal(0, 0.3, (5, len(w))))


def test_quality_prior_of_little(docs):
    assert quality.estimated_prior(np.zeros((1, quality.N_FEATURES)), np.zeros((0, quality.N_FEATURES))) == 0.5
    same = np.zeros((10, quality.N_FEATURES))
    assert quality.estimated_prior(same, same) == quality.MOST_PRIOR


def test_language(spark, none):
    rng = random.Random(5)
    made = {"aa": "abcde", "bb": "mnopq", "cc": "stuvw"}
    rows = [(i, " ".join("".join(rng.choice(made[x]) for _ in range(4)) for _ in range(30)), x, None, 1, 0.0, 1) for i, x in enumerate(list(made) * 30)]
    rows += [(100, None, "aa", None, 0, 0.0, 1), (101, "12 !?", "aa", None, 0, 0.0, 1), (None, "abc abc", None, None, 0, 0.0, 1)]
    out = language.predict_language(spark.createDataFrame(rows, DOCS)).toPandas()
    right = out.merge(pd.DataFrame([(r[0], r[2]) for r in rows[:90]], columns=["doc_id", "lang"]), on="doc_id")
    assert (right["lang"] == right["lang_pred"]).all() and len(out) == len(rows)
    odd = out[out["doc_id"].isin([100, 101])]
    assert list(odd["lang_pred"]) == ["und"] * 2 and list(odd["score"]) == [0, 0]
    assert language.predict_language(none[0]).count() == 0


def brute_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex().alias("hex"), "component_id").toPandas()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id != 305}
    for r in out.itertuples():
        if r.doc_id in texts:
            assert r.hex == f"{brute_fingerprint(texts[r.doc_id], 4):016x}"
    of = out.set_index("doc_id")["component_id"]
    assert of[300] == of[301] == 1 and of[302] == of[303] == of[304] == 302
    assert simhash.near_duplicates(none[0]).count() == 0


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centres for _ in range(8)}
    nodes = np.array(sorted(fp), np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= 4, 1))
    want = dict(zip(*simhash.forest(nodes[a].view(np.int64), nodes[b].view(np.int64))))
    distinct = spark.createDataFrame(pd.DataFrame({"node": nodes.view(np.int64), "fp0": nodes.view(np.int64)}))
    for n, part in ((2, 20_000), (3, 20_000), (3, 2)):
        monkeypatch.setattr(simhash, "PART", part)
        found = simhash.components(simhash.near_links(distinct, simhash.segments(n, 4), 4)).collect()
        assert {r.node: r.root for r in found} == want


def test_one_of_each(docs, none):
    kept = simhash.one_of_each(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and 1 in ids and 300 not in ids and 301 not in ids
    assert ids.count(306) == 1 and sum(i in ids for i in (302, 303, 304)) == 1
    assert simhash.one_of_each(none[0]).count() == 0


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    file = public_tokenizers.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(file), bpe.Coder(bpe.Vocabulary(file))
    odd = ["", " ", "ΑΣ ΣΑΣ", "İx it's IT'S don''t", "a<|endoftext|>b<|start", "½² 12३ Ⅷ", "é Å ﬁ", "日本 🎉🎉", "x\x1cy\x85z", "_a_b-c", "lower" * 2000]
    for text in odd + [r.text or "" for r in docs.limit(50).collect()]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    out = bpe.token_digests(bpe.encode_and_decode(docs, file)).toPandas().set_index("doc_id")
    assert len(out) == docs.count() and out.loc[302, "n_tokens"] == 0 and out.loc[305, "n_tokens"] >= 50_000
    assert out.loc[302, "ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_and_decode(none[0], file).count() == 0


def test_sketches(docs, none):
    out = sketches.edited_fingerprints(docs).toPandas()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    pieces = lambda s: {x[i : i + 256] for x in s.split("\n") for i in range(0, len(x), 256)}
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        want.append((-1 if i is None else i, len(a), hashlib.sha256(e.encode()).hexdigest(), round(like(pieces(a), pieces(e)), 9), round(like(pieces(a), pieces(b)), 9)))
    got = [(-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out.itertuples()]
    assert sorted(got) == sorted(want)
    by = out.set_index("doc_id")["fingerprint"]
    assert by[1] == by[300] and by[302] == by[303] != by[1]
    assert sketches.edited_fingerprints(none[0]).count() == 0
    one = sketches.edited_fingerprints(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def _from_strings(one, other):
    """The differing digests read from two printed fingerprints by a plain loop, or None if they do not peel."""
    signed = lambda x: int(x, 16) - (1 << 64) * (int(x, 16) >> 63)
    check = lambda k: xxhash.xxh64(k.to_bytes(8, "little", signed=True), seed=42).intdigest() & 0xFFFFFFFF
    cells = [[[int(n), signed(k), int(h, 16)] for n, k, h in (c.split(":") for c in f.split(","))] for f in (one, other)]
    left = [[a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]] for a, b in zip(*cells)]
    found, more = [], True
    while more:
        more = False
        for i, (n, k, h) in enumerate(left):
            if abs(n) == 1 and check(k) == h and (k >> (i // 8 * 3)) & 7 == i % 8:
                for row in range(3):
                    c = left[row * 8 + ((k >> (row * 3)) & 7)]
                    c[0], c[1], c[2] = c[0] - n, c[1] ^ k, c[2] ^ check(k)
                found.append(k)
                more = True
    return None if any(any(c) for c in left) else found


def test_sketches_give_the_likeness_by_themselves(docs):
    """Where no larger table was needed, the two returned strings alone give the likeness."""
    rows = [r for r in sketches.edited_fingerprints(docs).collect() if r.cells_edited == 24]
    assert len(rows) > 200
    for r in rows:
        found = _from_strings(r.fingerprint, r.edited_fingerprint)
        both = sum(int(c.split(":")[0]) for f in (r.fingerprint, r.edited_fingerprint) for c in f.split(",")[:8])
        assert round(r.near_edited, 9) == round(1 - len(found) / both if both else 1.0, 9)


def test_sketches_grow_with_the_difference(spark):
    """Texts of 20,000 different lines: a few edits need few cells, all others many, and the digests found are exact."""
    lines = [f"line {i}" for i in range(20_000)]
    few = ["new" if i % 5_000 == 7 else x for i, x in enumerate(lines)]
    rest = [f"other {i}" for i in range(19_000)] + lines[:1_000]
    pairs = spark.createDataFrame([(n, "\n".join(lines), "\n".join(x)) for n, x in enumerate([lines, few, rest, []])], "n int, a string, b string")
    both = pairs.select("n", sketches.digests(F.col("a")).alias("a"), sketches.digests(F.col("b")).alias("b"))
    out = {r.n: r for r in both.select("n", "a", "b", sketches.recovered(F.col("a"), F.col("b")).alias("r")).collect()}
    assert all(sorted(r.r.found) == sorted(set(r.a) ^ set(r.b)) for r in out.values())
    assert out[0].r.cells == out[1].r.cells == 24 and len(out[1].r.found) == 5 and out[2].r.cells > 30_000


def test_urls(spark):
    pages = [(1, "http://EXAMPLE.org/en/12"), (2, "https://a.example.org/es/x?u=://b"), (3, "x://com/de/"), (4, "http://bcom/de/1"), (5, "http://a.com/fr/#x"), (6, None), (7, "no scheme"), (8, "http://org"), (9, ""), (1, "http://EXAMPLE.org/en/12")]
    df = spark.createDataFrame([(*p, "h", "allow") for p in pages], "page_id long, url string, html string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge(df, urls.RULES).collect())
    assert got == sorted([
        (1, "example.org", "/en/12", "example.org/en/1", "block"), (1, "example.org", "/en/12", "example.org/en/1", "block"),
        (2, "a.example.org", "/es/x", "example.org/es/", "block"), (3, "com", "/de/", "com/de/", "block"), (4, "bcom", "/de/1", "", "allow"),
        (5, "a.com", "/fr/", "com/fr/", "allow"), (6, "", "", "", "allow"), (7, "", "", "", "allow"), (8, "org", "", "", "allow"), (9, "", "", "", "allow"),
    ])
    assert urls.judge(df.where("false"), urls.RULES).count() == 0


def test_mixing(docs, none):
    out = mixing.mixed(docs).toPandas()
    again = mixing.mixed(docs.repartition(5)).toPandas()
    keys = ["doc_id", "size", "taken"]
    assert out[keys].sort_values(keys, ignore_index=True).equals(again[keys].sort_values(keys, ignore_index=True))
    assert len(out) == docs.count() and (out["taken"] <= 2 * out["size"]).all()
    assert abs(out.groupby("source_size")["taken"].sum() - out.groupby("source_size")["target"].first()).max() <= 1
    assert out.groupby("source_size")["target"].first().sum() == pytest.approx(1.5 * out["size"].sum())
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    taken = sum(len(r.text.encode().split()) for r in mix.select("text").collect())
    assert taken == out["taken"].sum()
    assert mixing.mixed(none[0]).count() == 0


def test_mixing_queue(spark):
    """The words in the mix are those at the front of a queue of single words, held in a plain list."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([0, 1, 7, 40, 300]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    numbered = mixing.numbered(docs)
    goals = mixing.targets(numbered)
    size = {i: len(t.split()) for i, t, _ in rows}
    goal = {r.source: (r.source_size, r.target) for r in goals.collect()}
    hashes = dict(docs.select("doc_id", F.xxhash64("doc_id")).collect())
    queue = []
    for source, (whole, target) in goal.items():
        served = 0
        for copy in range(2):
            for i in sorted((i for i, _, s in rows if s == source), key=lambda i: (hashes[i], i)):
                queue += [((served + k + 1) / target, hashes[i], i, copy) for k in range(size[i])]
                served += size[i]
        assert served == 2 * whole
    queue.sort()
    budget = int(sum(t for _, t in goal.values()))
    assert len(queue) > budget
    want = {}
    for _, _, i, copy in queue[:budget]:
        want[i, copy] = want.get((i, copy), 0) + 1
    ids = dict(numbered.select("row_no", "doc_id").collect())
    for quantum in (5, 512):
        got = {(ids[r.row_no], r.copy): r.words for r in mixing.schedule(numbered, goals, quantum=quantum).collect()}
        assert got == want
    # the global order decides: no source stops at its target by itself
    assert mixing.queued(numbered, goals).agg(F.sum("words")).first()[0] == len(queue)


def test_warc(spark):
    long = "x" * 100
    rows = [(5, "u v\n", long), (3, None, long), (9, "w", long[1:]), (10, "w", long[1:]), (4, "e", None), (6, "é", "é" * 50), (7, "é", "é" * 50), (None, "n", long), (3, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(df, folder, shard_bytes=150, roll_bytes=300)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
    assert got == [(0, 100, "revisit", 3), (3, 100, "response", None), (3, 100, "response", None), (4, 0, "response", None), (5, 100, "revisit", 3), (6, 100, "response", None), (7, 100, "revisit", 6), (9, 99, "response", None), (10, 99, "response", None)]
    other = warc.write_archives(df.repartition(4), warc.archive_folder(spark), shard_bytes=150, roll_bytes=300)
    assert manifest.count() > 1 and sorted(manifest.collect()) == sorted(other.collect())
    empty = warc.archive_folder(spark)
    warc.write_archives(df.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16))
    x[50:80] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (800, [0.0] * 16, 1), (900, [float("nan")] * 16, 1), (1000, [None] * 16, 1), (1100, [], 1), (None, [1.0] * 16, 1), (1200, [1.0, 2.0], 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=10).toPandas()
    hits = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and list(mine["score"]) == list(d[mine["vec_id"]])
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits >= 0.95 * 120 and set(got["query_id"]) == set(range(0, 600, 50))
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0


def test_helpers(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.lit(2).alias("v")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    out = prefix_sums(df, [F.col("id")], "v", by=["g"]).toPandas()
    assert (out["before"] == 2 * (out["id"] // 3)).all()
    bounds = [1, 4, 9, 16, 25]
    assert all(r.n == sum(b < r.id for b in bounds) for r in spark.range(30).select("id", below(bounds, F.col("id")).alias("n")).collect())


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids and (name == "bpe" or docs.columns == columns)
        ids = now
    assert corpus_pipeline.run(spark, data).count() == docs.count()


def brute_toxicity(train, texts):
    """(log_ratio, peak_ratio) of the texts under order-2 Kneser-Ney counts of (text, toxic), in dictionaries."""
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    count = [Counter(), Counter()]
    for t, y in train:
        w = words(t)
        count[y].update(set(zip([""] + w, w)))
    follows, seen, taken = ([Counter(), Counter()] for _ in range(3))
    for y in (0, 1):
        for (c, w), n in count[y].items():
            follows[y][w] += 1
            seen[y][c] += n
            taken[y][c] += min(n, 2)
    total = [sum(f.values()) for f in follows]
    rest = [sum(min(n, 2) for n in f.values()) / sum(f.values()) for f in follows]

    def p(c, w, y):
        low = max(follows[y][w] - 2, 0) / total[y] + rest[y] * (follows[0][w] + follows[1][w]) / sum(total)
        return max(count[y][c, w] - 2, 0) / max(1, seen[y][c]) + (taken[y][c] / seen[y][c] if seen[y][c] else 1) * low

    out = []
    for t in texts:
        w = words(t)
        r = [np.log(p(c, x, 1) / p(c, x, 0)) if follows[0][x] + follows[1][x] else 0.0 for c, x in zip([""] + w, w)]
        n = min(8, len(r))
        out.append((np.mean(r), max(sum(r[i : i + n]) for i in range(len(r) - n + 1)) / 8) if r else (0.0, 0.0))
    return np.array(out)


def learnable(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


@pytest.mark.parametrize("cache", [1 << 18, 40, 0])
def test_toxicity_equals_brute_force(docs, labels, monkeypatch, cache):
    """All pairs count, wherever their values come from: broadcast, or joined."""
    monkeypatch.setattr(toxicity, "CACHE", cache)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect() if r.doc_id is not None and r.doc_id < 305]
    want = brute_toxicity([(t, int(i % 5 == 0)) for i, t in rows if i < 300 and learnable(i)], [t for _, t in rows])
    out = toxicity.toxicity_scores(docs, labels).toPandas()
    assert len(out) == docs.count()
    out = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id").loc[[i for i, _ in rows]]
    assert np.allclose(out[["log_ratio", "peak_ratio"]], want, atol=1e-5)


def test_one_of_each_equals_exact_jaccard(spark, words):
    """Texts whose fingerprints are near and whose shingles are not stay; groups are those of the exact similarity."""
    rng = random.Random(9)
    made = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    chant = "one two three four five " * 300
    texts = [chant + " ".join(made(40)) for _ in range(4)]
    for _ in range(25):
        base = made(120)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = "changed" + rng.choice(words)
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    fp = np.stack([simhash.fingerprint(t, 5, 2) for t in texts])
    differ = np.bitwise_count(fp[:, None] ^ fp[None, :]).sum(2)
    alike = np.array([[len(x & y) / len(x | y) >= 0.8 for y in sets] for x in sets])
    a, b = np.nonzero(np.triu(alike & (differ <= simhash.WIDE_RADIUS), 1))
    want = set(range(len(texts))) - set(simhash.forest(a, b)[0].tolist())
    assert (np.triu((differ <= simhash.WIDE_RADIUS) & ~alike, 1)).sum() > 6 and {0, 1, 2, 3} <= want
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, 1) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in simhash.one_of_each(df).select("doc_id").collect()} == want


def test_pairs_between_parts_are_no_rows(spark, words, monkeypatch):
    """Of k texts from one template, each but two a little below the similarity of the others, links are found and the pairs by
    fingerprint are fewer than the square: in one part, and in parts of few nodes or few shingles."""
    rng = random.Random(5)
    base = [rng.choice(words) + rng.choice(words) for _ in range(150)]
    texts = []
    for i in range(60):
        copy = list(base)
        for j in rng.sample(range(5, 145, 10), 3):
            copy[j] = f"own{i}x{j}"
        texts.append(" ".join(copy))
    texts += [texts[7] + " end", texts[9] + " stop"]
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    fp = np.stack([simhash.fingerprint(t, 5, 2) for t in texts])
    cut = simhash.segments(10, 19, 128)
    bits = np.unpackbits((fp[:, None] ^ fp[None, :]).view(np.uint8), axis=2, bitorder="little")
    met = (bits.sum(2) <= 24) & (np.add.reduceat(bits, [c[0] for c in cut], axis=2) <= 1).any(2)
    alike = np.array([[len(x & y) / len(x | y) >= 0.8 for y in sets] for x in sets])
    a, b = np.nonzero(np.triu(met & alike, 1))
    pairs = int(np.triu(met, 1).sum())
    assert pairs > 8 * len(texts) > 8 * len(a) > 0
    parted = spark.createDataFrame([(i, *map(int, f.view(np.int64)), i) for i, f in enumerate(fp)], "node long, fp0 long, fp1 long, component long").repartition(1)
    numbered = spark.createDataFrame(list(enumerate(texts)), "row_no long, text string")
    assert simhash.near_links(parted, cut, 24, "between").distinct().count() < pairs / 2
    want = dict(zip(*simhash.forest(a, b)))
    for part, shingles in ((64, 1 << 21), (5, 1 << 21), (64, 600)):
        monkeypatch.setattr(simhash, "CLUSTER_PART", part)
        monkeypatch.setattr(simhash, "PART_SHINGLES", shingles)
        links = simhash.similar_between(parted, numbered, cut, 24, 5)
        assert {r.node: r.root for r in simhash.components(links).collect()} == want


@pytest.mark.parametrize("part", [20_000, 25])
def test_stars_are_few_a_node(spark, monkeypatch, part):
    """Of k near copies, each met under many keys and in many blocks of pairs, a few pairs a node are rows, and all of them near."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    cut = [(first, bits, 0) for first, bits, _ in simhash.segments(10, 19, 128)]
    monkeypatch.setattr(simhash, "_BLOCK", 128)
    monkeypatch.setattr(simhash, "LINKS", 512, raising=False)
    monkeypatch.setattr(simhash, "PART", part)
    rows = {}
    for k in (100, 400):
        flips = np.zeros((k, 128), np.uint8)
        for i in range(k):
            flips[i, rng.choice(128, 5, replace=False)] = 1
        fp = np.unique(np.packbits(flips, axis=1, bitorder="little").view(np.uint64) ^ base, axis=0)
        distinct = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(fp)], "node long, fp0 long, fp1 long")
        found = np.array(simhash.near_links(distinct, cut, 24, "stars").collect())
        rows[k] = len(found)
        assert (found[:, 0] < found[:, 1]).all() and (np.bitwise_count(fp[found[:, 0]] ^ fp[found[:, 1]]).sum(1) <= 24).all()
        linked = simhash.forest(found[:, 0], found[:, 1])
        assert len(linked[0]) == len(fp) - 1 and not linked[1].any()
        assert len(found) < 8 * len(fp)
    assert rows[400] < 6 * rows[100]


def test_a_pair_counts_in_its_first_segment(spark):
    """Links have the components of all pairs, and a pair that several segments find is one row."""
    rng = np.random.default_rng(12)
    cut = simhash.segments(10, 19, 128)
    fp = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    one, three, many = (np.array([sum(1 << b for b in flip if b < 64), sum(1 << (b - 64) for b in flip if b >= 64)], np.uint64) for flip in ([127], [0, 1, 100], [*range(0, 115, 13), *range(1, 116, 13)]))
    fp = np.concatenate([fp, fp[:20] ^ one, fp[10:30] ^ three, fp[25:35] ^ many])
    bits = np.unpackbits((fp[:, None] ^ fp[None, :]).view(np.uint8), axis=2, bitorder="little")
    met = (bits.sum(2) <= 24) & (np.add.reduceat(bits, [c[0] for c in cut], axis=2) <= 1).any(2)
    a, b = np.nonzero(np.triu(met, 1))
    distinct = spark.createDataFrame([(i, *map(int, f.view(np.int64)), i) for i, f in enumerate(fp)], "node long, fp0 long, fp1 long, component long")
    for pick in ("forest", "between", "stars"):
        links = simhash.near_links(distinct, cut, 24, pick).repartition(1)
        rows = [(min(r), max(r)) for r in links.collect()]
        assert len(rows) == len(set(rows))
        assert {r.node: r.root for r in simhash.components(links).collect()} == dict(zip(*simhash.forest(a, b)))


def test_toxicity_counts_are_not_capped(spark):
    """A pair that always follows its context has the same probability in both classes, however often it occurs."""
    pairs = spark.createDataFrame([(11, 12, 1_000_000, 10_000, 1_000_000, 10_000), (11, 13, 3, 3, 3, 3), (12, 13, 5, 5, 5, 5)], "context long, word long, k0 int, k1 int, k2 int, k3 int")
    items, models = toxicity._items(pairs)
    known = toxicity._known(items.select("item", "often", F.col("v_all").alias("v")))[0]
    word = np.array([11, 12])
    values = [np.zeros((len(x), 6), np.float32) for x in (word, word[:1])]
    for x, out in zip((word, toxicity._pair_items(word)), values):
        known.put(x, out)
    given = models["all"].ratios(values[0][:1], values[0][1:], values[1])[0]
    assert values[1][0, :2].tolist() == [2_000_000, 20_000] and abs(given) < 0.01


def test_toxicity_items_grow_with_the_input(spark):
    """Every word of 100,000 has an item of its own."""
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(k, k + 1000)) for k in range(0, 100_000, 1000)]
    batch = pa.record_batch({"text": texts, "y": np.zeros(len(texts), np.int32), "half": np.zeros(len(texts), np.int32)})
    counted = pa.Table.from_batches(toxicity._counter([batch])).to_pandas()
    pairs = spark.createDataFrame(counted[["context", "word"]].assign(k0=counted["n"].astype("int32"), k1=0, k2=0, k3=0)).selectExpr("context", "word", *[f"cast(k{i} as int) as k{i}" for i in range(4)])
    assert toxicity._items(pairs)[0].count() == 100_001  # and the start of a text
