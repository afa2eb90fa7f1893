"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of paragraph digests, in SQL only.

A text is cut into paragraphs: its lines, and lines of over 256 code points into runs of that length. The digests of its
different paragraphs are added to a table of 3 rows of 8 cells, whatever their number: each to one cell of each row, as a
count, an XOR of digests and an XOR of their check hashes. This table is the fingerprint. Subtracting the tables of two
versions leaves the digests that only one has, and peeling recovers them: a cell with count 1 or -1 and a fitting check
holds one digest, which is taken from its other cells, and so on. Where a table does not peel, four tables take its place,
each for the digests with other leading bits and with other places in the rows, so that the cells grow with the difference
of the versions, where they differ, and not with the texts. After 12 such rounds, or 4^12 tables, what is left is compared directly.

The likeness of two versions is 1 - differing digests / all digests of both. Everything is higher-order functions over
one row, so it needs no shuffle; a document meets the next one by range chunks whose size the data's quantiles bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlework.llm.common import below, text_of

PARAGRAPH = 256
ROWS, CELLS = 3, 8
#: Rounds of peeling a table, and rounds of four tables in the place of one.
ROUNDS, LEVELS = 8, 12
#: Bits of a digest: the lower ones give its places in the rows, one of four sets by turns, the upper ones its table.
PLACE_BITS, TURNS, TABLE_BITS = 3, 4, 40
CHECK = 0xFFFFFFFF


def digests(text: Column) -> Column:
    """Different digests of a text's paragraphs; empty lines have none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PARAGRAPH}}}"), F.lit(0)), lambda x: F.xxhash64(x)))


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(CHECK))


def _place(digest: Column, row: int, level: Column) -> Column:
    """The cell of a digest in a row, by other bits at each of four successive levels."""
    shift = level % TURNS * (ROWS * PLACE_BITS) + row * PLACE_BITS
    return F.call_function("shiftright", digest, shift.cast("int")).bitwiseAND(F.lit(CELLS - 1))


def sketch(of: Column, level: Column | None = None) -> Column:
    """Cells (n, k, h) of one table: row after row."""
    level = F.lit(0) if level is None else level

    def cell(own: Column) -> Column:
        k = F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))
        h = F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(_check(d)))
        return F.struct(F.size(own).alias("n"), k.alias("k"), h.alias("h"))

    def row(r: int) -> Column:
        places = F.array(*[F.lit(g).cast("long") for g in range(CELLS)])
        return F.transform(places, lambda g: _bound(F.filter(of, lambda d: _place(d, r, level) == g), cell))

    return F.concat(*[row(r) for r in range(ROWS)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, level: Column | None = None) -> Column:
    """Digests that only one side has, or null if the cells do not peel."""
    level = F.lit(0) if level is None else level

    def taken_off(c: Column, p: Column) -> Column:
        return F.struct((c["n"] - p["n"]).alias("n"), c["k"].bitwiseXOR(p["k"]).alias("k"), c["h"].bitwiseXOR(_check(p["k"])).alias("h"))

    def one_round(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["h"]))
        single = F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

        def without(found: Column) -> Column:
            def row(r: int) -> Column:
                here = lambda i: F.filter(found, lambda p: _place(p["k"], r, level) == i)
                return F.transform(F.slice(state["cells"], r * CELLS + 1, CELLS), lambda c, i: F.aggregate(here(i), c, taken_off))

            rest = F.when(F.size(found) > 0, F.concat(*[row(r) for r in range(ROWS)])).otherwise(state["cells"])
            return F.struct(rest.alias("cells"), F.concat(state["found"], F.transform(found, lambda p: p["k"])).alias("found"), (F.size(found) == 0).alias("done"))

        return F.when(state["done"], state).otherwise(_bound(single, without))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("done"))
    empty = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, lambda s: F.when(empty(s), s["found"]))


def _quarters(part: Column, level: Column) -> Column:
    """The digests of both sides by their next two bits: four parts."""
    bits = lambda d: F.call_function("shiftright", d, (level * 2 + TABLE_BITS).cast("int")).bitwiseAND(F.lit(3))
    return F.transform(
        F.array(*[F.lit(g).cast("long") for g in range(4)]),
        lambda g: F.struct(F.filter(part["a"], lambda d: bits(d) == g).alias("a"), F.filter(part["b"], lambda d: bits(d) == g).alias("b")),
    )


def recovered(a: Column, b: Column) -> Column:
    """(found, cells): the digests that only one of two versions has, from their subtracted sketches, and the cells built a side."""

    def tried(part: Column, level: Column) -> Column:
        # with counts further apart than the cells, no table can peel
        apart = F.abs(F.size(part["a"]) - F.size(part["b"])) > ROWS * CELLS
        peeled = F.when(~apart, peel(subtract(sketch(part["a"], level), sketch(part["b"], level)), level))
        return F.struct(part["a"].alias("a"), part["b"].alias("b"), peeled.alias("found"), F.when(apart, 0).otherwise(ROWS * CELLS).alias("cells"))

    def one_level(state: Column, level: Column) -> Column:
        def after(parts: Column) -> Column:
            found = F.flatten(F.transform(F.filter(parts, lambda p: p["found"].isNotNull()), lambda p: p["found"]))
            left = F.flatten(F.transform(F.filter(parts, lambda p: p["found"].isNull()), lambda p: _quarters(p, level)))
            cells = F.aggregate(parts, state["cells"], lambda n, p: n + p["cells"])
            # two empty sides need no table
            left = F.filter(left, lambda p: (F.size(p["a"]) > 0) | (F.size(p["b"]) > 0))
            return F.struct(left.alias("left"), F.concat(state["found"], found).alias("found"), cells.alias("cells"))

        return F.when(F.size(state["left"]) == 0, state).otherwise(_bound(F.transform(state["left"], lambda p: tried(p, level)), after))

    def finished(state: Column) -> Column:
        rest = F.transform(state["left"], lambda p: F.array_union(F.array_except(p["a"], p["b"]), F.array_except(p["b"], p["a"])))
        return F.struct(F.concat(state["found"], F.flatten(rest)).alias("found"), state["cells"].alias("cells"))

    whole = F.array(F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(whole.alias("left"), F.array().cast("array<bigint>").alias("found"), F.lit(0).alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, one_level, finished)


def differing(a: Column, b: Column) -> Column:
    """The digests that only one of two versions has."""
    return recovered(a, b)["found"]


def likeness(a: Column, b: Column, found: Column | None = None) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(1 - F.size(differing(a, b) if found is None else found) / both)


def printed(of: Column) -> Column:
    """The sketch as text, cells joined by commas: count, XOR of digests and XOR of check hashes, the latter two in hex."""
    cell = lambda c: F.concat(c["n"].cast("string"), F.lit(":"), F.lower(F.hex(c["k"])), F.lit(":"), F.lower(F.hex(c["h"])))
    return F.array_join(F.transform(sketch(of), cell), ",")


def with_next(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """(doc_id, text, next_text) in descending order of doc_id, null ids last, ties by text; the first follows the last.

    Chunks end at quantiles of the ids that occur as ids, so a chunk's largest id is known to be the next one's follower
    and is copied there; one shuffle by chunk then brings every document to its follower.
    """
    spark = docs.sparkSession
    chunks = chunks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    shares = [(i + 1) / chunks for i in range(chunks)]
    tops = rows.agg(F.percentile_approx("doc_id", shares, 10 * chunks), F.max("doc_id")).first()
    tops = sorted({*(tops[0] or []), *([tops[1]] if tops[1] is not None else [])})
    order = ["copied", F.col("doc_id").desc_nulls_last(), "text"]
    if len(tops) > 1:
        rows = rows.withColumn("chunk", F.coalesce(below(tops, F.col("doc_id")), F.lit(0)))
        fine = F.array(*[F.lit(x) for x in tops])
        top = F.element_at(fine, F.col("chunk") + 1) == F.col("doc_id")
        places = F.struct("chunk", F.lit(False).alias("copied"))
        follower = F.struct(((F.col("chunk") + 1) % len(tops)).alias("chunk"), F.lit(True).alias("copied"))
        rows = rows.select("doc_id", "text", F.inline(F.when(top, F.array(places, follower)).otherwise(F.array(places))))
    else:
        rows = rows.withColumns({"chunk": F.lit(0), "copied": F.lit(False)})
    window = Window.partitionBy("chunk").orderBy(*order)
    first = F.first("text").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    follows = F.lead("text").over(window)
    rows = rows.withColumn("next_text", follows if len(tops) > 1 else F.coalesce(follows, first))
    return rows.where(~F.col("copied")).select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, cells_edited, cells_next), a
    row per row of docs.

    docs: doc_id, text, null read as empty. The edited text has the last half of the code points, rounded down, replaced
    by the first as many of the next document. Two texts without paragraphs are alike by 1. Repeated ids follow each other
    in order of text; null ids come last; a single document follows itself; no documents give no rows. Other columns are
    ignored. Whole texts count, however long: the work grows with a text's paragraphs and, beyond that, with their
    differences. ``cells_*`` is the number of cells built a side: 24 where the two fingerprints themselves peeled, 0 more
    where the counts alone showed that a table could not.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.col("half")).cast("int")), F.left("next_text", "half"))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("follower")
    )
    own, changed, follower = F.col("own"), F.col("changed"), F.col("follower")
    rows = rows.withColumns({"from_edited": recovered(own, changed), "from_next": recovered(own, follower)})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(own).alias("fingerprint"),
        printed(changed).alias("edited_fingerprint"),
        likeness(own, changed, F.col("from_edited.found")).alias("near_edited"),
        likeness(own, follower, F.col("from_next.found")).alias("near_next"),
        F.col("from_edited.cells").alias("cells_edited"),
        F.col("from_next.cells").alias("cells_next"),
    )
