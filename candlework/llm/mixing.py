"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by hash; a document's virtual finish time is the words of its source up to and with
it, over the source's target. A source runs again from the start, up to the limit on repeats. All copies of all sources
are range-sorted by finish time and cut off once, where the total budget is used up: that order alone decides which
copies are in the mix. Every source's clock reaches 1 at its target, so at the cut each has taken about its target.

Long documents are queued in pieces of QUANTUM words, as long packets are in a network. Around the cut, from the place
where no piece in service could overrun the budget to the place where the finished ones do, the pieces are queued again
word by word: some 2 * QUANTUM words a source, so that no source is held back by a whole document. Pieces and words of a
copy follow each other in its source's queue, so the words taken of a copy are its first ones.

Prefix sums, within a source and over all, run within ranges and add the totals of earlier ranges, so a source with a
third of all rows takes no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import prefix_sums, stored

#: Weights of the sources in order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_REPEATS = 2
#: Words of a document that are queued together.
QUANTUM = 512
_SPACE = r"\x20\x09-\x0D"


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """(row_no, doc_id, source, size, ...): one stored row per row of docs, size in words."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{_SPACE}]+")), F.lit(0)).cast("long")
    return stored(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *more), "mixing-rows")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): shares of budget * all words by weight, none above repeats * its source's words.

    What a capped source leaves is shared by weight among the others, which raises their level; the loop collects one row
    a round and ends when no further source is capped.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one", label="mixing-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).cast("double").alias("cap")), "mixing-targets")
    total = budget * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight") if capped >= 0 else F.lit(False)
        got = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if got[0] == capped or not got[2]:
            break
        capped, level = got[0], (total - got[1]) / got[2]
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def queued(rows: DataFrame, goals: DataFrame, repeats: int = MOST_REPEATS, quantum: int = QUANTUM) -> DataFrame:
    """(row_no, doc_id, copy, piece, target, served, words, finish): all pieces of all copies, in the mix or not.

    served: the words of the source ahead of the piece; finish: its virtual finish time.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row_no")]
    ahead = prefix_sums(rows.select("row_no", "doc_id", "source", "size"), order, "size", by=["source"], label="mixing-ahead")
    goals = goals.withColumnRenamed("source", "goal_source")
    queue = ahead.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).where("size > 0 and target > 0")
    queue = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    queue = queue.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / quantum))))
    served = F.col("before") + F.col("copy") * F.col("source_size") + F.col("piece") * quantum
    words = F.least(F.lit(quantum), F.col("size") - F.col("piece") * quantum)
    queue = queue.select("row_no", "doc_id", "copy", "piece", "target", served.alias("served"), words.alias("words"))
    return queue.withColumn("finish", (F.col("served") + F.col("words")) / F.col("target"))


def schedule(rows: DataFrame, goals: DataFrame, repeats: int = MOST_REPEATS, quantum: int = QUANTUM) -> DataFrame:
    """(row_no, copy, words): the copies in the mix and the words taken of each, from the front of the one queue."""
    budget, sources = goals.agg(F.coalesce(F.floor(F.sum("target")), F.lit(0)), F.count("*")).first()
    ties = [F.xxhash64("doc_id"), F.col("doc_id").asc_nulls_last(), F.col("row_no"), F.col("copy"), F.col("piece")]
    queue = prefix_sums(queued(rows, goals, repeats, quantum), [F.col("finish"), *ties], "words", label="mixing-order")
    # at most one piece a source is in service at a time
    overrun = lambda room: F.min(F.when(F.col("before") + F.col("words") > room, F.col("finish")))
    bounds = queue.agg(overrun(budget - sources * quantum), overrun(budget)).first()
    first, last = (float("inf") if b is None else b for b in bounds)
    whole = queue.where(F.col("finish") < first)
    room = budget - (whole.agg(F.sum("words")).first()[0] or 0)
    near = queue.where((F.col("finish") >= first) & (F.col("served") / F.col("target") < last))
    near = near.withColumn("word", F.explode(F.sequence(F.lit(1), F.col("words").cast("int"))))
    near = near.withColumn("finish", (F.col("served") + F.col("word")) / F.col("target")).withColumn("words", F.lit(1).cast("long"))
    near = prefix_sums(near.drop("before"), [F.col("finish"), *ties, F.col("word")], "words", label="mixing-cut").where(F.col("before") < room)
    taken = whole.select("row_no", "copy", "words").unionByName(near.select("row_no", "copy", "words"))
    return taken.groupBy("row_no", "copy").agg(F.sum("words").alias("words"))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of docs.

    docs: doc_id, text, source. A null or empty text has size 0 and is never taken; a null source is a source of its own,
    the last in order; a null doc_id is an id like any other; repeated documents are queued each; a very long text is
    queued in pieces. An empty table gives an empty result. Ties in the shuffle go by id, then size; ties of finish times
    by the hash of the id, then the id. Other columns are ignored.
    """
    rows = numbered(docs)
    goals = stored(targets(rows), "mixing-goals")
    taken = schedule(rows, goals).groupBy("row_no").agg(F.sum("words").alias("taken"))
    goals = goals.withColumnRenamed("source", "goal_source")
    out = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).join(taken, "row_no", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' columns, a row per copy, the text of a copy that is cut ending at its last word taken.

    Nulls, empty and very long texts, repeats and ties as for mixed; rows of size 0 are not in the mix, and an empty table
    gives an empty one.
    """
    columns = docs.columns
    held = docs.select(*[F.col(c) for c in columns])
    rows = numbered(held.select("doc_id", "text", "source", F.struct(*columns).alias("row")), "row")
    copies = schedule(rows, stored(targets(rows), "mixing-goals")).select("row_no", F.col("words").alias("words_taken"))
    words = F.regexp_extract_all("row.text", F.lit(f"[{_SPACE}]*[^{_SPACE}]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words_taken").cast("int")), "")
    text = F.when(F.col("words_taken") < F.col("size"), cut).otherwise(F.col("row.text"))
    out = rows.join(copies.hint("merge"), "row_no")  # the mix grows with the input and is never broadcast
    values = {c: text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(f"row.{c}") for c in columns}
    return out.select(*[v.alias(c) for c, v in values.items()])
