"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that only depends on doc_id and text; a
document's second copy comes after all first copies of its source. A copy's virtual finish time is the
number of its source's words up to and including it, divided by the source's target. All copies are
range-sorted by that time and the stream is truncated at the total budget, the sum of the targets.

The budget is reached about when virtual time is 1. The one copy of each source that is in service then
is queued in three pieces, up to that time, the next word and the rest, so that the cut doesn't take or
leave a very long document as a whole. ``mix`` takes whole copies: those of which at least half lies before the cut.

Targets: the sources in code-point order, null last, weigh 5, 2, 1, repeating, and share 150 % of
all words; a target stops at twice the words of its source, and the excess is shared again by weight
until none is above. Null text has no words; a document without words takes nothing. Repeated rows
are separate documents. Equal finish times go by source, then by place in the queue. An empty table
gives an empty result; other columns don't matter.

Orders and sums, of sources as well, are taken by range sorts with partition offsets; prefix sums of a
queue by parts of it, by a hash of the row. So neither a source nor the list of sources has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.llm import common

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
#: Bits of the row's hash that name the part of a source within which documents are ordered by one task.
PART_BITS = 10


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a hash and a row number, written once: the text is read here only."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long")
    key = F.xxhash64("doc_id", "text")
    return common.written(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: number (from 1, in the order of the sources), source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    per = common.running(per, by_name, {}, "sources").withColumnRenamed("place", "number")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_COPIES)
    # Water filling: sources in the order in which they reach their cap, least cap per weight first. A source is
    # capped exactly if the level that the sources from it on would share is above its own cap per weight.
    per = common.running(per, [F.col("cap") / F.col("weight"), F.col("number")], {"caps": "cap", "weights": "weight"}, "levels")
    whole = per.agg((F.coalesce(F.sum("source_size"), F.lit(0)) * BUDGET).alias("budget"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weights"))
    budget, all_weights = whole.first()
    left = F.greatest(F.lit(budget) - F.col("caps") + F.col("cap"), F.lit(0.0))
    per = per.withColumn("level", left / (F.lit(all_weights) - F.col("weights") + F.col("weight")))
    # The first source that isn't capped sets the level of all that follow.
    first = per.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("place", "level")).alias("first")).first()[0]
    if first is None:
        target = F.col("cap").cast("double")
    else:
        target = F.when(F.col("place") < first.place, F.col("cap").cast("double")).otherwise(F.lit(first.level) * F.col("weight"))
    return per.select("number", "source", "source_size", target.alias("target"))


def queued(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """The rows with their source's number, source_size and target, and start: the words before them in their queue."""
    part = F.shiftrightunsigned("key", 64 - PART_BITS).cast("int")
    rows = sizes.withColumn("part", part)
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part and source: at most 2 ** PART_BITS for each source.
    sums = sums.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    sums = sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "number", "source_size", "target")
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.part") == F.col("s.part"))
    rows = rows.alias("r").join(sums.alias("s"), same).select("r.*", "base", "number", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("base") + F.sum("size").over(within) - F.col("size")
    return rows.select("doc_id", "source", "size", "row", "number", "source_size", "target", start.alias("start"))


def stream(rows: DataFrame) -> DataFrame:
    """What is queued, unsorted: row, number, copy, start (in its queue), words and finish, an entry per copy or piece of one."""
    copies = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1))).alias("copy"))
    begin = F.col("start") + F.col("copy") * F.col("source_size")
    copies = copies.select("row", "number", "copy", "target", begin.alias("start"), "size")
    due = F.floor(F.col("target") + F.lit(1e-6)) - F.col("start")
    piece = lambda at, words: F.struct(at.cast("long").alias("at"), words.cast("long").alias("words"))
    three = F.array(piece(F.lit(0), due), piece(due, F.lit(1)), piece(due + 1, F.col("size") - due - 1))
    pieces = F.when((due >= 0) & (due < F.col("size")), three).otherwise(F.array(piece(F.lit(0), F.col("size"))))
    entries = copies.select("*", F.inline(pieces)).where("words > 0")
    start = F.col("start") + F.col("at")
    return entries.select("row", "number", "copy", start.alias("start"), "words", ((start + F.col("words")) / F.col("target")).alias("finish"))


def served(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queued rows; and row, copy and taken of every copy that the truncated stream takes words of."""
    sizes = sized(docs)
    goal = common.written(targets(sizes), "targets")
    rows = common.written(queued(sizes, goal), "queues")
    budget = goal.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    entries = common.running(stream(rows), ["finish", "number", "start", "copy"], {"so_far": "words"}, "stream")
    left = F.lit(int(budget + 1e-6)) - F.col("so_far") + F.col("words")
    cut = entries.select("row", "copy", F.least("words", left).alias("words")).where("words > 0")
    return rows, cut.groupBy("row", "copy").agg(F.sum("words").alias("taken"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the virtual finish time of the first copy."""
    rows, taken = served(docs.select("doc_id", "text", "source"))
    taken = taken.groupBy("row").agg(F.sum("taken").alias("taken"))
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    out = rows.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", "taken", finish.alias("virtual_finish"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows in service order, a document once for each copy of which at least half is taken, whole; the columns of ``docs``."""
    numbered = common.numbered(docs)
    rows, taken = served(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source")))
    plan = taken.join(rows, "row").where("2 * taken >= size")
    finish = (F.col("start") + F.col("size") + F.col("copy") * F.col("source_size")) / F.col("target")
    plan = plan.select(F.col("doc_id").alias("number"), "copy", finish.alias("finish"))
    return numbered.join(plan, "number").sort("finish", "number", "copy").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(common.table(spark, sf_dir, "documents"))
