"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Each source has a share of the training words and a schedule that says how that share is spread over
training time. The schedule is integrated to a cumulative demand of words; the place of a document
in its source is a demand, and the time at which the demand gets there is its training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: A word is a run of characters other than ASCII blanks.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: By weight, the intensity in equal phases of training; each row has the mean 1. Light sources come early, heavy ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MOST = 3


def demand(schedule: tuple[float, ...]) -> list[float]:
    """The integral of a schedule at the ends of its phases, from 0 to 1."""
    if min(schedule) <= 0:
        raise ValueError("a schedule has to stay above 0")
    out = [0.0]
    for x in schedule:
        out.append(out[-1] + x / sum(schedule))
    return [*out[:-1], 1.0]


def time_of(share: Column, schedule: tuple[float, ...]) -> Column:
    """The inverse of the demand: the time at which this share of a source's words has been taken."""
    knots, n = demand(schedule), len(schedule)
    out = F.lit(None).cast("double")
    for i in reversed(range(n)):
        inside = (F.lit(float(i)) + (share - F.lit(knots[i])) / F.lit(knots[i + 1] - knots[i])) / F.lit(float(n))
        out = F.when(share >= F.lit(knots[i]), inside) if i == n - 1 else F.when(share < F.lit(knots[i + 1]), inside).otherwise(out)
    return F.when(share.isNotNull(), out)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Words to take of each source: ``sizes`` (source, source_size) with weight, kind and target.

    Sources in order of code points, null last, get the weights in turn and share the sum of all
    sizes by weight. A target stops at ``most`` times its source; the excess goes to the others by
    weight until no target is above. That is where a common level stands: a source stops if the level
    with all that stop earlier reaches its limit. One row a source; these rows meet in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    kinds = sizes.withColumn("kind", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int"))
    kinds = kinds.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1).cast("bigint"))
    kinds = kinds.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("reach", F.col("limit") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").isNull(), "source")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    at = kinds.select("*", F.row_number().over(order).alias("n"), ((F.sum("source_size").over(everything) - before) / after).alias("level"))
    free = F.when(F.col("level") < F.col("reach"), F.struct("n", "level"))
    level = F.min(free).over(everything)["level"]
    target = F.when(F.col("level") < F.col("reach"), F.col("weight") * level).otherwise(F.col("limit").cast("double"))
    return at.withColumn("target", target).select("source", "source_size", "kind", "target")


def place(docs: DataFrame, carry: list[str], weights: tuple[int, ...], schedules: tuple[tuple[float, ...], ...], most: int, digits: int) -> DataFrame:
    """``carry`` of each row, and __size, __source_size, __target, __times and __positions.

    The order in a source is that of the ids' md5; rows that share an id are in the order of their
    sizes, then of their texts' hashes. Words before a document are those in earlier cells, which
    share the first ``digits`` digits, and those before it in its own cell.
    """
    if list(carry) == ["doc_id"]:
        # Without texts to carry, words are counted once.
        docs = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("__words"), F.xxhash64("text").alias("__tie")), "words")
        size, tie = F.col("__words"), F.col("__tie")
    else:
        size, tie = word_count(F.col("text")), F.xxhash64("text")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # One key for source and cell, so that the window and the join share a shuffle.
    cell = F.concat(F.substring(key, 1, digits), F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))))
    rows = docs.select(*carry, *([] if "doc_id" in carry else ["doc_id"]), size.alias("__size"), tie.alias("__tie"), key.alias("__key"), cell.alias("__cell"))
    light = docs.select(F.col("source").alias("__source"), size.alias("__size"), cell.alias("__cell"))
    cells = cut(light.groupBy("__source", "__cell").agg(F.sum("__size").alias("__in_cell")), "cells")
    goal = targets(cells.groupBy(F.col("__source").alias("source")).agg(F.sum("__in_cell").alias("source_size")), weights, most)
    earlier = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = cells.select("__source", "__cell", F.coalesce(F.sum("__in_cell").over(earlier), F.lit(0)).alias("__shift"))
    table = shift.join(goal, shift["__source"].eqNullSafe(goal["source"])).select(F.col("__cell").alias("__c"), "__shift", F.col("source_size").alias("__total"), F.col("kind").alias("__kind"), F.col("target").alias("__goal"))
    table = cut(table, "targets")
    in_cell = Window.partitionBy("__cell").orderBy("__key", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__before", F.coalesce(F.sum("__size").over(in_cell), F.lit(0)))
    joined = numbered.join(table, F.col("__cell") == F.col("__c"))
    start = F.col("__shift") + F.col("__before")
    middle = lambda e: start + F.col("__total") * F.lit(e) + F.col("__size") / F.lit(2.0)
    share = lambda e: F.when(middle(e) < F.col("__goal"), middle(e) / F.col("__goal"))

    def when(e: int) -> Column:
        out = F.lit(None).cast("double")
        for k, schedule in reversed(list(enumerate(schedules))):
            out = F.when(F.col("__kind") == k, time_of(share(e), schedule)).otherwise(out)
        return out

    positions = F.filter(F.array(*(when(e) for e in range(most))), lambda p: p.isNotNull())
    return joined.withColumn("__positions", positions).select(
        *carry,
        "__size",
        F.col("__total").alias("__source_size"),
        F.col("__goal").alias("__target"),
        F.size("__positions").cast("bigint").alias("__times"),
        "__positions",
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, most: int = MOST, digits: int = 3) -> DataFrame:
    """How the mix uses each row of ``docs`` (doc_id, source, text), in order of training positions.

    Returns doc_id, size (words), source_size, target (of its source), taken (words, repeats
    counted) and position (from 0 to 1, of the first use; null if it isn't used, and those rows come
    last). ``schedules`` has one row for each of ``weights``.

    A null text has no words. A null source is a source, and comes last. A document is used as often
    as the middle of its words lies within the demand, at most ``most`` times; so a source misses its
    target by half a document at most. Rows without doc_id, and rows that repeat one, stand at one
    place in the order, by size and a hash of their texts. Reruns agree, as only ids and texts decide.
    A very long text counts whole. An empty table gives an empty one. Other columns are not read.
    """
    placed = place(docs, ["doc_id"], weights, schedules, most, digits)
    out = placed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__times")).alias("taken"),
        F.get("__positions", F.lit(0)).alias("position"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, most: int = MOST, digits: int = 3) -> DataFrame:
    """The rows of ``docs`` as the mix uses them, with all their columns, range-sorted by training position.

    A row stands once for each use. Rows that the mix doesn't use go; rows without words, null texts
    among them, cost nothing and stay, once, at the start. Rows that repeat an id each have a place
    of their own, by size and a hash of their texts, so reruns use the same ones. An empty table
    gives an empty one; columns of any other name pass through.
    """
    placed = place(docs, docs.columns, weights, schedules, most, digits)
    uses = F.when(F.col("__size") == 0, F.array(F.lit(0.0))).otherwise(F.col("__positions"))
    spread = placed.select(*docs.columns, F.explode(uses).alias("__position"))
    return spread.repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id").drop("__position")
