"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Tables


def components(edges: DataFrame, size: int | None = None) -> DataFrame:
    """The smallest member (comp) of the component of every vertex (v) of ``edges`` (a, b).

    Each round hooks every vertex to its smallest neighbour, follows the pointers to their ends, and
    carries the edges over to those; loops and repeats go. Whatever is left of a component loses at
    least one vertex a round and about half as a rule, so the rounds end, mostly after the logarithm
    of their number. Vertices may be of any ordered type. Edges with a null end count for nothing; a
    vertex with loops only is in no component; an empty table gives an empty one. ``size`` may give
    an upper bound of the edges. Joins are on written tables, deleted when the next round has its
    own, and join keys occur once on one side, so that adaptive execution can split a hot vertex.
    """
    made = Tables()
    live = made(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", size)
    label, n = None, live.count()
    vertices = 2 * n
    while n:
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = made(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).withColumn("p", F.least("v", "p")), "hooks", 2 * n)
        moving = True
        while moving:  # each pass doubles the length of the path that is followed
            far = hook.alias("x").join(hook.select(F.col("v").alias("w"), F.col("p").alias("q")), F.col("p") == F.col("w"), "left")
            far = made(far.select("v", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")), "hooks", 2 * n)
            made.drop(hook)
            hook, moving = far, not far.where("moved").isEmpty()
        if label is None:
            now = hook.select("v", F.col("p").alias("comp"))
        else:
            now = label.join(hook.select(F.col("v").alias("w"), "p"), F.col("comp") == F.col("w"), "left").select("v", F.coalesce("p", "comp").alias("comp"))
        at = lambda side: hook.select(F.col("v").alias(f"v_{side}"), F.col("p").alias(f"p_{side}"))
        moved = live.join(at("a"), F.col("a") == F.col("v_a")).join(at("b"), F.col("b") == F.col("v_b"))
        rest = made(moved.where("p_a != p_b").select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct(), "edges", n)
        found = made(now, "labels", vertices)
        made.drop(live, label, hook)
        live, label, n = rest, found, rest.count()
    if label is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"v {kind}, comp {kind}")
    made.drop(live)
    return label
