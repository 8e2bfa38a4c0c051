"""Chains of steps that are taken only in the right state: compare-and-set over a whole history at once.

A step (key, place, enter, leave) is taken where the state is ``enter``, and makes it ``leave``; else the state stays. From a
taken step the next one is thus the first later step whose ``enter`` is that state, which each step can look up for itself,
taken or not. Which steps are on the path from the saved state is found by doubling: what is reached is joined with where
2, 4, 8 ... steps further lead, so a chain of n steps takes log2(n) joins and no task holds a chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlore.sources.tables import shared_path

START = -1


def stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def next_steps(steps: DataFrame, start: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, after): for each step and each start, the first later step that its state lets in; none where there is none."""
    leaving = steps.select(*key, F.col("leave").alias("state"), "place", F.lit(0).alias("side"))
    leaving = leaving.unionByName(start.select(*key, "state", F.lit(START).cast("long").alias("place"), F.lit(0).alias("side")))
    both = leaving.unionByName(steps.select(*key, F.col("enter").alias("state"), "place", F.lit(1).alias("side")))
    # downwards, a step that leaves comes before the one that enters at the same place, so none follows itself
    later = Window.partitionBy(*key, "state").orderBy(F.desc("place"), "side").rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(F.when(F.col("side") == 1, F.col("place")), ignorenulls=True).over(later)
    return both.withColumn("after", after).where("side = 0 and after is not null").select(*key, "place", "after")


def taken(steps: DataFrame, start: DataFrame, key: list[str], store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(key, place) of the steps on the path from each start (key, state). Steps: (key, place, enter, leave), a place once a key.

    States are compared null-safe: a null ``enter`` is a step out of "nothing saved yet". Keys without a start have no path.
    """
    jump = store(next_steps(steps, start, key), "chain-next")
    reached = store(start.select(*key, F.lit(START).cast("long").alias("place")).distinct(), "chain-reached")
    n = reached.count()
    while True:
        further = reached.join(jump, [*key, "place"]).select(*key, F.col("after").alias("place"))
        reached = store(reached.unionByName(further).distinct(), "chain-reached")
        grown = reached.count()
        if grown == n:
            return reached.where(F.col("place") != START)
        n = grown
        twice = jump.withColumnRenamed("after", "middle").join(
            jump.select(*key, F.col("place").alias("middle"), "after"), [*key, "middle"]
        )
        jump = store(twice.select(*key, "place", "after"), "chain-next")


def states(steps: DataFrame, path: DataFrame, start: DataFrame, key: list[str]) -> DataFrame:
    """``steps`` with ``reached``, and ``before``: the state that the steps before have left."""
    rows = steps.join(path.withColumn("on_path", F.lit(True)), [*key, "place"], "left").withColumn("reached", F.coalesce("on_path", F.lit(False)))
    rows = rows.join(start.withColumnRenamed("state", "at_start").distinct(), key, "left")
    earlier = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("reached"), F.struct(F.col("leave").alias("v"))), ignorenulls=True).over(earlier)
    before = F.when(last.isNotNull(), last["v"]).otherwise(F.col("at_start"))
    return rows.withColumn("before", before).drop("on_path", "at_start")
