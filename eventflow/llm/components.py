"""Connected components of a graph given as pairs of numbers, by alternating star steps.

Every step groups neighbours with a partial minimum and joins it back, so a node
with very many neighbours is no large task; the pairs never leave the executors.
What is written between the steps is a few numbers a node, so its tasks and files
follow the number of pairs, not the shuffle partitions that texts need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.session import pin

ROWS_PER_TASK = 50_000
LEAST_TASKS = 8


def tasks_for(rows: int) -> int:
    """How many tasks write so many rows of a few numbers each."""
    return max(LEAST_TASKS, -(-rows // ROWS_PER_TASK))


def _least(pairs: DataFrame, tasks: int) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # Written, so that the join below has a shuffle on both sides that AQE can split.
    return pin(least.select(F.col("u").alias("of"), F.least("u", "m").alias("m")).coalesce(tasks))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link each larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_least(both, tasks), F.col("u") == F.col("of"))
    return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, tasks)
    met = down.join(least, F.col("u") == F.col("of"))
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("of").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own)


def _settled(pairs: DataFrame, tasks: int) -> bool:
    """Whether every pair leads from a node that has no other to a root, in one pass instead of another round."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root"))
    )
    roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root")).coalesce(tasks)
    open_ = F.count_if(F.expr("child > 1 or (child = 1 and root = 1)"))
    return roles.agg(open_.alias("n")).first()["n"] == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``) but the roots; the root is the least.

    ``edges`` is read more than once: a table, or pinned.
    """
    tasks = tasks_for(edges.count())
    now = pin(edges.where("u <> v").select("u", "v").distinct().coalesce(tasks))
    while True:
        wide = pin(_large_star(now, tasks).where("u <> v").distinct().coalesce(tasks))
        now = pin(_small_star(wide, tasks).where("u <> v").distinct().coalesce(tasks))
        if _settled(now, tasks):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` as ``components`` gives them, with new ``links`` (``u``, ``v``) taken in."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
