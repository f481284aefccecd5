"""Joins and connected components that keep working when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.llm.text import stored

HOT_KEYS = 1000  # at most so many keys can each hold a thousandth of the rows


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and in ``count`` how many of ``rows`` have it.

    Keys with over a thousandth of the ``total`` rows, a thousand at most, are broadcast, so their rows don't move; all
    other keys meet in a shuffle, where no key is large. Both sides are read twice: hand in written tables.
    """
    hot = F.col(count) > max(HOT_KEYS, total // HOT_KEYS)
    top = F.broadcast(keyed.where(hot))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(top, keys).unionByName(rest.join(keyed.where(~hot), keys))


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a, b): root is the smallest node that it is connected with.

    Alternating large-star and small-star steps over the edge list; the list never grows beyond the input's edges,
    every step is written, and hubs are joined by ``join_counted``. Loops (a = b) give nodes of their own.
    """
    nodes = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), f"{label}-nodes")
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    before = None
    for step in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"{label}-low")
        total = 2 * links.count()
        large = (join_counted(both, low, ["a"], "n", total).where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        large = stored(large, f"{label}-large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"{label}-low")
        small = join_counted(large, low, ["a"], "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{label}-edges")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = links.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(root, nodes["node"] == root["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
