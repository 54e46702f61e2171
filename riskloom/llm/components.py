"""Connected components of a link table by union-find and star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's links: a star (node, least node) per local component."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            x, y = find(x), find(y)
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
    rows = [(x, find(x)) for x in list(up)]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour (or itself)."""
    e = _both(e)
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    hung = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))


#: Links that one task contracts.
LINKS_PER_TASK = 500_000


def _print(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); component is the least node.

    Tasks of ``links_per_task`` links contract them by union-find.  Where there
    are several tasks, large-star and small-star rounds, which only join and
    aggregate, finish across them.  Every round is written to the shared folder.
    """
    spark = links.sparkSession
    real = links.where("a <> b").select("a", "b")
    tasks = -(-real.count() // links_per_task)
    stars = real.coalesce(max(1, tasks)).mapInPandas(_forest, "a long, b long")
    e = written(stars, "stars")
    if tasks > 1:
        e = written(e.distinct(), "stars")
        mark = _print(e)
        while True:
            nxt = written(_small_star(_large_star(e)).where("a <> b").distinct(), "stars")
            release(spark, e)
            e, last, mark = nxt, mark, _print(nxt)
            if mark == last:
                break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
