"""Consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscograph.session import cut


def _jump(parents: DataFrame) -> DataFrame:
    """v -> p(p(v)). Every p is itself a v, so nothing is lost. A p shared by very many v is a skewed side with a unique partner, which AQE splits."""
    up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
    return parents.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping, two jumps a round, until no label changes."""
    while True:
        parents = cut(_jump(_jump(parents).select("v", "p")))
        if parents.where("moved").isEmpty():
            return parents.select("v", "p")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link to another one; root is the smallest node of its component by code point.

    Each round takes as parent of a node the smallest of itself and its neighbours (a group-by with map-side combine, so a hub
    is no hot task), moves all nodes up to the root of their tree by pointer jumping, and carries the links over to the roots.
    Links shrink at least by half each round and the rounds end when none is left. Every round is checkpointed. The parents of
    the rounds are joined from the last back to the first; that costs as much as their sizes, which shrink alike.
    Null ends and self-links are ignored, repeated links count once, an empty table gives an empty one.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not levels or not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("x"))
        first = both.select("x.*").groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        roots = _roots(cut(first))
        levels.append(roots)
        at_a, at_b = roots.select(F.col("v").alias("a"), F.col("p").alias("x")), roots.select(F.col("v").alias("b"), F.col("p").alias("y"))
        moved = links.join(at_a, "a").join(at_b, "b").where("x <> y")
        links = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = levels.pop()
    while levels:
        upper = found.select(F.col("v").alias("p"), F.col("p").alias("q"))
        found = levels.pop().join(upper, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    return found.select(F.col("v").alias("node"), F.col("p").alias("root"))


def connect_rows(df: DataFrame, names: Column) -> DataFrame:
    """connected() where each row holds an array of names that belong together; nulls in it are ignored."""
    own = df.select(F.array_distinct(F.filter(names, lambda x: x.isNotNull())).alias("n")).where(F.size("n") > 1)
    pairs = own.select(F.col("n")[0].alias("a"), F.explode(F.slice("n", 2, F.size("n") - 1)).alias("b"))
    return connected(pairs, "a", "b")
