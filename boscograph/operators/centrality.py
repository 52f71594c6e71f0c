"""Centrality of the nodes of a simple undirected graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscograph.operators.graph import simple_pairs
from boscograph.session import cut_table as cut  # a checkpoint keeps what was inferred of its columns, which grows from round to round

#: Exact shortest-path measures need the graph in every task; larger graphs are refused rather than sampled.
MOST_PAIRS = 1_000_000


def degree_centrality(edges: DataFrame) -> DataFrame:
    """name, degree_centrality = neighbours / (nodes - 1)."""
    deg = simple_pairs(edges).select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("d"))
    n = deg.agg(F.count("*").alias("n"))
    return deg.crossJoin(F.broadcast(n)).select("name", (F.col("d") / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_centrality"))  # one row


def eigenvector(edges: DataFrame, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """name, eigenvector_centrality (length 1) by power iteration on A + I: a join and a group-by a round."""
    pairs = cut(simple_pairs(edges).select("a", "b"))
    arcs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
    score = cut(arcs.select(F.col("u").alias("name")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        nxt = arcs.join(score, arcs.u == score.name).select(F.col("v").alias("name"), "x").unionByName(score).groupBy("name").agg(F.sum("x").alias("y"))
        nxt = cut(nxt.join(score, "name"))
        norm = nxt.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("n")).first()["n"]
        if not norm:
            break
        moved = nxt.agg(F.max(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        score = nxt.select("name", (F.col("y") / norm).alias("x"))
        if moved < tolerance:
            break
    return score.withColumnRenamed("x", "eigenvector_centrality")


def paths_centrality(edges: DataFrame, partitions: int = 64) -> DataFrame:
    """name, closeness (scaled by the part that is reached) and betweenness (normalised), exact.

    One breadth-first search from every node; the sources are spread over tasks, each of which holds the graph. A graph of over MOST_PAIRS pairs is
    refused, since exact values need as many searches as nodes.
    """
    pairs = cut(simple_pairs(edges).select("a", "b"))
    n_pairs = pairs.count()
    if n_pairs > MOST_PAIRS:
        raise ValueError(f"{n_pairs} pairs; exact path centrality takes at most {MOST_PAIRS}")
    shared = edges.sparkSession.sparkContext.broadcast([(r["a"], r["b"]) for r in pairs.collect()])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = sorted({x for p in shared.value for x in p})
        at = {x: i for i, x in enumerate(names)}
        near: list[list[int]] = [[] for _ in names]
        for a, b in shared.value:
            near[at[a]].append(at[b])
            near[at[b]].append(at[a])
        n, through, close = len(names), [0.0] * len(names), []
        for pdf in batches:
            for name in pdf["name"]:
                s = at[name]
                dist, ways, before, order, todo = [-1] * n, [0.0] * n, [[] for _ in range(n)], [], deque([s])
                dist[s], ways[s] = 0, 1.0
                while todo:
                    v = todo.popleft()
                    order.append(v)
                    for u in near[v]:
                        if dist[u] < 0:
                            dist[u] = dist[v] + 1
                            todo.append(u)
                        if dist[u] == dist[v] + 1:
                            ways[u] += ways[v]
                            before[u].append(v)
                share = [0.0] * n
                for v in reversed(order):
                    for u in before[v]:
                        share[u] += ways[u] / ways[v] * (1 + share[v])
                    if v != s:
                        through[v] += share[v]
                total, got = sum(dist[v] for v in order), len(order) - 1
                close.append((name, got / total * got / (n - 1) if total and n > 1 else 0.0))
        if close:
            scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
            yield pd.DataFrame({"name": [c[0] for c in close], "closeness": [c[1] for c in close], "part": [0.0] * len(close)})
            yield pd.DataFrame({"name": names, "closeness": [-1.0] * n, "part": [x * scale for x in through]})

    sources = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().repartition(partitions if n_pairs > 1000 else 4, "name")
    out = sources.mapInPandas(search, "name string, closeness double, part double")
    return out.groupBy("name").agg(F.max("closeness").alias("closeness"), F.sum("part").alias("betweenness"))
