"""Search, retrieval and summaries over concepts and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.operators import graph
from boscograph.operators.resolve import cosine


def search(nodes: DataFrame, q: str, kind: str | None = None, least_importance: int | None = None, limit: int = 20) -> DataFrame:
    """Nodes (name, type, importance, total_degree) whose name holds q, without case; by degree, then name."""
    hit = nodes.where(F.lower("name").contains(q.lower()))
    if kind:
        hit = hit.where(F.col("type") == kind)
    if least_importance:
        hit = hit.where(F.col("importance") >= least_importance)
    return hit.orderBy(F.desc_nulls_last("total_degree"), "name").limit(max(1, min(limit, 100)))


def suggest(nodes: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """Different names that hold q, the shortest first."""
    names = nodes.where(F.lower("name").contains(q.lower())).select("name").distinct()
    return names.orderBy(F.length("name"), "name").limit(max(1, min(limit, 20)))


def nearest(vectors: DataFrame, key: str, vector: str, query: Column, k: int = 5) -> DataFrame:
    """The k rows most similar to one query vector: a scan with a bounded sort in each task."""
    return vectors.where(F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def local_search(vectors: DataFrame, key: str, name: str, vector: str, query: Column, edges: DataFrame, k: int = 5, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, dist) around the k best vectors, and the edges among them, for an answer to be written from."""
    top = nearest(vectors.where(F.col(name).isNotNull()), key, vector, query, k).join(vectors.select(key, name), key).select(F.col(name).alias("name")).distinct()
    found = graph.reachable(edges, top, hops)
    return found, graph.induced(edges, found)


def context_lines(found: DataFrame, inside: DataFrame, concepts: int = 15, relations: int = 20) -> DataFrame:
    """line_no, line: the nearest concepts by name, then the heaviest relations, as the text for an answer."""
    c = found.orderBy("dist", "name").limit(concepts).select(F.lit(0).alias("part"), F.col("dist").cast("double").alias("o"), F.concat(F.lit("- "), "name").alias("line"))
    r = inside.orderBy(F.desc("weight"), "src", "rel_type", "dst").limit(relations).select(F.lit(1).alias("part"), (-F.col("weight")).alias("o"), F.concat("src", F.lit(" -["), "rel_type", F.lit("]-> "), "dst").alias("line"))
    both = c.unionByName(r)  # at most concepts + relations rows
    return both.withColumn("line_no", F.row_number().over(W.orderBy("part", "o", "line"))).select("line_no", "line")


def community_summaries(labels: DataFrame, concepts: DataFrame, core: int = 5) -> DataFrame:
    """community, title, core_concepts, theme, size by rule: the most frequent category is the theme, the most important concepts are the core.

    labels: name, community; concepts: entity, category, importance, one row per entity. Size counts all members, with or without a concept row.
    """
    size = labels.groupBy("community").agg(F.count("*").alias("size"))
    m = labels.join(concepts, labels.name == concepts.entity)
    theme = m.where("category is not null").groupBy("community", "category").agg(F.count("*").alias("n")).groupBy("community").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("theme"))
    top = graph.top_per_group(m.select("community", "entity", "importance"), "community", [F.desc_nulls_last("importance"), F.col("entity")], core)
    names = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("importance", F.lit(0))).alias("i"), "entity"))), lambda x: x.entity), ", ").alias("core_concepts"))
    j = size.join(theme, "community", "left").join(names, "community", "left").withColumn("theme", F.coalesce("theme", F.lit("mixed")))
    title = F.concat(F.upper("theme"), F.lit(" 相关知识 ("), F.col("size").cast("string"), F.lit(" 概念)"))
    return j.select("community", title.alias("title"), F.coalesce("core_concepts", F.lit("")).alias("core_concepts"), "theme", "size")
