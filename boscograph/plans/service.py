"""What a web or command-line front end asks, with the bounds of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscograph.operators import extract, feedback, graph, search
from boscograph.plans import pipeline


def _bound(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return value


class GraphService:
    """nodes: name, type, total_degree, importance; edges: src, dst, rel_type, weight."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, images: DataFrame | None = None, vectors: DataFrame | None = None):
        self.nodes, self.edges, self.images, self.vectors = nodes, edges, images, vectors

    def page(self, limit: int = 100, node_type: str | None = None, relation_type: str | None = None, exclude_other: bool = False) -> tuple[DataFrame, DataFrame]:
        n = self.nodes
        n = n.where(F.col("type") == node_type) if node_type else n
        n = n.where("type <> 'Other'") if exclude_other else n
        top = graph.page(n, _bound("limit", limit, 1, 1000))
        e = self.edges.where(F.col("rel_type") == relation_type) if relation_type else self.edges
        return top, graph.induced(e, top)

    def list_nodes(self, limit: int = 100, offset: int = 0, category: str | None = None, min_importance: int | None = None) -> DataFrame:
        n = self.nodes.where(F.col("type") == category) if category else self.nodes
        n = n.where(F.col("importance") >= _bound("min_importance", min_importance, 1, 5)) if min_importance else n
        return graph.page(n, _bound("limit", limit, 1, 1000), _bound("offset", offset, 0, 2**31 - 1))

    def node(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The node (empty if there is none), up to 20 neighbours and up to 50 relations."""
        mine = graph.both_ways(self.edges, "rel_type", "weight").where(F.col("name") == name)
        near = mine.where("other <> name").select("other").distinct().orderBy("other").limit(20)
        return self.nodes.where(F.col("name") == name), near, mine.orderBy(F.desc("weight"), "rel_type", "other").limit(50)

    def subgraph(self, name: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        seed = self.nodes.where(F.col("name") == name).select("name")
        return graph.neighbourhood(self.edges, seed, _bound("depth", depth, 1, 3))

    def path(self, source: str, target: str, max_length: int = 5) -> DataFrame:
        return graph.shortest_path(self.edges, source, target, _bound("max_length", max_length, 1, 10))

    def stats(self) -> DataFrame:
        return graph.stats(self.edges)

    def top_nodes(self, limit: int = 10) -> DataFrame:
        return graph.ranked(self.nodes, "total_degree", limit)

    def search(self, q: str, category: str | None = None, min_importance: int | None = None, limit: int = 20) -> DataFrame:
        if not q:
            raise ValueError("nothing to search for")
        return search.search(self.nodes, q, category, min_importance, _bound("limit", limit, 1, 100))

    def suggest(self, q: str, limit: int = 5) -> DataFrame:
        return search.suggest(self.nodes, q, _bound("limit", limit, 1, 20))

    def local_search(self, query: Column, top_k: int = 5, depth: int = 1) -> DataFrame:
        """Lines to answer from, around the entities (vec_id, entity, vector) nearest to a query vector."""
        found, inside = search.local_search(self.vectors, "vec_id", "entity", "vector", query, self.edges, top_k, depth)
        return search.context_lines(found, inside)

    def community_summary(self, concepts: DataFrame, algorithm: str = "louvain") -> DataFrame:
        labels = pipeline.communities(self.edges, self.nodes.select("name"), algorithm)
        return search.community_summaries(labels, concepts).orderBy(F.desc("size"), "community")

    def retrieve_images(self, concepts: list[str], per_concept: int = 3) -> DataFrame:
        return extract.images_for(self.images, concepts, per_concept)

    def image_stats(self) -> DataFrame:
        one = self.images.agg(F.count("*").alias("links"), F.count_distinct("image_path").alias("images"), F.count_distinct("concept").alias("concepts"))
        return one.withColumn("per_concept", F.when(F.col("concepts") > 0, F.round(F.col("links") / F.col("concepts"), 2)))

    @staticmethod
    def feedback_report(rows: DataFrame) -> DataFrame:
        return feedback.report(feedback.once(rows))
