"""From documents to a filtered graph: the whole construction as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscograph.config import Config
from boscograph.functions import cleaning
from boscograph.operators import extract, graph, ontology, relations, resolve
from boscograph.session import cut_table
from boscograph.sources import store


@dataclass
class Graph:
    concepts: DataFrame
    relationships: DataFrame
    mapping: DataFrame


def chunks_of(documents: DataFrame, config: Config) -> DataFrame:
    """chunk_id ({document}_{window}), paper, chunk_no, text of documents (doc_id, text)."""
    w = cleaning.windows(cleaning.clean(F.col("text")), config.get("chunk.size"), config.get("chunk.step"), config.get("chunk.least"))
    own = documents.select(F.col("doc_id").cast("string").alias("paper"), F.explode(w).alias("w"))
    return own.select(F.concat_ws("_", "paper", F.col("w.no").cast("string")).alias("chunk_id"), "paper", F.col("w.no").alias("chunk_no"), F.col("w.text").alias("text"))


def answers_of(chunks: DataFrame, call: Callable[[str], str | None], done: DataFrame | None = None) -> DataFrame:
    """Answers of a provider for the chunks that aren't done, written down before anything reads them twice."""
    todo = chunks if done is None else store.unprocessed(chunks, done)
    return cut_table(extract.ask(todo, call))


def similar_names(concepts: DataFrame, config: Config) -> DataFrame:
    """(name, canonical) of names of one category that match by the threshold: groups of linked names go to their most important one."""
    least = config.get("dedup.similarity_threshold")
    pairs = resolve.similar_pairs(concepts, "ord", "entity", least, within="category")
    name = concepts.select("ord", "entity")
    links = pairs.join(name.select(F.col("ord").alias("a"), F.col("entity").alias("src")), "a").join(name.select(F.col("ord").alias("b"), F.col("entity").alias("dst")), "b").select("src", "dst", F.lit(1.0).alias("weight"))
    groups = graph.components(links, name.select(F.col("entity").alias("name")))
    chosen = resolve.representatives(groups.select(F.col("name").alias("entity"), F.col("component").alias("cluster")), concepts)
    return chosen.select(F.col("entity").alias("name"), F.col("representative").alias("canonical"))


def build(answers: DataFrame, config: Config | None = None, rules: dict[str, str] | None = None) -> Graph:
    """Concepts and relationships of JSON answers (chunk_id, answer): co-occurrences are added, weights merged, names made canonical (rules, then
    likeness), merged again, and both tables filtered."""
    config = config or Config()
    concepts = extract.concepts_of(answers)
    concepts = concepts.withColumn("entity", F.lower(resolve.canonical(F.col("entity"), rules))).withColumn("category", relations.standard_category(F.col("category")))
    concepts = cut_table(concepts.withColumn("ord", F.xxhash64("chunk_id", "ord")))
    strong = extract.relations_of(answers).withColumn("node_1", F.lower(resolve.canonical(F.col("node_1"), rules))).withColumn("node_2", F.lower(resolve.canonical(F.col("node_2"), rules)))
    edges = strong.unionByName(relations.co_occurrences(concepts), allowMissingColumns=True).where("node_1 <> node_2")
    edges = cut_table(relations.merge_edges(edges, F.struct("source", "chunk_id", "edge")))
    names = relations.aggregate_concepts(concepts).withColumn("ord", F.xxhash64("entity"))
    mapping = cut_table(similar_names(names, config))
    moved = concepts.join(mapping, concepts.entity == mapping.name, "left").withColumn("entity", F.coalesce("canonical", "entity")).drop("name", "canonical")
    merged = relations.merge_edges(relations.apply_mapping(edges, mapping), F.struct("source", "chunk_id", "edge"))
    merged = cut_table(merged)
    kept = relations.filter_concepts(relations.aggregate_concepts(moved), merged, config.get("filter.min_importance"), config.get("filter.min_connections"))
    kept = cut_table(kept)
    return Graph(kept, relations.restrict_edges(merged, kept), mapping)


def property_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, all_labels, degrees, importance, color, icon) and edges (with width and label) of triples (node_1, relationship, node_2, weight)."""
    from boscograph.functions import vocabulary as V

    edges = triples.select(F.col("node_1").alias("src"), F.col("node_2").alias("dst"), F.col("relationship").alias("rel_type"), "weight")
    d = relations.degrees(edges)
    kind = ontology.node_type(F.col("name"))
    nodes = d.withColumn("type", kind).select("name", "type", ontology.labels(F.col("type")).alias("all_labels"), "out_degree", "in_degree", "total_degree", ontology.importance_of(F.col("total_degree")).alias("importance"), ontology.styled(F.col("type"), V.NODE_STYLE, 0).alias("color"), ontology.styled(F.col("type"), V.NODE_STYLE, 1).alias("icon"))
    return nodes, edges.withColumn("width", ontology.styled(F.col("rel_type"), V.RELATION_STYLE, 1)).withColumn("label", ontology.styled(F.col("rel_type"), V.RELATION_STYLE, 2))


#: What stands in for an algorithm that fails.
FALLBACK = {"leiden": "louvain", "louvain": "components", "label_propagation": "components"}


def communities(edges: DataFrame, nodes: DataFrame, algorithm: str = "louvain", fallback: bool = False) -> DataFrame:
    """name, community by louvain, leiden (louvain, refined), label_propagation or connected components. With fallback, an algorithm that doesn't settle gives way to the next of FALLBACK."""
    ways = {
        "louvain": graph.louvain, "leiden": graph.leiden, "label_propagation": graph.label_propagation,
        "components": lambda e, n: graph.components(e, n).withColumnRenamed("component", "community"),
    }
    if algorithm not in ways:
        raise ValueError(algorithm)
    try:
        return ways[algorithm](edges, nodes)
    except RuntimeError:
        if not fallback or algorithm not in FALLBACK:
            raise
        return communities(edges, nodes, FALLBACK[algorithm], True)
