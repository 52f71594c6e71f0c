"""Concept and relationship tables: building, merging, filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V


def mapped(c: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed dictionary as an expression that stays inside code generation."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def standard_category(c: Column) -> Column:
    """Standard (Chinese) name of a category; standard names stay, others and null become 其他."""
    table = V.CATEGORY | {v: v for v in V.CATEGORY.values()}
    return mapped(F.lower(c), table, F.lit(V.OTHER_CATEGORY))


def clamp_importance(c: Column) -> Column:
    """1 to 5; 3 where it can't be read as a number."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c.try_cast("int"), F.lit(3))))


def first_seen_join(values: Column, order: Column, sep: str) -> Column:
    """Aggregate: the distinct values joined by sep in the order of their first appearance."""
    pairs = F.array_sort(F.collect_set(F.when(values.isNotNull(), F.struct(order.alias("o"), values.alias("v")))))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda p: p.v)), sep)


def aggregate_concepts(concepts: DataFrame) -> DataFrame:
    """One row per entity: highest importance, most frequent category (the smallest of ties), chunks in order of appearance, first type.

    Needs entity, importance, category, chunk_id, type, ord (a total order). Rows without entity are dropped.
    """
    c = concepts.where("entity is not null")
    chunks = c.where("chunk_id is not null").groupBy("entity", "chunk_id").agg(F.min("ord").alias("ord"))
    joined = chunks.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x.chunk_id), ",").alias("chunk_id"))
    modes = c.where("category is not null").groupBy("entity", "category").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    rest = c.groupBy("entity").agg(F.max("importance").alias("importance"), F.min_by("type", F.when(F.col("type").isNotNull(), F.col("ord"))).alias("type"))
    return rest.join(modes, "entity", "left").join(joined, "entity", "left").select("entity", "importance", "category", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "type")


def co_occurrences(concepts: DataFrame, most: int = 0) -> DataFrame:
    """Weak relations: ordered pairs of different entities of a chunk, by their place in it; repeated mentions give repeated rows.

    Only pairs inside one chunk arise, whose concepts an extractor gives for a text of limited length; the join is on the chunk.
    """
    c = concepts.where("entity is not null and chunk_id is not null").select("chunk_id", F.lower("entity").alias("e"), "ord")
    a, b = c.select("chunk_id", F.col("e").alias("node_1"), F.col("ord").alias("o1")), c.select("chunk_id", F.col("e").alias("node_2"), F.col("ord").alias("o2"))
    pairs = a.join(b, "chunk_id").where("o1 < o2 and node_1 <> node_2")
    return pairs.select("node_1", "node_2", F.lit("co-occurs in").alias("edge"), F.lit(0.5).alias("weight"), "chunk_id", F.lit("proximity").alias("source"))


def merge_edges(edges: DataFrame, order: Column) -> DataFrame:
    """Directed pairs with summed weight over the largest sum; edge, chunk_id and source joined in order of first appearance.

    order is a total order of the rows. Distinct values are found by a group-by before they are gathered, so a pair with very many rows gathers only
    its different values. Rows with a null end are dropped.
    """
    e = edges.where("node_1 is not null and node_2 is not null").withColumn("_o", order)
    keys = ["node_1", "node_2"]
    total = e.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    out = total
    for name, sep in (("edge", " | "), ("chunk_id", ","), ("source", ",")):
        seen = e.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min("_o").alias("o"))
        text = seen.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", name))), lambda x: x[name]), sep).alias(name))
        out = out.join(text, keys, "left")
    most = F.broadcast(total.agg(F.max("weight").alias("_m")))  # one row
    out = out.crossJoin(most)
    return out.select(*keys, "edge", F.when(F.col("_m") > 0, F.col("weight") / F.col("_m")).otherwise(F.col("weight")).alias("weight"), "chunk_id", "source")


def merge_edges_max(edges: DataFrame, order: Column) -> DataFrame:
    """By (node_1, node_2, edge): largest weight, sorted union of the sources, first chunk."""
    e = edges.where("node_1 is not null and node_2 is not null and edge is not null").withColumn("_o", order)
    keys = ["node_1", "node_2", "edge"]
    sources = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("source", ","))))), ",")
    return e.groupBy(*keys).agg(F.max("weight").alias("weight"), sources.alias("source"), F.min_by("chunk_id", F.when(F.col("chunk_id").isNotNull(), F.col("_o"))).alias("chunk_id"))


def degrees(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """name, out_degree, in_degree, total_degree (self-loops count in both), incident_edges (count once). One shuffle of partial sums."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col(a).alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("e")),
        F.struct(F.col(b).alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.when(F.col(a) == F.col(b), 0).otherwise(1).alias("e")))).alias("x")).select("x.*")
    d = ends.where("name is not null").groupBy("name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("e").alias("incident_edges"))
    return d.select("name", "out_degree", "in_degree", (F.col("out_degree") + F.col("in_degree")).alias("total_degree"), "incident_edges")


def filter_concepts(concepts: DataFrame, edges: DataFrame, min_importance: int = 2, min_connections: int = 1, generic: tuple[str, ...] = V.GENERIC) -> DataFrame:
    """Concepts that aren't general words, important enough and on enough relations (node_1, node_2); without relations the last test is left out."""
    kept = concepts.where(~F.lower("entity").isin(*generic) & (F.col("importance") >= min_importance))
    if edges.isEmpty() or min_connections <= 0:
        return kept
    d = degrees(edges, "node_1", "node_2").where(F.col("incident_edges") >= min_connections).select(F.col("name").alias("entity"))
    return kept.join(d, "entity", "left_semi")


def restrict_edges(edges: DataFrame, nodes: DataFrame, fold_case: bool = False, a: str = "node_1", b: str = "node_2") -> DataFrame:
    """Edges both of whose ends are among nodes.entity; all of them if there are no nodes."""
    if nodes.isEmpty():
        return edges
    f = F.lower if fold_case else (lambda c: c)
    names = nodes.select(f(F.col("entity")).alias("_n")).distinct()
    for end in (a, b):
        edges = edges.join(names, f(F.col(end)) == F.col("_n"), "left_semi")
    return edges


def apply_mapping(edges: DataFrame, mapping: DataFrame, a: str = "node_1", b: str = "node_2") -> DataFrame:
    """Ends renamed by mapping (name, canonical), unknown ones kept, self-loops dropped."""
    m = mapping.dropDuplicates(["name"])
    for end in (a, b):
        m2 = m.select(F.col("name").alias("_k"), F.col("canonical").alias("_c"))
        edges = edges.join(m2, F.col(end) == F.col("_k"), "left").withColumn(end, F.coalesce("_c", end)).drop("_k", "_c")
    return edges.where(F.col(a) != F.col(b))


def triples(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges with the categories of both ends, names compared without case, the first concept of a name counting; ends without concept drop out."""
    w = W.partitionBy(F.lower("entity")).orderBy("ord")
    first = concepts.where("entity is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.lower("entity").alias("_k"), "category")
    a = first.select(F.col("_k").alias("_a"), F.col("category").alias("node_1_type"))
    b = first.select(F.col("_k").alias("_b"), F.col("category").alias("node_2_type"))
    j = edges.join(a, F.lower("node_1") == F.col("_a")).join(b, F.lower("node_2") == F.col("_b"))
    return j.select("node_1", "node_1_type", F.col("edge").alias("relationship"), "node_2", "node_2_type", F.coalesce("weight", F.lit(0.8)).alias("weight"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order; null keys count as one key."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without bringing them into one task: ranges of the order are numbered each on its own, after the counts of those before."""
    from boscograph.session import cut_table

    parts = cut_table(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    if not before:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    rank = F.row_number().over(W.partitionBy("_p").orderBy(*order)).cast("long")
    return parts.withColumn(name, rank + mapped(F.col("_p"), before).cast("long")).drop("_p")
