"""Types of nodes and what relations may hold between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V
from boscograph.operators.relations import mapped


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.trim(c) == w[1:] if w[0] == "=" else c.contains(w) for w in words))


def node_type(name: Column, by_name: dict = V.NODE_TYPE_BY_NAME, rules: tuple = V.NODE_TYPE) -> Column:
    """Type of a graph node: by its whole name, else the first rule with one of its words and none of its exclusions."""
    out = F.lit("Other")
    for kind, words, without, folded in reversed(rules):
        c = F.lower(name) if folded else name
        test = _any(c, words)
        out = F.when(test & ~_any(name, without) if without else test, F.lit(kind)).otherwise(out)
    return F.when(name.isNull(), None).otherwise(mapped(name, by_name, out))


def review_type(name: Column, rules: tuple = V.REVIEW_TYPE) -> Column:
    """Type of a name for the ontology review; null counts as an empty name."""
    c = F.lower(F.coalesce(name, F.lit("")))
    return reduce(lambda out, r: F.when(_any(c, r[1]), F.lit(r[0])).otherwise(out), reversed(rules), F.lit("Other"))


def labels(kind: Column, hierarchy: dict = V.HIERARCHY) -> Column:
    """The type and its ancestors, each once, nearest first."""
    pairs = [x for k, up in hierarchy.items() for x in (F.lit(k), F.array(*map(F.lit, up)))]
    up = F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(kind), up))


def importance_of(degree: Column) -> Column:
    return F.when(degree >= 30, 5).when(degree >= 20, 4).when(degree >= 10, 3).when(degree >= 5, 2).otherwise(1)


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(30), F.least(F.lit(80), 3 * F.coalesce(degree, F.lit(1))))


def styled(c: Column, styles: dict, at: int) -> Column:
    """Part `at` of the style of a type or relation, or of the default."""
    return mapped(c, {k: v[at] for k, v in styles.items() if k}, F.lit(styles[""][at]))


def _pairs(schema: dict) -> Column:
    keys = [f"{r}\u0001{a}\u0001{b}" for r, ps in schema.items() for a, b in ps]
    return F.array(*map(F.lit, keys or [""]))


def allowed(rel: Column, a: Column, b: Column, schema: dict = V.RELATION_SCHEMA) -> Column:
    """Whether the relation may hold between types a and b; unknown and unrestricted relations may."""
    bound = [r for r, ps in schema.items() if ps]
    fits = F.array_contains(_pairs(schema), F.concat_ws("\u0001", rel, a, b))
    return ~F.coalesce(rel.isin(*bound), F.lit(False)) | F.coalesce(fits, F.lit(False))


def review(triples: DataFrame, schema: dict = V.RELATION_SCHEMA, reversible: tuple[str, ...] = V.REVERSIBLE) -> DataFrame:
    """Triples (node_1, node_1_type, relationship, node_2, node_2_type, weight) with action: keep, auto_reverse where only the other direction
    is allowed for a relation that may be turned, else type_mismatch; new_node_1, new_node_2 and their types have the turned direction."""
    r, a, b = F.col("relationship"), F.col("node_1_type"), F.col("node_2_type")
    turn = F.coalesce(r.isin(*reversible), F.lit(False)) & allowed(r, b, a, schema)
    action = F.when(allowed(r, a, b, schema), "keep").when(turn, "auto_reverse").otherwise("type_mismatch")
    out = triples.withColumn("action", action)
    turned = F.col("action") == "auto_reverse"
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return out.select("*", pick("node_1", "node_2").alias("new_node_1"), pick("node_1_type", "node_2_type").alias("new_node_1_type"), pick("node_2", "node_1").alias("new_node_2"), pick("node_2_type", "node_1_type").alias("new_node_2_type"))


def cleaned(reviewed: DataFrame) -> DataFrame:
    """The triples after review; mismatches stay."""
    return reviewed.select(F.col("new_node_1").alias("node_1"), "relationship", F.col("new_node_2").alias("node_2"), "weight")


def issues(reviewed: DataFrame) -> DataFrame:
    return reviewed.where("action <> 'keep'")


def alias_table(spark, categories: dict[str, list[str]]) -> DataFrame:
    """alias (lower case), category, canonical (the first alias of the category), ord; the alias of a later category replaces an earlier one."""
    rows: dict[str, tuple] = {}
    for i, (cat, names) in enumerate(categories.items()):
        for n in names:
            rows[n.strip().lower()] = (n.strip().lower(), cat, names[0], i)
    return spark.createDataFrame(list(rows.values()), "alias string, category string, canonical string, ord int")


def tree_paths(tree: dict) -> dict[str, list[str]]:
    """Path from the root to each type of a nested dictionary of types."""
    out: dict[str, list[str]] = {}
    todo = [(tree, [])]
    while todo:
        node, path = todo.pop()
        for name, below in node.items():
            out[name] = [*path, name]
            if isinstance(below, dict):
                todo.append((below, out[name]))
    return out


def config_problems(categories: DataFrame, known_types: DataFrame) -> DataFrame:
    """(problem, item) of an alias table (alias, category): alias in several categories, category unknown as a type, type without alias."""
    many = categories.groupBy("alias").agg(F.count_distinct("category").alias("n")).where("n > 1").select(F.lit("alias_in_several_categories").alias("problem"), F.col("alias").alias("item"))
    used = categories.select(F.col("category").alias("item")).distinct()
    types = known_types.select(F.col("type").alias("item")).distinct()
    blank = categories.where("alias is null or trim(alias) = ''").select(F.lit("empty_alias").alias("problem"), F.col("category").alias("item")).distinct()
    return many.unionByName(used.subtract(types).select(F.lit("unknown_category").alias("problem"), "item")).unionByName(types.subtract(used).select(F.lit("unused_type").alias("problem"), "item")).unionByName(blank)
