"""The test tables as concepts, edges and nodes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V
from boscograph.functions.text import fold, strip
from boscograph.operators import ontology, relations
from boscograph.sources.tables import table

ZH = {v: k for k, v in V.CATEGORY.items() if k != "misc"}


def category(c: Column) -> Column:
    """English lower-case name of a category; null where it says misc, other or nothing."""
    own = fold(strip(c))
    own = relations.mapped(own, ZH, own)
    return F.when(~own.isin("", "misc", "其他"), own)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "relationships")
    e = r.select(fold(F.col("node_1")).alias("src"), fold(F.col("node_2")).alias("dst"), F.coalesce(F.lower(F.trim("relationship")), F.lit("related_to")).alias("rel_type"), F.coalesce("weight", F.lit(0.8)).alias("weight"), "chunk_id", "source", "edge", "extracted_at")
    return e.where("src <> '' and dst <> ''")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "concepts")
    return c.select("concept_id", fold(F.col("entity")).alias("entity"), relations.clamp_importance(F.col("importance").cast("string")).alias("importance"), category(F.col("category")).alias("category"), "chunk_id", "type", F.col("ord").alias("place"), F.col("concept_id").alias("ord")).where("entity <> ''")


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, category: the category most often given, the smallest of ties."""
    c = concepts(spark, sf_dir).where("category is not null")
    return c.groupBy("entity", "category").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relations.degrees(edges(spark, sf_dir))
    t = entity_types(spark, sf_dir).select(F.col("entity").alias("name"), "category")
    return d.join(t, "name", "left").select("name", F.coalesce("category", F.lit("Other")).alias("type"), "out_degree", "in_degree", "total_degree", "incident_edges", ontology.importance_of(F.col("total_degree")).alias("importance"))


def f(c: str) -> str:
    return f"lower(regexp_replace(trim({c}, ' '), ' +', ' ', 'g'))"


_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in ZH.items())
CAT = f"(select case when x in ('', 'misc', '其他') then null else case x {_CASE} else x end end from (select {f('category')} as x))"

E = f"""e as (select * from (select {f("node_1")} as src, {f("node_2")} as dst, coalesce(lower(trim(relationship, ' ')), 'related_to') as rel_type, coalesce(weight, 0.8) as weight, chunk_id, source, edge, extracted_at from relationships) where src <> '' and dst <> '')"""
C = f"""c as (select * from (select concept_id, {f("entity")} as entity, greatest(1, least(5, coalesce(importance, 3)))::int as importance,
        case when x in ('', 'misc', '其他') then null else case x {_CASE} else x end end as category, chunk_id, type, ord as place, concept_id as ord from (select *, {f("category")} as x from concepts)) where entity <> '')"""
T = "t as (select entity, category from (select entity, category, count(*) as n from c where category is not null group by all) qualify row_number() over (partition by entity order by n desc, category) = 1)"
ENDS = "ends as (select src as name, dst as other, rel_type, weight from e union all select dst, src, rel_type, weight from e)"
PAIRS = "pairs as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n, sum(weight) as w from e where src <> dst group by all)"
N = """d as (select name, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, sum(u)::bigint as incident_edges from (
            select src as name, 1 as o, 0 as i, 1 as u from e union all select dst, 0, 1, case when src = dst then 0 else 1 end from e) group by name),
       n as (select name, coalesce(category, 'Other') as type, out_degree, in_degree, out_degree + in_degree as total_degree, incident_edges,
            case when out_degree + in_degree >= 30 then 5 when out_degree + in_degree >= 20 then 4 when out_degree + in_degree >= 10 then 3 when out_degree + in_degree >= 5 then 2 else 1 end as importance
            from d left join t on t.entity = d.name)"""
NODES = f"{E}, {C}, {T}, {N}"
