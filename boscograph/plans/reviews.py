"""Queries for reviewers and exports: linked entities, listings, sorted relations, distributions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.functions import cleaning as X
from boscograph.functions import vocabulary as V
from boscograph.operators import feedback, graph, relations, resolve
from boscograph.plans import lens
from boscograph.plans.graphs import SQL as GRAPHS
from boscograph.plans.graphs import kg_clustering
from boscograph.sources.tables import table


def _standard(s, d):
    zh = table(s, d, "ref_terms").where("term is not null and term_zh is not null").select(F.lower("term_zh").alias("name"), F.lower("term").alias("standard"))
    return zh.groupBy("name").agg(F.min("standard").alias("standard"))


def _entities(s, d):
    return lens.concepts(s, d).select(F.col("ord").alias("id"), F.col("entity").alias("name"), F.coalesce("category", F.lit("other")).alias("type"))


def _links(s, d):
    return lens.edges(s, d).select(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), F.lit(1).alias("ord"))


def kg_link_relations(s, d):
    return resolve.link_entities(_entities(s, d), _links(s, d), _standard(s, d))[1].select("head", "relation", "tail")


def kg_link_flow(s, d):
    kb = table(s, d, "ref_terms").select(F.lower("term").alias("name"), F.format_string("T%06d", "term_id").alias("id"))
    return resolve.link_flow(_entities(s, d), _links(s, d), _standard(s, d), kb=kb)[0].select("name", "type", "importance", "kb_id")


def kg_concept_lists(s, d):
    c = lens.concepts(s, d).where("chunk_id is not null")
    return c.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "ord", "entity"))), lambda x: x.entity), "; ").alias("entities"))


def kg_ui_filter(s, d):
    """Concepts of some categories with an importance in a range, or none stated."""
    c = table(s, d, "concepts").where(lens.category(F.col("category")).isin("host", "vector"))
    return c.where("importance between 3 and 4 or importance is null or importance = 0").select("concept_id", "importance")


def kg_weight_total(s, d):
    e = lens.edges(s, d)
    return e.agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean"), F.min("weight").alias("min"), F.max("weight").alias("max"), F.round(F.percentile("weight", F.lit(0.5)), 4).alias("median"))


def kg_pair_strength_both(s, d):
    """As reports list it: both ends of every relation come first once."""
    both = graph.both_ways(lens.edges(s, d), "rel_type").where("name <> other")
    return both.groupBy("name", "other", "rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name", "other", "rel_type").limit(20)


def kg_distribution_percent(s, d):
    c, e = lens.concepts(s, d), lens.edges(s, d)
    parts = [(c, "category", F.col("category")), (c, "type", F.col("type")), (c, "importance", F.col("importance").cast("string")), (e, "source", F.col("source"))]
    each = [x.groupBy(F.lit(k).alias("what"), F.coalesce(v, F.lit("")).alias("value")).agg(F.count("*").alias("n")) for x, k, v in parts]
    n = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return n.select("*", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("what")), 1).alias("percent"))  # a few rows


def kg_review_export(s, d):
    """Relations worth a reviewer's look, by type and from the heaviest down."""
    e = lens.edges(s, d).where("weight >= 0.5 or weight < 0.2")
    e = e.groupBy("rel_type", "src", "dst", F.when(F.col("weight") >= 0.5, "high").otherwise("low").alias("band")).agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    return e.orderBy("rel_type", F.desc("weight"), "src", "dst", "band")


def kg_clustering_average(s, d):
    return kg_clustering(s, d).agg(F.count("*").alias("nodes"), F.round(F.avg("clustering"), 4).alias("clustering"), F.round(F.avg("degree"), 4).alias("degree"))


def kg_merge_lists(s, d):
    return feedback.merges(feedback.once(table(s, d, "feedback")))


def kg_keep_first(s, d):
    c = lens.concepts(s, d).select("entity", "ord", "importance", "chunk_id")
    return relations.keep_first(c, ["entity"], "ord").select("entity", "ord", "importance")


def kg_query_graph(s, d):
    """The graph that a query's edges make: nodes are their ends, each once."""
    e = lens.edges(s, d).where("weight >= 0.9").select("src", "rel_type", "dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("ends"))


def kg_markdown(s, d):
    own = table(s, d, "documents").where("text is not null").select("doc_id", X.markdown(F.col("text")).alias("m"))
    return own.select("doc_id", F.size(F.split("m", "\n")).alias("n_lines"), F.md5("m").alias("digest"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("kg_") and v.__module__ == __name__}

_M = "m as (select lower(term_zh) as name, min(lower(term)) as standard from ref_terms where term is not null and term_zh is not null group by 1)"
_REL = "l as (select distinct coalesce(x.standard, src) as head, rel_type as relation, coalesce(y.standard, dst) as tail from e left join m x on x.name = src left join m y on y.name = dst)"
_WEIGHT = " ".join(f"when '{k.lower()}' then {v}" for k, v in V.TYPE_WEIGHT.items())

SQL = {
    "kg_link_relations": f"with {lens.E}, {_M}, {_REL} select * from l",
    "kg_link_flow": f"""
        with {lens.E}, {lens.C}, {_M}, {_REL}, k as (select name, count(*) as k from (select head as name from l union all select tail from l) group by name), b as (select lower(term) as name, min(format('T{{:06d}}', term_id)) as kb_id from ref_terms where term is not null group by 1),
             n as (select distinct coalesce(standard, entity) as name, coalesce(category, 'other') as type from c left join m on m.name = c.entity)
        select name, type, coalesce(k, 0) + case type {_WEIGHT} else 1 end as importance, kb_id from n left join k using (name) left join b using (name)""",
    "kg_concept_lists": f"with {lens.C} select chunk_id, string_agg(entity, '; ' order by place nulls first, ord) as entities from c where chunk_id is not null group by chunk_id",
    "kg_ui_filter": f"select concept_id, importance from (select *, {lens.CAT} as cat from concepts) where cat in ('host', 'vector') and (importance between 3 and 4 or importance is null or importance = 0)",
    "kg_weight_total": f"with {lens.E} select count(*) as n, round(avg(weight), 4) as mean, min(weight) as min, max(weight) as max, round(median(weight), 4) as median from e",
    "kg_pair_strength_both": f"with {lens.E}, {lens.ENDS} select name, other, rel_type, count(*) as n from ends where name <> other group by all order by n desc, name, other, rel_type limit 20",
    "kg_distribution_percent": f"""
        with {lens.E}, {lens.C}, n as (select 'category' as what, coalesce(category, '') as value, count(*) as n from c group by all union all select 'type', coalesce(type, ''), count(*) from c group by all
             union all select 'importance', importance::varchar, count(*) from c group by all union all select 'source', coalesce(source, ''), count(*) from e group by all)
        select *, round(100 * n / sum(n) over (partition by what), 1) as percent from n""",
    "kg_review_export": f"with {lens.E} select rel_type, src, dst, case when weight >= 0.5 then 'high' else 'low' end as band, max(weight) as weight, count(*) as n from e where weight >= 0.5 or weight < 0.2 group by all",
    "kg_clustering_average": f"select count(*) as nodes, round(avg(clustering), 4) as clustering, round(avg(degree), 4) as degree from ({GRAPHS['kg_clustering']})",
    "kg_merge_lists": "with f as (select * from feedback where feedback_id is not null qualify row_number() over (partition by feedback_id order by received_at) = 1) select data.entity_1 as entity_1, data.entity_2 as entity_2, data.canonical_name as canonical_name, count(*) as n from f where feedback_type = 'entity_merge' group by all",
    "kg_keep_first": f"with {lens.C} select entity, min(ord) as ord, arg_min(importance, ord) as importance from c group by entity",
    "kg_query_graph": f"with {lens.E}, x as (select distinct src, rel_type, dst from e where weight >= 0.9) select id, count(*) as ends from (select src as id from x union all select dst from x) group by id",
}
