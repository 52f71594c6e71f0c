"""Queries on concepts, relations, ontology and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V
from boscograph.operators import graph, ontology, relations, resolve
from boscograph.plans import lens
from boscograph.sources.tables import table


def _rel(s, d):
    """Relationship rows with folded ends and a total order."""
    e = lens.edges(s, d)
    return e.select(F.col("src").alias("node_1"), F.col("dst").alias("node_2"), "edge", "weight", "chunk_id", "source", "extracted_at", "rel_type")


def _order():
    return F.struct("extracted_at", "chunk_id", "edge", "source", "weight")


def kg_concept_aggregate(s, d):
    return relations.aggregate_concepts(lens.concepts(s, d))


def kg_cooccurrence(s, d):
    c = lens.concepts(s, d)
    pairs = relations.co_occurrences(c.select("entity", "chunk_id", F.struct("place", "ord").alias("ord")))
    return pairs.groupBy("node_1", "node_2", "edge", "source").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def kg_merge_relationships(s, d):
    out = relations.merge_edges(_rel(s, d), _order())
    return out.select("node_1", "node_2", "edge", F.round("weight", 6).alias("weight"), "chunk_id", "source")


def kg_merge_max(s, d):
    return relations.merge_edges_max(_rel(s, d), _order())


def kg_filter_concepts(s, d):
    c = relations.aggregate_concepts(lens.concepts(s, d))
    kept = relations.filter_concepts(c, _rel(s, d), 2, 2)
    return kept.select("entity", "importance", "category")


def kg_restrict_edges(s, d):
    kept = lens.concepts(s, d).where("importance >= 4").select("entity").distinct()
    return relations.restrict_edges(_rel(s, d), kept).groupBy("rel_type").agg(F.count("*").alias("n"))


def kg_self_loops(s, d):
    return _rel(s, d).groupBy((F.col("node_1") == F.col("node_2")).alias("loop"), "source").agg(F.count("*").alias("n"))


def kg_category_standard(s, d):
    c = table(s, d, "concepts")
    return c.groupBy(relations.standard_category(F.trim("category")).alias("category")).agg(F.count("*").alias("n"))


def kg_triples(s, d):
    c = lens.concepts(s, d)
    return relations.triples(_rel(s, d).withColumn("edge", F.col("rel_type")), c).groupBy("node_1_type", "relationship", "node_2_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def kg_infer_type(s, d):
    n = graph.nodes_of(lens.edges(s, d))
    return n.groupBy(ontology.node_type(F.col("name")).alias("type")).agg(F.count("*").alias("n"))


def kg_review_type(s, d):
    n = graph.nodes_of(lens.edges(s, d))
    return n.groupBy(ontology.review_type(F.col("name")).alias("type")).agg(F.count("*").alias("n"))


def kg_label_hierarchy(s, d):
    n = graph.nodes_of(lens.edges(s, d)).select("name", ontology.labels(ontology.node_type(F.col("name"))).alias("l"))
    return n.select(F.explode("l").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def kg_node_style(s, d):
    n = lens.nodes(s, d).select(F.initcap("type").alias("type"), "total_degree")
    return n.groupBy("type", ontology.styled(F.col("type"), V.NODE_STYLE, 0).alias("color"), ontology.node_size(F.col("total_degree")).alias("size")).agg(F.count("*").alias("n"))


def kg_relation_style(s, d):
    r = lens.edges(s, d).groupBy(F.upper("rel_type").alias("rel_type")).agg(F.count("*").alias("n"))
    return r.select("rel_type", ontology.styled(F.col("rel_type"), V.RELATION_STYLE, 1).alias("width"), ontology.styled(F.col("rel_type"), V.RELATION_STYLE, 2).alias("label"), "n")


def _reviewed(s, d):
    t = lens.entity_types(s, d)
    e = lens.edges(s, d)
    a, b = t.select(F.col("entity").alias("src"), F.col("category").alias("node_1_type")), t.select(F.col("entity").alias("dst"), F.col("category").alias("node_2_type"))
    j = e.join(a, "src").join(b, "dst").select(F.col("src").alias("node_1"), "node_1_type", F.col("rel_type").alias("relationship"), F.col("dst").alias("node_2"), "node_2_type", "weight")
    return ontology.review(j, V.TABLE_SCHEMA, V.TABLE_REVERSIBLE)


def kg_ontology_review(s, d):
    return _reviewed(s, d).groupBy("relationship", "node_1_type", "node_2_type", "action").agg(F.count("*").alias("n"))


def kg_ontology_clean(s, d):
    return ontology.cleaned(_reviewed(s, d)).groupBy("node_1", "relationship", "node_2").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


def kg_ontology_issues(s, d):
    i = ontology.issues(_reviewed(s, d))
    return i.groupBy("node_1", "relationship", "node_2", "action", "new_node_1", "new_node_2").agg(F.count("*").alias("n"))


def kg_alias_lookup(s, d):
    terms = table(s, d, "ref_terms")
    alias = terms.select(F.explode(F.array(F.lower("term"), F.lower("term_zh"))).alias("alias"), "category", "term_id").where("alias is not null")
    first = alias.groupBy("alias").agg(F.min_by("category", "term_id").alias("kind"))
    return lens.concepts(s, d).join(first, F.col("entity") == F.col("alias")).groupBy("kind", "category").agg(F.count("*").alias("n"))


def kg_config_problems(s, d):
    terms = table(s, d, "ref_terms").select(F.lower("term").alias("alias"), "category")
    types = lens.concepts(s, d).where("category is not null").select(F.col("category").alias("type")).unionByName(s.createDataFrame([("unused",)], "type string"))
    return ontology.config_problems(terms, types)


def kg_canonicalise(s, d):
    zh = table(s, d, "ref_terms").where("term is not null and term_zh is not null").select(F.lower("term_zh").alias("name"), F.lower("term").alias("canonical"))
    mapping = zh.groupBy("name").agg(F.min("canonical").alias("canonical"))
    e = relations.apply_mapping(_rel(s, d), mapping)
    return e.groupBy("node_1", "node_2").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def kg_canonical_rules(s, d):
    names = s.createDataFrame([(x,) for xs in V.CANONICAL.values() for x in xs] + [(" PWN ",), ("oak",)], "name string").unionByName(table(s, d, "ref_terms").select(F.col("term").alias("name")))
    return names.select("name", resolve.canonical(F.col("name"), {"oak": "Quercus"}).alias("canonical")).where("name <> canonical").distinct()


def kg_jaccard(s, d):
    m = table(s, d, "merge_candidates")
    return m.select("candidate_id", F.round(resolve.jaccard(F.coalesce("entity1", F.lit("")), F.coalesce("entity2", F.lit(""))), 6).alias("jaccard"))


def kg_hybrid(s, d):
    """Dense cosine with the next vector of the same length, and the sparse likeness of both names' letters, mixed."""
    v = table(s, d, "concept_vectors").where("size(vector) = 64").select("vec_id", "entity", "vector")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("entity").alias("e2"), F.col("vector").alias("v2"))
    letters = lambda c: F.map_from_entries(F.transform(F.array_distinct(resolve.tokens(c)), lambda w: F.struct(w, F.lit(1.0))))
    j = v.join(nxt, "vec_id")
    dense, sparse = resolve.cosine(F.col("vector"), F.col("v2")), resolve.sparse_similarity(letters(F.col("entity")), letters(F.col("e2")))
    return j.select("vec_id", F.round(dense, 6).alias("dense"), F.round(sparse, 6).alias("sparse"), F.round(resolve.hybrid(dense, sparse), 6).alias("hybrid"))


def kg_tfidf(s, d):
    return _gram_weights(lens.concepts(s, d).select(F.col("entity").alias("name")).distinct())


def _gram_weights(names):
    return resolve.tfidf(names, "name").groupBy("gram").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def _names(s, d):
    """Every name of the concepts once, with its first row and the category most often given."""
    c = lens.concepts(s, d).groupBy("entity").agg(F.min("ord").alias("ord")).join(lens.entity_types(s, d), "entity", "left")
    return c.select("ord", "entity", relations.standard_category(F.coalesce("category", F.lit("misc"))).alias("category"))


def kg_fuzzy_pairs(s, d):
    p = resolve.similar_pairs(_names(s, d), "ord", "entity", 0.85)
    return p.select("na", "nb", F.round("ratio", 6).alias("ratio"))


def kg_fuzzy_dedup(s, d):
    t = _names(s, d)
    items = t.select(F.col("ord").alias("key"), F.struct(-F.length("entity"), "ord").alias("rank"), "entity")
    pairs = resolve.similar_pairs(t, "ord", "entity", 0.85)
    kept = resolve.greedy_keep(items, pairs.select("a", "b"))
    return kept.groupBy("kept").agg(F.count("*").alias("n"))


def kg_merge_candidates(s, d):
    return resolve.merge_candidates(_names(s, d)).groupBy("rule", "category").agg(F.count("*").alias("n"))


def kg_apply_merges(s, d):
    m = table(s, d, "merge_candidates").where("keep is not null and entity1 is not null and entity2 is not null")
    c = m.select(F.trim("entity1").alias("entity1"), F.trim("entity2").alias("entity2"), F.trim("keep").alias("keep"), "confidence").where("keep = entity1 or keep = entity2")
    return resolve.merge_mapping(c, 0.95)


def kg_merge_review(s, d):
    """Candidates ranked for a reviewer, with the number of relations at either end."""
    m = table(s, d, "merge_candidates").where("entity1 is not null and entity2 is not null")
    deg = relations.degrees(lens.edges(s, d)).select("name", "total_degree")
    a, b = deg.select(F.col("name").alias("k1"), F.col("total_degree").alias("n1")), deg.select(F.col("name").alias("k2"), F.col("total_degree").alias("n2"))
    j = m.join(a, F.lower("entity1") == F.col("k1"), "left").join(b, F.lower("entity2") == F.col("k2"), "left")
    return j.select("candidate_id", F.coalesce("n1", F.lit(0)).alias("relations_1"), F.coalesce("n2", F.lit(0)).alias("relations_2"), (F.coalesce("confidence", F.lit(0.0)) >= 0.95).alias("auto"))


def kg_cluster_dedup(s, d):
    v = table(s, d, "concept_vectors").where("size(vector) = 64")
    return resolve.cluster(v.withColumn("category", F.coalesce(lens.category(F.col("category")), F.lit("other"))), "vec_id", "vector", "category", 0.85)


def kg_cluster_names(s, d):
    v = table(s, d, "concept_vectors").where("size(vector) = 64")
    c = resolve.cluster(v.withColumn("category", F.coalesce(lens.category(F.col("category")), F.lit("other"))), "vec_id", "vector", "category", 0.85)
    m = v.select("vec_id", F.col("entity")).join(c, "vec_id").where("entity is not null").groupBy("entity").agg(F.min("cluster").alias("cluster"))
    one = lens.concepts(s, d).groupBy("entity").agg(F.max("importance").alias("importance"), F.min("ord").alias("ord"))
    return resolve.representatives(m, one)


def kg_entity_link(s, d):
    """First row of each (name, type), numbered in order."""
    c = lens.concepts(s, d).select("entity", F.coalesce("category", F.lit("other")).alias("kind"), "ord")
    first = c.groupBy("entity", "kind").agg(F.min("ord").alias("first_id"))
    return first.groupBy("kind").agg(F.count("*").alias("n"), F.min("first_id").alias("first_id"), F.max("first_id").alias("last_id"))


def kg_link_entities(s, d):
    zh = table(s, d, "ref_terms").where("term is not null and term_zh is not null").select(F.lower("term_zh").alias("name"), F.lower("term").alias("standard"))
    standard = zh.groupBy("name").agg(F.min("standard").alias("standard"))
    c = lens.concepts(s, d).select(F.col("ord").alias("id"), F.col("entity").alias("name"), F.coalesce("category", F.lit("other")).alias("type"))
    e = lens.edges(s, d).select(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), F.lit(1).alias("ord"))
    return resolve.link_entities(c, e, standard)[0]


def kg_seed_clusters(s, d):
    out = resolve.seed_clusters(_names(s, d), "ord", "entity", "category", 0.8)
    return out.where("ord <> seed")


def kg_alias_normalise(s, d):
    names = table(s, d, "ref_terms").select(F.col("term").alias("name"))
    terms = {r.term: (r.term_zh,) for r in table(s, d, "ref_terms").where("term is not null and term_zh is not null").collect()}  # at most MOST_ALIASES of them
    noisy = table(s, d, "concept_vectors").select(F.col("entity").alias("name"))
    return resolve.alias_normalise(names.unionByName(noisy), "name", terms).where("name <> standard")


def kg_entity_importance(s, d):
    label = {"disease": 10, "pathogen": 8, "host": 7, "vector": 7, "symptom": 5, "treatment": 5, "location": 3, "environment": 4}
    n = lens.nodes(s, d)
    score = F.col("total_degree") + relations.mapped(F.col("type"), label, F.lit(1))
    return n.select("name", "type", "total_degree", score.cast("long").alias("score"))


def kg_coreference(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text")
    names = F.array(*(F.lit(x) for x in ("infection", "quarantine", "inspectors", "stumps", "logs")))
    who = resolve.nearest_entity(F.col("text"), "which agrees", names, "none")
    return docs.select("doc_id", who.alias("entity")).where("entity is not null")


QUERIES = {k: v for k, v in globals().items() if k.startswith("kg_")}

_R = f"{lens.E}, r as (select src as node_1, dst as node_2, edge, weight, chunk_id, source, extracted_at, rel_type, row_number() over (order by extracted_at nulls first, chunk_id nulls first, edge nulls first, source nulls first, weight) as o from e)"


def _joined(name: str, sep: str, keys: str = "node_1, node_2") -> str:
    return f"(select {keys}, string_agg({name}, '{sep}' order by o) as {name} from (select {keys}, {name}, min(o) as o from r where {name} is not null group by all) group by {keys})"


def _when(rules, folded) -> str:
    out = []
    for rule in rules:
        c = "lower(name)" if folded or (len(rule) > 2 and rule[3]) else "name"
        any_ = " or ".join(f"trim({c}) = '{w[1:]}'" if w[0] == "=" else f"contains({c}, '{w}')" for w in rule[1])
        none = "".join(f" and not contains(name, '{w}')" for w in (rule[2] if len(rule) > 2 else ()))
        out.append(f"when ({any_}){none} then '{rule[0]}'")
    return " ".join(out)


_TYPE = "case " + " ".join(f"when name = '{k}' then '{v}'" for k, v in V.NODE_TYPE_BY_NAME.items()) + " " + _when(V.NODE_TYPE, False) + " else 'Other' end"
_RTYPE = "case " + _when(V.REVIEW_TYPE, True) + " else 'Other' end"
_UP = " union all ".join(f"select '{k}' as type, '{x}' as label" for k, up in V.HIERARCHY.items() for x in (k, *up))
_STD = "case " + " ".join(f"when x in ('{k}', '{v}') then '{v}'" for k, v in V.CATEGORY.items()) + " else '其他' end"
_SCHEMA = ", ".join(f"('{r}', '{a}', '{b}')" for r, ps in V.TABLE_SCHEMA.items() for a, b in ps)
_REV = ", ".join(f"'{r}'" for r in V.TABLE_REVERSIBLE)
_NODES = f"{lens.E}, nn as (select src as name from e union select dst from e)"
_REVIEW = f"""{lens.E}, {lens.C}, {lens.T}, s(rel, a, b) as (values {_SCHEMA}),
    j as (select src as node_1, x.category as node_1_type, rel_type as relationship, dst as node_2, y.category as node_2_type, weight from e join t x on x.entity = src join t y on y.entity = dst),
    v as (select *, case when relationship not in (select rel from s) or (relationship, node_1_type, node_2_type) in (select (rel, a, b) from s) then 'keep'
                         when relationship in ({_REV}) and (relationship, node_2_type, node_1_type) in (select (rel, a, b) from s) then 'auto_reverse' else 'type_mismatch' end as action from j),
    z as (select *, case when action = 'auto_reverse' then node_2 else node_1 end as new_node_1, case when action = 'auto_reverse' then node_1 else node_2 end as new_node_2 from v)"""
_REVIEW = _REVIEW.replace("(relationship, node_1_type, node_2_type) in (select (rel, a, b) from s)", "exists (select 1 from s where rel = relationship and a = node_1_type and b = node_2_type)").replace("(relationship, node_2_type, node_1_type) in (select (rel, a, b) from s)", "exists (select 1 from s where rel = relationship and a = node_2_type and b = node_1_type)")
_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower(trim(coalesce({c}, ''), ' ')), '\\s+'), lambda w: w <> ''))"

SQL = {
    "kg_concept_aggregate": f"""
        with {lens.C}, k as (select entity, string_agg(chunk_id, ',' order by o) as chunk_id from (select entity, chunk_id, min(ord) as o from c where chunk_id is not null group by all) group by entity),
             {lens.T}, g as (select entity, max(importance) as importance, arg_min(type, ord) as type from c group by entity)
        select g.entity, importance, category, coalesce(chunk_id, '') as chunk_id, type from g left join t using (entity) left join k using (entity)""",
    "kg_cooccurrence": f"""
        with {lens.C} select a.entity as node_1, b.entity as node_2, 'co-occurs in' as edge, 'proximity' as source, count(*) as n, sum(0.5::double) as weight
        from c a join c b on a.chunk_id = b.chunk_id and (a.place, a.ord) < (b.place, b.ord) and a.entity <> b.entity group by all""",
    "kg_merge_relationships": f"""
        with {_R}, w as (select node_1, node_2, sum(weight) as weight from r group by all)
        select node_1, node_2, edge, round(weight / (select max(weight) from w), 6) as weight, chunk_id, source from w left join {_joined("edge", " | ")} using (node_1, node_2)
        left join {_joined("chunk_id", ",")} using (node_1, node_2) left join {_joined("source", ",")} using (node_1, node_2)""",
    "kg_merge_max": f"""
        with {_R}, s as (select node_1, node_2, edge, string_agg(x, ',' order by x) as source from (select distinct node_1, node_2, edge, unnest(string_split(source, ',')) as x from r where edge is not null) group by all)
        select node_1, node_2, edge, max(weight) as weight, coalesce(any_value(s.source), '') as source, arg_min(chunk_id, o) filter (where chunk_id is not null) as chunk_id from r left join s using (node_1, node_2, edge) where edge is not null group by node_1, node_2, edge""",
    "kg_filter_concepts": f"""
        with {lens.E}, {lens.C}, {lens.T}, g as (select entity, max(importance) as importance from c group by entity),
             k as (select name, count(*) as n from (select src as name from e union all select dst from e where dst <> src) group by name)
        select entity, importance, category from g left join t using (entity) join k on k.name = entity where importance >= 2 and n >= 2 and lower(entity) not in ({", ".join(f"'{x}'" for x in V.GENERIC)})""",
    "kg_restrict_edges": f"with {lens.E}, {lens.C}, k as (select distinct entity from c where importance >= 4) select rel_type, count(*) as n from e where src in (select entity from k) and dst in (select entity from k) group by all",
    "kg_self_loops": f"with {lens.E} select src = dst as loop, source, count(*) as n from e group by all",
    "kg_category_standard": f"select {_STD} as category, count(*) as n from (select lower(trim(category, ' ')) as x from concepts) group by 1",
    "kg_triples": f"""
        with {lens.E}, {lens.C}, k as (select entity, category from c qualify row_number() over (partition by entity order by ord) = 1)
        select a.category as node_1_type, rel_type as relationship, b.category as node_2_type, count(*) as n, round(avg(weight), 6) as mean_weight from e join k a on a.entity = src join k b on b.entity = dst group by all""",
    "kg_infer_type": f"with {_NODES} select {_TYPE} as type, count(*) as n from nn group by 1",
    "kg_review_type": f"with {_NODES} select {_RTYPE} as type, count(*) as n from nn group by 1",
    "kg_label_hierarchy": f"with {_NODES}, y as (select {_TYPE} as type from nn), u as ({_UP}) select label, count(*) as n from y join u using (type) group by 1",
    "kg_node_style": f"""
        with {lens.NODES}, s as (select upper(type[1]) || lower(type[2:]) as type, total_degree from n)
        select type, case type {" ".join(f"when '{k}' then '{v[0]}'" for k, v in V.NODE_STYLE.items() if k)} else '{V.NODE_STYLE[""][0]}' end as color, greatest(30, least(80, 3 * total_degree)) as size, count(*) as n from s group by all""",
    "kg_relation_style": f"""
        with {lens.E} select upper(rel_type) as rel_type, case upper(rel_type) {" ".join(f"when '{k}' then {v[1]}" for k, v in V.RELATION_STYLE.items() if k)} else 1 end as width,
            case upper(rel_type) {" ".join(f"when '{k}' then '{v[2]}'" for k, v in V.RELATION_STYLE.items() if k)} else '相关' end as label, count(*) as n from e group by all""",
    "kg_ontology_review": f"with {_REVIEW} select relationship, node_1_type, node_2_type, action, count(*) as n from z group by all",
    "kg_ontology_clean": f"with {_REVIEW} select new_node_1 as node_1, relationship, new_node_2 as node_2, count(*) as n, max(weight) as weight from z group by all",
    "kg_ontology_issues": f"with {_REVIEW} select node_1, relationship, node_2, action, new_node_1, new_node_2, count(*) as n from z where action <> 'keep' group by all",
    "kg_alias_lookup": f"""
        with {lens.C}, a as (select alias, arg_min(category, term_id) as kind from (select lower(term) as alias, category, term_id from ref_terms union all select lower(term_zh), category, term_id from ref_terms) where alias is not null group by alias)
        select kind, category, count(*) as n from c join a on a.alias = c.entity group by all""",
    "kg_config_problems": f"""
        with {lens.C}, y as (select distinct category as type from c where category is not null union select 'unused'), a as (select lower(term) as alias, category from ref_terms)
        select 'alias_in_several_categories' as problem, alias as item from a group by alias having count(distinct category) > 1
        union all select distinct 'unknown_category', category from a where category not in (select type from y) union all select 'unused_type', type from y where type not in (select category from a)
        union all select distinct 'empty_alias', category from a where alias is null or trim(alias) = ''""",
    "kg_canonicalise": f"""
        with {lens.E}, m as (select lower(term_zh) as name, min(lower(term)) as canonical from ref_terms where term is not null and term_zh is not null group by 1),
             x as (select coalesce(a.canonical, src) as node_1, coalesce(b.canonical, dst) as node_2, weight from e left join m a on a.name = src left join m b on b.name = dst)
        select node_1, node_2, count(*) as n, round(sum(weight), 6) as weight from x where node_1 <> node_2 group by all""",
    "kg_jaccard": f"""
        with x as (select candidate_id, {_WORDS("entity1")} as a, {_WORDS("entity2")} as b from merge_candidates)
        select candidate_id, case when len(a) = 0 or len(b) = 0 then 0.0::double else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end as jaccard from x""",
    "kg_hybrid": f"""
        with v as (select vec_id, entity, vector::double[] as v from concept_vectors where len(vector) = 64),
             j as (select a.vec_id, a.v as x, b.v as y, {_WORDS("a.entity")} as p, {_WORDS("b.entity")} as q from v a join v b on b.vec_id = a.vec_id + 1),
             k as (select vec_id, case when list_dot_product(x, x) * list_dot_product(y, y) > 0 then list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) else 0 end as dense,
                          case when len(p) * len(q) > 0 then len(list_intersect(p, q)) / sqrt(len(p) * len(q)) else 0 end as sparse from j)
        select vec_id, round(dense, 6) as dense, round(sparse, 6) as sparse, round(0.7 * dense + 0.3 * sparse, 6) as hybrid from k""",
    "kg_tfidf": f"""
        with {lens.C}, t as (select distinct entity as name from c), u as (select name, regexp_replace(name, '\\s+', ' ', 'g') as x from t),
             g as (select name, substr(x, i, 2) as gram from (select name, x, unnest(range(1, length(x))) as i from u) union all select name, substr(x, i, 3) from (select name, x, unnest(range(1, length(x) - 1)) as i from u)),
             f as (select name, gram, count(*) as tf from g group by all), p as (select gram, sum(tf) as n, count(*) as df from f group by gram order by n desc, gram limit 100),
             w as (select name, gram, tf * (ln((1 + (select count(*) from t)) / (1 + df)) + 1) as w from f join p using (gram)), z as (select name, sqrt(sum(w * w)) as z from w group by name)
        select gram, count(*) as n, round(sum(w / z), 6) as weight from w join z using (name) group by gram""",
    "kg_merge_review": f"""
        with {lens.E}, k as (select name, count(*) as n from (select src as name from e union all select dst from e) group by name)
        select candidate_id, coalesce(a.n, 0) as relations_1, coalesce(b.n, 0) as relations_2, coalesce(confidence, 0) >= 0.95 as auto from merge_candidates m left join k a on a.name = lower(entity1) left join k b on b.name = lower(entity2) where entity1 is not null and entity2 is not null""",
    "kg_entity_link": f"with {lens.C}, x as (select entity, coalesce(category, 'other') as kind, min(ord) as first_id from c group by all) select kind, count(*) as n, min(first_id) as first_id, max(first_id) as last_id from x group by kind",
    "kg_link_entities": f"""
        with {lens.C}, m as (select lower(term_zh) as name, min(lower(term)) as standard from ref_terms where term is not null and term_zh is not null group by 1),
             x as (select coalesce(standard, entity) as name, coalesce(category, 'other') as type, min(ord) as f from c left join m on m.name = c.entity group by all)
        select row_number() over (order by f, type) as id, name, type from x""",
    "kg_entity_importance": f"""
        with {lens.NODES} select name, type, total_degree, total_degree + case type when 'disease' then 10 when 'pathogen' then 8 when 'host' then 7 when 'vector' then 7 when 'symptom' then 5 when 'treatment' then 5 when 'location' then 3 when 'environment' then 4 else 1 end as score from n""",
    "kg_coreference": """
        with a as (select doc_id, text, strpos(text, 'which agrees') as p from documents where text is not null), b as (select doc_id, substr(text, greatest(p - 1 - 200, 0) + 1, p - 1 - greatest(p - 1 - 200, 0)) as t from a where p > 0),
             n(w, i) as (values ('infection', 0), ('quarantine', 1), ('inspectors', 2), ('stumps', 3), ('logs', 4)),
             h as (select doc_id, w, i, length(t) - length(w) - strpos(reverse(t), reverse(w)) + 1 as place from b, n where contains(t, w))
        select b.doc_id, coalesce((select w from h where h.doc_id = b.doc_id order by place desc, i limit 1), 'none') as entity from b""",
}
