"""Queries on the graph: statistics, search, neighbourhoods, communities, feedback and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boscograph.operators import centrality, feedback, graph, relations, search
from boscograph.plans import lens
from boscograph.session import checkpoint_dir
from boscograph.sources import store
from boscograph.sources.tables import table
from boscograph.streaming import feeds

SEED = "paroum avivamula"


def kg_top_degree(s, d):
    return graph.ranked(graph.undirected_degree(lens.edges(s, d)), "degree", 20)


def kg_degree_in_out(s, d):
    return lens.nodes(s, d).select("name", "out_degree", "in_degree", "total_degree", "incident_edges", "importance")


def kg_neighbours_least(s, d):
    return graph.undirected_degree(lens.edges(s, d), 3)


def kg_stats(s, d):
    return graph.stats(lens.edges(s, d))


def kg_type_distribution(s, d):
    n = lens.nodes(s, d).groupBy("type").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("type", "n", F.round(100 * F.col("n") / F.col("all"), 2).alias("percent"))  # a one-row total


def kg_edge_distribution(s, d):
    n = lens.edges(s, d).groupBy("rel_type").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("rel_type", "n", F.round(100 * F.col("n") / F.col("all"), 2).alias("percent"))  # a one-row total


def kg_weight_stats(s, d):
    g = lens.edges(s, d).groupBy("rel_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean"), F.min("weight").alias("min"), F.max("weight").alias("max"), F.round(F.stddev_samp("weight"), 4).alias("std"), F.round(F.percentile("weight", F.lit(0.5)), 4).alias("median"))


def kg_weight_bands(s, d):
    e = lens.edges(s, d)
    return e.where("weight >= 0.5 or weight < 0.2").groupBy("rel_type", F.when(F.col("weight") >= 0.5, "high").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


def kg_quality(s, d):
    e = lens.edges(s, d)
    rows = e.groupBy("src", "rel_type", "dst").agg(F.count("*").alias("n"))
    a = rows.agg(F.sum("n").alias("edges"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("self_loops"))
    n = graph.nodes_of(e).agg(F.count("*").alias("nodes"), F.count_if(F.col("name").rlike("[\\x{4e00}-\\x{9fa5}]")).alias("chinese_nodes"))
    lone = lens.concepts(s, d).select(F.col("entity").alias("name")).distinct().join(graph.nodes_of(e), "name", "left_anti").agg(F.count("*").alias("isolated"))
    return a.crossJoin(n).crossJoin(lone)  # three single rows


def kg_node_type_stats(s, d):
    return lens.nodes(s, d).groupBy("type").agg(F.count("*").alias("n"), F.min("total_degree").alias("min_degree"), F.max("total_degree").alias("max_degree"), F.round(F.avg("total_degree"), 4).alias("avg_degree"))


def kg_relation_matrix(s, d):
    t = lens.entity_types(s, d)
    a, b = t.select(F.col("entity").alias("src"), F.col("category").alias("src_type")), t.select(F.col("entity").alias("dst"), F.col("category").alias("dst_type"))
    e = lens.edges(s, d).join(a, "src", "left").join(b, "dst", "left")
    return e.groupBy("rel_type", F.coalesce("src_type", F.lit("Other")).alias("src_type"), F.coalesce("dst_type", F.lit("Other")).alias("dst_type")).agg(F.count("*").alias("n"))


def kg_pair_strength(s, d):
    return lens.edges(s, d).groupBy("src", "dst", "rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst", "rel_type").limit(20)


def kg_distributions(s, d):
    c = lens.concepts(s, d)
    parts = [("category", F.col("category")), ("importance", F.col("importance").cast("string")), ("type", F.col("type"))]
    each = c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.coalesce(v, F.lit("")).alias("value")) for k, v in parts))).alias("x")).select("x.*")
    return each.groupBy("what", "value").agg(F.count("*").alias("n"))


def kg_importance_histogram(s, d):
    have = lens.nodes(s, d).groupBy("importance").agg(F.count("*").alias("n"))
    return s.range(1, 6).select(F.col("id").cast("int").alias("importance")).join(have, "importance", "left").select("importance", F.coalesce("n", F.lit(0)).alias("n"))


def kg_nodes_page(s, d):
    return graph.page(lens.nodes(s, d).where("importance >= 2"), 100, 20).select("name", "type", "total_degree")


def kg_other_last(s, d):
    return graph.page(lens.nodes(s, d), 100).select("name", "type", "total_degree", "importance")


def kg_search(s, d):
    return search.search(lens.nodes(s, d), "LATE", None, 2, 20).select("name", "type", "importance", "total_degree")


def kg_suggest(s, d):
    return search.suggest(lens.nodes(s, d), "rust", 5)


def kg_top_weight(s, d):
    return lens.edges(s, d).where("extracted_at is not null").orderBy(F.desc("weight"), "extracted_at", "src", "dst", "rel_type").limit(10).select("src", "rel_type", "dst", "weight")


def kg_subgraph_page(s, d):
    e = lens.edges(s, d)
    top = graph.page(lens.nodes(s, d).where("type <> 'Other'"), 50).select("name")
    return graph.induced(e, top).where("rel_type <> 'co_occurs'").groupBy("src", "rel_type", "dst").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


def kg_node_detail(s, d):
    mine = graph.both_ways(lens.edges(s, d), "rel_type").where(F.col("name") == SEED)
    return mine.where("other <> name").groupBy("other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "other").limit(20)


def kg_incident(s, d):
    mine = graph.both_ways(lens.edges(s, d), "rel_type", "weight").where(F.col("name") == SEED)
    return mine.groupBy("name", "rel_type", "other").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).orderBy(F.desc("weight"), F.desc("n"), "rel_type", "other").limit(50)


def kg_edges_of_type(s, d):
    e = lens.edges(s, d).where("rel_type = 'carried_by'")
    t = lens.entity_types(s, d)
    return e.join(t.withColumnRenamed("entity", "src").withColumnRenamed("category", "src_type"), "src").groupBy("src", "src_type", "dst").agg(F.count("*").alias("n"))


def kg_triple_sample(s, d):
    return lens.edges(s, d).select("src", "rel_type", "dst").distinct().orderBy("src", "rel_type", "dst").limit(100)


def _seeds(s):
    return s.createDataFrame([(SEED,)], "name string")


def _neighborhood(s, e):
    _, on = graph.neighbourhood(e, _seeds(s), 2)
    return on.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _expand_induced(s, d, e):
    found = graph.reachable(e, _seeds(s), 1)
    return graph.induced(lens.edges(s, d), found).groupBy("rel_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))


def kg_khop(s, d):
    return graph.reachable(lens.edges(s, d), _seeds(s), 2)


def kg_neighborhood(s, d):
    return _neighborhood(s, lens.edges(s, d))


def kg_expand_induced(s, d):
    return _expand_induced(s, d, lens.edges(s, d))


def kg_shortest_path(s, d):
    return graph.shortest_path(lens.edges(s, d), SEED, "scarlet needle scorch", 5)


def kg_two_hop(s, d):
    e = lens.edges(s, d)
    a = e.where("rel_type = 'carried_by'").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    b = e.where("rel_type = 'feeds_on'").select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    return a.join(b, "b").where("a <> c").groupBy("a", "c").agg(F.count("*").alias("n_ways"))


def _whole(s, d):
    return graph.simple_pairs(lens.edges(s, d)).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))


def _component_sizes(s, d, e):
    names = lens.concepts(s, d).select(F.col("entity").alias("name")).distinct()
    return graph.components(e, names).groupBy("component").agg(F.count("*").alias("n"))


def _component_modularity(e):
    return graph.modularity(e, graph.components(e, graph.nodes_of(e)).withColumnRenamed("component", "community")).select(F.round("modularity", 6).alias("modularity"))


def _component_summaries(s, d, e):
    labels = graph.components(e, graph.nodes_of(e)).withColumnRenamed("component", "community")
    t = lens.entity_types(s, d)
    c = lens.concepts(s, d).groupBy("entity").agg(F.max("importance").alias("importance")).join(t, "entity", "left")
    return search.community_summaries(labels, c)


def _themes(e):
    """Membership of nodes in communities, as edges to the theme of each."""
    labels = graph.components(e, graph.nodes_of(e))
    return labels.select("name", F.lit("BELONGS_TO").alias("rel_type"), F.concat(F.lit("theme: "), "component").alias("theme"))


def _clustering(e):
    return graph.clustering(e).select("name", "degree", "triangles", F.round("clustering", 6).alias("clustering"))


def _degree_centrality(e):
    return centrality.degree_centrality(e).select("name", F.round("degree_centrality", 6).alias("degree_centrality"))


def kg_components(s, d):
    return _component_sizes(s, d, _whole(s, d))


def kg_label_propagation(s, d):
    e = _whole(s, d)
    return graph.label_propagation(e, graph.nodes_of(e)).groupBy("community").agg(F.count("*").alias("n"))


def kg_louvain(s, d):
    e = _whole(s, d)
    return graph.louvain(e, graph.nodes_of(e))


def kg_modularity(s, d):
    return _component_modularity(_whole(s, d))


def kg_community_summary(s, d):
    return _component_summaries(s, d, _whole(s, d))


def kg_themes(s, d):
    return _themes(_whole(s, d))


def kg_clustering(s, d):
    return _clustering(_whole(s, d))


def kg_centrality_degree(s, d):
    return _degree_centrality(_whole(s, d))


def kg_centrality_eigen(s, d):
    return centrality.eigenvector(_whole(s, d))


def kg_centrality_paths(s, d):
    return centrality.paths_centrality(_whole(s, d))


def kg_export_sorted(s, d):
    t = lens.entity_types(s, d)
    e = lens.edges(s, d).groupBy("src", "rel_type", "dst").agg(F.count("*").alias("n"))
    j = e.join(t.select(F.col("entity").alias("src"), F.col("category").alias("src_type")), "src", "left").join(t.select(F.col("entity").alias("dst"), F.col("category").alias("dst_type")), "dst", "left")
    return j.select("src", F.coalesce("src_type", F.lit("Other")).alias("src_type"), "rel_type", "dst", F.coalesce("dst_type", F.lit("Other")).alias("dst_type"), "n").orderBy("src", "rel_type", "dst")


def kg_bulk_relations(s, d):
    c = lens.concepts(s, d).select(F.col("entity").alias("name"), F.col("concept_id").alias("id"), F.coalesce("category", F.lit("Other")).alias("type"), "ord")
    e = lens.edges(s, d).select(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), F.col("weight").alias("confidence"))
    _, rel = store.bulk_files(c, e)
    return rel.groupBy("head_id", "relation", "tail_id").agg(F.count("*").alias("n"))


def kg_vector_topk(s, d):
    v = table(s, d, "concept_vectors").where("size(vector) = 64")
    q = F.array(*(F.lit(float((i * 7) % 11 - 5)) for i in range(64)))
    return search.nearest(v, "vec_id", "vector", q, 10)


def kg_local_search(s, d):
    v = table(s, d, "concept_vectors").where("size(vector) = 64")
    q = F.array(*(F.lit(float((i * 7) % 11 - 5)) for i in range(64)))
    found, inside = search.local_search(v, "vec_id", "entity", "vector", q, lens.edges(s, d), 20, 1)
    return found.select("name", "dist")


def _search_context(s, e):
    found = graph.reachable(e, _seeds(s), 1)
    inside = graph.induced(e, found).groupBy("src", "rel_type", "dst").agg(F.max("weight").alias("weight"))
    return search.context_lines(found, inside)


def kg_search_context(s, d):
    return _search_context(s, lens.edges(s, d))


def kg_feedback_report(s, d):
    return feedback.report(feedback.once(table(s, d, "feedback")))


def kg_feedback_patterns(s, d):
    return feedback.patterns(feedback.once(table(s, d, "feedback")))


def kg_feedback_training(s, d):
    return feedback.training_pairs(feedback.once(table(s, d, "feedback")))


def kg_feedback_recent(s, d):
    return feedback.recent(feedback.once(table(s, d, "feedback")), 10).select("feedback_id", "feedback_type", "timestamp")


def _stream(s, d, what, name):
    """Runs a streaming query over the table's file to a table in the shared folder."""
    at = f"{checkpoint_dir(s)}/stream-{uuid.uuid4()}"
    src = feeds.files(s, f"{d}/{name}.parquet", table(s, d, name).schema)
    feeds.run_to_table(what(src), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out")


def kg_stream_feedback(s, d):
    out = _stream(s, d, lambda x: feeds.once_by_id(x, late="3650 days").select("feedback_id", "feedback_type"), "feedback")
    return out.groupBy("feedback_type").agg(F.count("*").alias("n"))


def kg_stream_windows(s, d):
    out = _stream(s, d, lambda x: feeds.windowed_counts(x.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "events")
    return out.select(F.date_format("from", "yyyy-MM-dd").alias("day"), "event_type", "n")


def kg_daily_feedback(s, d):
    f = feedback.once(table(s, d, "feedback")).where("received_at is not null")
    return f.groupBy(F.to_date("received_at").cast("string").alias("day"), "feedback_type").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("kg_")}

_E, _N = lens.E, lens.NODES
_SIMPLE = f"{_E}, {lens.PAIRS}, st as (select a as src, b as dst, w as weight from pairs)"
_BOTH = "bo as (select src as name, dst as other from st union all select dst, src from st)"
_F = "f as (select * from feedback where feedback_id is not null qualify row_number() over (partition by feedback_id order by received_at) = 1)"
_WALK = "recursive {E}, x as (select src as a, dst as b from e where src <> dst union select dst, src from e where src <> dst), w(name, dist) as (select '{S}', 0 union select b, dist + 1 from w join x on a = name where dist < {H})"
_COMP = _SIMPLE + ", " + _BOTH + ", c0 as (select distinct name from bo), cc(name, r) as (select name, name from c0 union select bo.name, cc.r from cc join bo on bo.other = cc.name), comp as (select name, min(r) as component from cc group by name)"
_Q = "[" + ", ".join(f"{float((i * 7) % 11 - 5)}" for i in range(64)) + "]::double[]"


def _walk(hops: int) -> str:
    return "with " + _WALK.format(E=_E, S=SEED, H=hops)


SQL = {
    "kg_top_degree": f"with {_E}, {lens.ENDS} select name, count(*) as degree, count(distinct other) filter (where other <> name) as n_neighbours from ends group by name order by degree desc, name limit 20",
    "kg_degree_in_out": f"with {_N} select name, out_degree, in_degree, total_degree, incident_edges, importance from n",
    "kg_neighbours_least": f"with {_E}, {lens.ENDS} select name, count(*) as degree, count(distinct other) filter (where other <> name) as n_neighbours from ends group by name having count(*) >= 3",
    "kg_stats": f"""
        with {_E}, {lens.ENDS}, {lens.PAIRS}, v as (select (select count(distinct name) from ends) as nodes, (select count(*) from e) as edges, (select count(*) from pairs) as pairs, (select count(distinct rel_type) from e) as edge_types)
        select *, round(edges / (nodes * (nodes - 1)), 4) as density, round(2 * pairs / (nodes * (nodes - 1)), 4) as simple_density, round(2 * edges / nodes, 2) as avg_degree, round(edges / nodes, 2) as edges_per_node from v""",
    "kg_type_distribution": f"with {_N} select type, count(*) as n, round(100 * count(*) / (select count(*) from n), 2) as percent from n group by type",
    "kg_edge_distribution": f"with {_E} select rel_type, count(*) as n, round(100 * count(*) / (select count(*) from e), 2) as percent from e group by rel_type",
    "kg_weight_stats": f"with {_E} select rel_type, count(*) as n, round(avg(weight), 4) as mean, min(weight) as min, max(weight) as max, round(stddev_samp(weight), 4) as std, round(median(weight), 4) as median from e group by rel_type",
    "kg_weight_bands": f"with {_E} select rel_type, case when weight >= 0.5 then 'high' else 'low' end as band, count(*) as n from e where weight >= 0.5 or weight < 0.2 group by all",
    "kg_quality": f"""
        with {_E}, {lens.C}, g as (select src, rel_type, dst, count(*) as n from e group by all), nn as (select src as name from e union select dst from e)
        select (select sum(n)::bigint from g) as edges, (select sum(n - 1)::bigint from g) as duplicates, (select count(*) from e where src = dst) as self_loops, (select count(*) from nn) as nodes,
               (select count(*) from nn where regexp_matches(name, '[\\x{{4e00}}-\\x{{9fa5}}]')) as chinese_nodes, (select count(distinct entity) from c where entity not in (select name from nn)) as isolated""",
    "kg_node_type_stats": f"with {_N} select type, count(*) as n, min(total_degree) as min_degree, max(total_degree) as max_degree, round(avg(total_degree), 4) as avg_degree from n group by type",
    "kg_relation_matrix": f"with {_E}, {lens.C}, {lens.T} select rel_type, coalesce(a.category, 'Other') as src_type, coalesce(b.category, 'Other') as dst_type, count(*) as n from e left join t a on a.entity = src left join t b on b.entity = dst group by all",
    "kg_pair_strength": f"with {_E} select src, dst, rel_type, count(*) as n from e group by all order by n desc, src, dst, rel_type limit 20",
    "kg_distributions": f"with {lens.C} select 'category' as what, coalesce(category, '') as value, count(*) as n from c group by all union all select 'importance', importance::varchar, count(*) from c group by all union all select 'type', coalesce(type, ''), count(*) from c group by all",
    "kg_importance_histogram": f"with {_N} select i::int as importance, (select count(*) from n where n.importance = i) as n from range(1, 6) r(i)",
    "kg_nodes_page": f"with {_N} select name, type, total_degree from n where importance >= 2 order by type = 'Other', total_degree desc, name limit 100 offset 20",
    "kg_other_last": f"with {_N} select name, type, total_degree, importance from n order by type = 'Other', total_degree desc, name limit 100",
    "kg_search": f"with {_N} select name, type, importance, total_degree from n where contains(lower(name), 'late') and importance >= 2 order by total_degree desc, name limit 20",
    "kg_suggest": f"with {_N} select name from n where contains(lower(name), 'rust') order by length(name), name limit 5",
    "kg_top_weight": f"with {_E} select src, rel_type, dst, weight from e where extracted_at is not null order by weight desc, extracted_at, src, dst, rel_type limit 10",
    "kg_subgraph_page": f"""
        with {_N}, p as (select name from n where type <> 'Other' order by total_degree desc, name limit 50)
        select src, rel_type, dst, count(*) as n, max(weight) as weight from e where src in (select name from p) and dst in (select name from p) and rel_type <> 'co_occurs' group by all""",
    "kg_node_detail": f"with {_E}, {lens.ENDS} select other, count(*) as n from ends where name = '{SEED}' and other <> name group by other order by n desc, other limit 20",
    "kg_incident": f"with {_E}, {lens.ENDS} select name, rel_type, other, count(*) as n, max(weight) as weight from ends where name = '{SEED}' group by all order by weight desc, n desc, rel_type, other limit 50",
    "kg_edges_of_type": f"with {_E}, {lens.C}, {lens.T} select src, category as src_type, dst, count(*) as n from e join t on t.entity = src where rel_type = 'carried_by' group by all",
    "kg_triple_sample": f"with {_E} select distinct src, rel_type, dst from e order by src, rel_type, dst limit 100",
    "kg_khop": _walk(2) + " select name, min(dist)::int as dist from w group by name",
    "kg_neighborhood": _walk(2) + ", i as (select name from w group by name having min(dist) < 2) select src, dst, count(*) as n from e where (src in (select name from i) or dst in (select name from i)) group by all",
    "kg_expand_induced": _walk(1) + " select rel_type, count(*) as n, count(distinct src) as n_src from e where src in (select name from w) and dst in (select name from w) group by all",
    "kg_shortest_path": f"""
        with recursive {_E}, x as (select src as a, dst as b from e where src <> dst union select dst, src from e where src <> dst),
             q(name, dist, path) as (select '{SEED}', 0, ['{SEED}'] union all select b, q.dist + 1, list_append(q.path, b) from q join x on a = q.name where q.dist < 3 and not list_contains(q.path, b) and not list_contains(q.path, 'scarlet needle scorch')),
             best as (select path from q where name = 'scarlet needle scorch' order by dist, path limit 1)
        select (i - 1)::int as step, path[i] as name from best, unnest(range(1, len(path) + 1)) u(i)""",
    "kg_two_hop": f"""
        with {_E}, a as (select distinct src as a, dst as b from e where rel_type = 'carried_by'), b as (select distinct src as b, dst as c from e where rel_type = 'feeds_on')
        select a, c, count(*) as n_ways from a join b using (b) where a <> c group by all""",
    "kg_components": f"with recursive {_COMP}, {lens.C}, al as (select name, component from comp union all select distinct entity, entity from c where entity not in (select name from c0)) select component, count(*) as n from al group by component",
    "kg_modularity": f"""
        with recursive {_COMP}, j as (select weight as w, x.component as x, y.component as y from st join comp x on x.name = src join comp y on y.name = dst), m as (select sum(w) as m, sum(w) filter (where x = y) as i from j),
             v as (select sum(w) as v from (select x as c, w from j union all select y, w from j) group by c) select round(i / m - (select sum(v * v) from v) / (4 * m * m), 6) as modularity from m""",
    "kg_community_summary": f"""
        with recursive {_COMP}, {lens.C}, {lens.T}, g as (select entity, max(importance) as importance from c group by entity), m as (select component, name, importance, category from comp join g on g.entity = name left join t on t.entity = name),
             th as (select component, category as theme from (select component, category, count(*) as n from m where category is not null group by all) qualify row_number() over (partition by component order by n desc, category) = 1),
             co as (select component, string_agg(name, ', ' order by importance desc, name) as core from (select * from m qualify row_number() over (partition by component order by importance desc, name) <= 5) group by component),
             z as (select component, count(*) as size from comp group by component)
        select component as community, upper(coalesce(theme, 'mixed')) || ' 相关知识 (' || size || ' 概念)' as title, coalesce(core, '') as core_concepts, coalesce(theme, 'mixed') as theme, size from z left join th using (component) left join co using (component)""",
    "kg_themes": f"with recursive {_COMP} select name, 'BELONGS_TO' as rel_type, 'theme: ' || component as theme from comp",
    "kg_clustering": f"""
        with {_SIMPLE}, {_BOTH}, dg as (select name, count(*) as degree from bo group by name),
             tr as (select x.src as a, x.dst as b, y.dst as c from st x join st y on x.dst = y.src join st z on z.src = x.src and z.dst = y.dst),
             pn as (select name, count(*) as k from (select a as name from tr union all select b from tr union all select c from tr) group by name)
        select name, degree, coalesce(k, 0) as triangles, case when degree > 1 then round(2 * coalesce(k, 0) / (degree * (degree - 1)), 6) else 0 end as clustering from dg left join pn using (name)""",
    "kg_centrality_degree": f"with {_SIMPLE}, {_BOTH}, dg as (select name, count(*) as k from bo group by name) select name, round(k / greatest((select count(*) from dg) - 1, 1), 6) as degree_centrality from dg",
    "kg_export_sorted": f"with {_E}, {lens.C}, {lens.T} select src, coalesce(a.category, 'Other') as src_type, rel_type, dst, coalesce(b.category, 'Other') as dst_type, count(*) as n from e left join t a on a.entity = src left join t b on b.entity = dst group by all order by src, rel_type, dst",
    "kg_bulk_relations": f"with {_E}, {lens.C}, i as (select entity, arg_max(concept_id, ord) as id from c group by entity) select a.id as head_id, rel_type as relation, b.id as tail_id, count(*) as n from e join i a on a.entity = src join i b on b.entity = dst group by all",
    "kg_vector_topk": f"select vec_id, round(case when list_dot_product(vector::double[], vector::double[]) > 0 then list_cosine_similarity(vector::double[], {_Q}) else 0 end, 6) as score from concept_vectors where len(vector) = 64 order by score desc, vec_id limit 10",
    "kg_local_search": f"""
        with {_E}, {lens.ENDS}, k as (select vec_id, entity, round(case when list_dot_product(vector::double[], vector::double[]) > 0 then list_cosine_similarity(vector::double[], {_Q}) else 0 end, 6) as score from concept_vectors where len(vector) = 64 and entity is not null order by score desc, vec_id limit 20),
             s as (select distinct entity as name from k) select name, 0 as dist from s union all select distinct other, 1 from ends join s using (name) where other <> name and other not in (select name from s)""",
    "kg_search_context": _walk(1) + """, f as (select name, min(dist) as dist from w group by name), r as (select src, rel_type, dst, max(weight) as weight from e where src in (select name from f) and dst in (select name from f) group by all),
             l as ((select 0 as part, dist::double as o, '- ' || name as line from f order by dist, name limit 15) union all (select 1, -weight, src || ' -[' || rel_type || ']-> ' || dst from r order by weight desc, src, rel_type, dst limit 20))
        select (row_number() over (order by part, o, line))::int as line_no, line from l""",
    "kg_feedback_report": f"with {_F} select 'total' as part, '' as key, count(*) as n from f union all select 'type', coalesce(feedback_type, ''), count(*) from f group by all union all select 'user', coalesce(user_id, ''), count(*) from f group by all",
    "kg_feedback_patterns": f"""
        with {_F} select 'direction' as kind, data.original.relation_type as pattern, count(*) as n from f where feedback_type = 'relation_direction_error' and data.original.relation_type is not null group by all
        union all select 'type', data.wrong_relation || ' → ' || data.correct_relation, count(*) from f where feedback_type = 'relation_type_error' and data.wrong_relation is not null and data.correct_relation is not null group by all""",
    "kg_feedback_training": f"""
        with {_F}, x as (select feedback_id, feedback_type,
            case feedback_type when 'relation_direction_error' then '关系: ' || data.original.node_1 || ' → ' || data.original.relation_type || ' → ' || data.original.node_2
                 when 'relation_type_error' then '关系: ' || data.node_1 || ' → ' || data.wrong_relation || ' → ' || data.node_2 when 'entity_merge' then '实体: ' || data.entity_1 || ', ' || data.entity_2 end as input,
            case feedback_type when 'relation_direction_error' then '正确方向: ' || data.correction.corrected_node_1 || ' → ' || data.original.relation_type || ' → ' || data.correction.corrected_node_2
                 when 'relation_type_error' then '正确关系: ' || data.node_1 || ' → ' || data.correct_relation || ' → ' || data.node_2 when 'entity_merge' then '应合并为: ' || data.canonical_name end as output from f)
        select * from x where input is not null and output is not null""",
    "kg_feedback_recent": f"""with {_F} select feedback_id, feedback_type, "timestamp" from f order by "timestamp" desc, feedback_id limit 10""",
    "kg_stream_feedback": f"with {_F} select feedback_type, count(*) as n from f group by all",
    "kg_daily_feedback": f"with {_F} select strftime(received_at, '%Y-%m-%d') as day, feedback_type, count(*) as n from f where received_at is not null group by all",
    "kg_stream_windows": """
        with w as (select date_trunc('day', ts) as a, event_type, count(*) as n from events where ts is not null group by all)
        select strftime(a, '%Y-%m-%d') as day, event_type, n from w where a + interval 1 day <= (select max(ts) - interval 1 day from events)""",
}
