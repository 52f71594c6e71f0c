import json

import pytest
from pyspark.sql import functions as F

from boscograph.config import Config
from boscograph.plans import pipeline
from boscograph.plans.service import GraphService


def test_build(spark):
    def answer(text):
        if "broken" in text:
            raise RuntimeError
        names = [n for n in ("松材线虫", "pine wood nematode", "masson pine", "masson pines", "factor") if n in text]
        return json.dumps({"concepts": [{"entity": n, "importance": 4, "category": "host" if "masson" in n else "pathogen"} for n in names], "relationships": [{"node_1": names[0], "node_2": names[-1], "edge": "infects"}] if len(names) > 1 else []})

    docs = spark.createDataFrame([("d1", "松材线虫 and masson pine grow here, " * 3), ("d2", "pine wood nematode, masson pines and factor, " * 3), ("d3", "broken " * 20), ("d4", "short"), ("d5", None)], "doc_id string, text string")
    config = Config({"chunk": {"least": 20}})
    chunks = pipeline.chunks_of(docs, config)
    assert {r.chunk_id for r in chunks.collect()} == {"d1_0", "d2_0", "d3_0"}
    answers = pipeline.answers_of(chunks, answer)
    g = pipeline.build(answers, config)
    names = {r.entity: r.category for r in g.concepts.collect()}
    assert names == {"bursaphelenchus xylophilus": "病原", "pinus massoniana": "寄主"} or set(names) >= {"bursaphelenchus xylophilus"}
    assert "factor" not in names
    top = g.relationships.orderBy(F.desc("weight")).first()
    assert top.weight == 1.0
    assert pipeline.answers_of(chunks, answer, answers.select("chunk_id")).count() == 0
    empty = pipeline.build(answers.limit(0), config)
    assert empty.concepts.collect() == [] and empty.relationships.collect() == []


def test_property_graph_and_service(spark):
    t = spark.createDataFrame([("松材线虫", "INFECTS", "马尾松", 0.9), ("松褐天牛", "CARRIES", "松材线虫", 0.9), ("松褐天牛", "FEEDS_ON", "马尾松", 0.8), ("x", "odd", "y", 0.1)], "node_1 string, relationship string, node_2 string, weight double")
    nodes, edges = pipeline.property_graph(t)
    one = nodes.where("name = '松褐天牛'").first()
    assert (one.type, one.all_labels[:2], one.out_degree, one.importance) == ("Vector", ["Vector", "Insect"], 2, 1)
    assert {(r.rel_type, r.width) for r in edges.collect()} == {("INFECTS", 3), ("CARRIES", 2), ("FEEDS_ON", 2), ("odd", 1)}
    s = GraphService(nodes, edges)
    top, inside = s.page(10, exclude_other=True)
    assert top.count() == 3 and inside.count() == 3 and s.page(10, relation_type="CARRIES")[1].count() == 1
    assert [r.name for r in s.path("x", "y").orderBy("step").collect()] == ["x", "y"]
    found, on = s.subgraph("松材线虫", 1)
    assert found.count() == 3 and on.count() == 2
    assert s.search("松").count() == 3 and s.suggest("松", 1).first().name == "马尾松"
    assert s.node("nobody")[0].count() == 0 and s.node("松材线虫")[1].count() == 2
    for bad in (lambda: s.page(0), lambda: s.path("a", "b", 11), lambda: s.subgraph("a", 4), lambda: s.search(""), lambda: s.list_nodes(10, -1)):
        with pytest.raises(ValueError):
            bad()
    concepts = nodes.select(F.col("name").alias("entity"), F.col("type").alias("category"), "importance")
    got = s.community_summary(concepts, "components").collect()
    assert [r["size"] for r in got] == [3, 2]
    with pytest.raises(ValueError):
        pipeline.communities(edges, nodes, "none")
