import pytest
from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V
from boscograph.operators import extract, ontology, relations, resolve

EDGES = "node_1 string, node_2 string, edge string, weight double, chunk_id string, source string, o int"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def test_merge_edges(spark):
    e = edges(spark, [("a", "b", "y", 0.5, "c2", "llm", 1), ("a", "b", "x", 0.5, "c1", "proximity", 2), ("a", "b", "y", 1.0, None, "llm", 3), ("b", "a", "z", 1.0, "c1", "llm", 4), (None, "a", "q", 9.0, "c", "llm", 5)])
    got = {(r.node_1, r.node_2): (r.edge, r.weight, r.chunk_id, r.source) for r in relations.merge_edges(e, F.col("o")).collect()}
    assert got == {("a", "b"): ("y | x", 1.0, "c2,c1", "llm,proximity"), ("b", "a"): ("z", 0.5, "c1", "llm")}
    assert relations.merge_edges(e.limit(0), F.col("o")).collect() == []
    m = {(r.node_1, r.edge): (r.weight, r.source, r.chunk_id) for r in relations.merge_edges_max(edges(spark, [("a", "b", "y", 0.5, None, "llm,x", 1), ("a", "b", "y", 0.7, "c1", "llm", 2)]), F.col("o")).collect()}
    assert m == {("a", "y"): (0.7, "llm,x", "c1")}


def test_concept_aggregate_and_filters(spark):
    c = spark.createDataFrame([("p", 3, "host", "c2", "concept", 1), ("p", 5, "vector", "c1", None, 2), ("p", 1, "host", "c2", None, 3), ("p", 1, "vector", None, None, 4), ("factor", 5, "misc", "c1", "concept", 5), (None, 5, "x", "c", "t", 6)], "entity string, importance int, category string, chunk_id string, type string, ord long")
    got = {r.entity: (r.importance, r.category, r.chunk_id, r.type) for r in relations.aggregate_concepts(c).collect()}
    assert got == {"p": (5, "host", "c2,c1", "concept"), "factor": (5, "misc", "c1", "concept")}
    e = edges(spark, [("p", "p", "x", 1.0, "c", "s", 1), ("p", "q", "x", 1.0, "c", "s", 2)])
    agg = relations.aggregate_concepts(c)
    assert [r.entity for r in relations.filter_concepts(agg, e, 2, 2).collect()] == ["p"]
    assert relations.filter_concepts(agg, e, 2, 3).collect() == []
    assert [r.entity for r in relations.filter_concepts(agg, e.limit(0), 2, 3).collect()] == ["p"]
    assert relations.restrict_edges(e, agg).count() == 1 and relations.restrict_edges(e, agg.limit(0)).count() == 2


def test_degrees_count_loops(spark):
    e = edges(spark, [("p", "p", "x", 1.0, "c", "s", 1), ("p", "q", "x", 1.0, "c", "s", 2)])
    got = {r.name: (r.out_degree, r.in_degree, r.total_degree, r.incident_edges) for r in relations.degrees(e, "node_1", "node_2").collect()}
    assert got == {"p": (2, 1, 3, 2), "q": (0, 1, 1, 1)}


def test_ontology(spark):
    n = spark.createDataFrame([("松材线虫病",), ("松材线虫",), ("松褐天牛",), ("马尾松",), ("Sentinel-2",), ("trap",), ("leaf",), (None,)], "n string")
    got = n.select(ontology.node_type(F.col("n")), ontology.review_type(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("Disease", "Disease"), ("Pathogen", "Other"), ("Vector", "Vector"), ("Host", "Other"), ("Technology", "Technology"), ("Control", "ControlMeasure"), ("Other", "Symptom"), (None, "Other")]
    assert n.limit(1).select(ontology.labels(F.lit("Vector"))).first()[0] == ["Vector", "Insect", "Animal", "Organism", "Concept"]
    t = spark.createDataFrame([("a", "Host", "INFECTS", "b", "Pathogen", 1.0), ("a", "Pathogen", "INFECTS", "b", "Host", 1.0), ("a", "Host", "INFECTS", "b", "Host", 1.0), ("a", "Host", "UNKNOWN", "b", "Host", 1.0), ("a", None, "RELATED_TO", "b", None, 1.0), ("a", None, "INFECTS", "b", None, 1.0)], "node_1 string, node_1_type string, relationship string, node_2 string, node_2_type string, weight double")
    r = ontology.review(t).collect()
    assert [x.action for x in r] == ["auto_reverse", "keep", "type_mismatch", "keep", "keep", "type_mismatch"]
    assert (r[0].new_node_1, r[0].new_node_1_type) == ("b", "Pathogen")
    assert ontology.cleaned(ontology.review(t)).count() == 6 and ontology.issues(ontology.review(t)).count() == 3
    assert ontology.tree_paths({"Concept": {"Organism": {"Host": {}}}})["Host"] == ["Concept", "Organism", "Host"]


def test_canonical_names(spark):
    pairs = {"松材线虫": "Bursaphelenchus xylophilus", "线虫": "Bursaphelenchus xylophilus", "松褐天牛": "Monochamus alternatus", "天牛": "Monochamus alternatus", "马尾松": "Pinus massoniana", "黑松": "Pinus thunbergii", "松材线虫病": "Pine Wilt Disease", "阿维菌素": "Avermectin", "new": "new"}
    df = spark.createDataFrame(list(pairs.items()), "a string, b string")
    assert df.where(resolve.canonical(F.col("a")) != F.col("b")).count() == 0
    assert df.select(resolve.canonical(F.lit(" MY "), {"my": "x"})).first()[0] == "x"


def test_coreference(spark):
    text = "松材线虫病是一种严重的病害。该病由松材线虫引起。"
    df = spark.createDataFrame([(text, ["松材线虫病", "松材线虫"]), ("该病很重", ["松"]), ("nothing", ["松"])], "t string, e array<string>")
    got = [r[0] for r in df.select(resolve.nearest_entity(F.col("t"), "该病", F.col("e"), V.PRONOUNS["该病"])).collect()]
    assert got == ["松材线虫病", "松材线虫病", None]
    one = spark.createDataFrame([("PWD kills, 该病由",)], "t string")
    assert one.select(resolve.replace_pronoun(F.col("t"), "PWD", F.lit("a$b")), resolve.replace_pronoun(F.col("t"), "该病", F.lit("x"))).first()[:] == ("a$b kills, 该病由", "PWD kills, 该病由")


def test_similarity(spark):
    df = spark.createDataFrame([("a b", "B c", [1.0, 0.0], [1.0, 1.0], {"x": 1.0}, {"x": 2.0, "y": 1.0}), ("", "b", [0.0, 0.0], [1.0, 1.0], {"x": 1.0}, {"y": 2.0})], "a string, b string, u array<double>, v array<double>, m map<string,double>, n map<string,double>")
    got = df.select(resolve.jaccard(F.col("a"), F.col("b")), F.round(resolve.cosine(F.col("u"), F.col("v")), 4), F.round(resolve.sparse_similarity(F.col("m"), F.col("n")), 4)).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(1 / 3), 0.7071, 0.8944), (0.0, 0.0, 0.0)]


def test_similar_pairs_are_all_found(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    words += [w[:i] + rng.choice("abcd") + w[i + 1 :] for w in words[:60] for i in [rng.randrange(len(w))]]
    df = spark.createDataFrame(list(enumerate(words)), "k long, s string")
    for least in (0.6, 0.85):
        got = {(r.na, r.nb) for r in resolve.similar_pairs(df, "k", "s", least).collect()}
        uniq = list(dict.fromkeys(words))
        true = {(a, b) for i, a in enumerate(uniq) for b in uniq[i + 1 :] if resolve.ratio(a, b) >= least}
        assert got == true


def test_greedy_keep_equals_one_after_another(spark):
    import random

    rng = random.Random(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a != b})
    items = spark.createDataFrame([(i, i) for i in range(40)], "key int, rank int")
    got = {r.key for r in resolve.greedy_keep(items, spark.createDataFrame(pairs, "a int, b int")).collect() if r.kept}
    kept: set[int] = set()
    for i in range(40):
        if not any((min(i, j), max(i, j)) in pairs for j in kept):
            kept.add(i)
    assert got == kept


def test_average_linkage():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def plain(d, t):
        groups = [[i] for i in range(len(d))]
        while len(groups) > 1:
            best = min(((np.mean([d[i, j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q))
            if best[0] > t:
                break
            groups[best[1]] += groups.pop(best[2])
        return {frozenset(g) for g in groups}

    for t in (0.5, 1.0, 2.0):
        lab = resolve.average_linkage(d, t)
        assert {frozenset(np.flatnonzero(lab == c).tolist()) for c in set(lab)} == plain(d, t)


def test_cluster_refuses_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "MOST_IN_BLOCK", 2)
    df = spark.createDataFrame([(i, "g", [1.0, float(i)]) for i in range(3)], "k int, g string, v array<double>")
    with pytest.raises(ValueError):
        resolve.cluster(df, "k", "v", "g")


def test_merge_chains(spark):
    c = spark.createDataFrame([("a", "b", "b", 0.99), ("b", "c", "c", 0.97), ("c", "d", "d", 0.96), ("x", "y", "y", 0.5)], "entity1 string, entity2 string, keep string, confidence double")
    assert {r.name: r.canonical for r in resolve.merge_mapping(c).collect()} == {"a": "d", "b": "d", "c": "d"}


def test_merge_candidates(spark):
    c = spark.createDataFrame([(1, "pine wilt", "疾病"), (2, "pine wilt disease", "疾病"), (3, "PWD", "其他"), (4, "pine wilts", "疾病")], "ord int, entity string, category string")
    got = {(r.entity1, r.entity2, r.rule): (r.keep, r.category) for r in resolve.merge_candidates(c).collect()}
    assert got[("pine wilt", "pine wilt disease", "contains")] == ("pine wilt disease", "疾病")
    assert got[("pine wilt disease", "PWD", "synonym")] == ("pine wilt disease", "疾病")
    assert got[("pine wilt", "pine wilts", "similar")] == ("pine wilts", "疾病")


def test_extraction(spark):
    a = spark.createDataFrame([("c1", '{"concepts":[{"entity":" Pine ","importance":"9"},{"category":"x"}],"relationships":[{"node_1":"A","node_2":"b"},{"node_1":"A"}]}'), ("c2", "not json"), ("c3", None)], "chunk_id string, answer string")
    assert [tuple(r) for r in extract.concepts_of(a).collect()] == [("pine", 5, "misc", "c1", "concept", 0)]
    assert [tuple(r) for r in extract.relations_of(a).collect()] == [("a", "b", "related to", 0.8, "c1", "llm")]
    chunks = spark.createDataFrame([("c1", "x" * 30), ("c2", "short"), ("c3", "y" * 30)], "chunk_id string, text string")

    def call(t):
        if t.startswith("y"):
            raise RuntimeError
        return "{}"

    assert {r.chunk_id: r.answer for r in extract.ask(chunks, call).collect()} == {"c1": "{}", "c3": None}


def test_context_window(spark):
    rows = [("p", 1, "p_1", 1, "a", 5), ("p", 1, "p_1", 2, "b", 4), ("p", 2, "p_2", 3, "c", 5), ("p", 2, "p_2", 4, "d", 1), ("p", 3, "p_3", 5, "a", 5)]
    c = spark.createDataFrame(rows, "paper string, chunk_no int, chunk_id string, ord int, entity string, importance int")
    assert {r.chunk_id: r.context for r in extract.context_window(c, 2).collect()} == {"p_1": [], "p_2": ["b", "a"], "p_3": ["c", "b"]}
    assert {r.chunk_id: r.context for r in extract.recent_entities(c, 1).collect()} == {"p_1": "", "p_2": "a|b", "p_3": "c"}


def test_images(spark):
    links = spark.createDataFrame([("A", "i1", "one"), ("A", "i2", "two"), ("A", "i3", "three"), ("b", "i1", "one")], "concept string, image_path string, caption string")
    assert [(r.concept, r.image_path) for r in extract.images_for(links, ["a", "B"], 2).collect()] == [("A", "i1"), ("A", "i2")]


def test_seed_clusters_equal_one_after_another(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    df = spark.createDataFrame([(i, w, "g" if i % 2 else "h") for i, w in enumerate(words)], "k int, s string, g string")
    got = {r.k: r.seed for r in resolve.seed_clusters(df, "k", "s", "g", 0.8).collect()}
    true = {}
    for i, w in enumerate(words):
        seeds = [j for j in sorted(set(true.values())) if j % 2 == i % 2 and (words[j] == w or resolve.ratio(words[j], w) >= 0.8)]
        true[i] = seeds[0] if seeds else i
    assert got == true


def test_alias_and_link(spark):
    names = spark.createDataFrame([("PWD",), ("pine wilt diseas",), ("松材线虫",), ("oak",), (None,)], "n string")
    got = {r.name: r.standard for r in resolve.alias_normalise(names, "n").collect()}
    assert got == {"PWD": "松材线虫病", "pine wilt diseas": "松材线虫病", "松材线虫": "松材线虫", "oak": "oak"}
    ent = spark.createDataFrame([(1, "松材线虫病", "Disease"), (2, "PWD", "Disease"), (3, "pine wilt", "Disease"), (4, "松材线虫", "Pathogen"), (5, "B. xylophilus", "Pathogen"), (6, "马尾松", "Host")], "id int, name string, type string")
    rel = spark.createDataFrame([("PWD", "r", "马尾松", 1), ("pine wilt", "r", "马尾松", 2)], "head string, relation string, tail string, ord int")
    e, r = resolve.link_entities(ent, rel, resolve.alias_normalise(ent, "name"))
    assert sorted(map(tuple, e.collect())) == [(1, "松材线虫病", "Disease"), (2, "松材线虫", "Pathogen"), (3, "马尾松", "Host")]
    assert [tuple(x) for x in r.collect()] == [("松材线虫病", "r", "马尾松", 1)]
    e, _ = resolve.link_entities(ent.limit(0), rel, resolve.alias_normalise(ent, "name"))
    assert e.collect() == []


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    assert relations.numbered(df, ["v"], "n").where("n <> v + 1").count() == 0
