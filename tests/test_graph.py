import math
import random

import pytest

from boscograph.operators import centrality, graph, search

E = "src string, dst string, rel_type string, weight double"
MINI = [("松材线虫", "马尾松", "感染", 0.9), ("松褐天牛", "松材线虫", "传播", 0.9), ("阿维菌素", "松褐天牛", "防治", 0.8), ("噻虫啉", "松材线虫", "杀灭", 0.8)]


@pytest.fixture(scope="module")
def mini(spark):
    return spark.createDataFrame(MINI, E)


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def test_small_graph(spark, mini):
    c = {r.name: r.component for r in graph.components(mini, names(spark, "黑松")).collect()}
    assert len(set(c.values())) == 2 and c["黑松"] == "黑松" and len(c) == 6
    assert {r.name: r.n_neighbours for r in graph.undirected_degree(mini).collect()}["松材线虫"] == 3
    path = [r.name for r in graph.shortest_path(mini, "阿维菌素", "马尾松", 5).orderBy("step").collect()]
    assert path == ["阿维菌素", "松褐天牛", "松材线虫", "马尾松"]
    assert graph.shortest_path(mini, "阿维菌素", "马尾松", 2).collect() == []
    found, on = graph.neighbourhood(mini, names(spark, "松褐天牛"), 1)
    assert {r.name for r in found.collect()} == {"松褐天牛", "松材线虫", "阿维菌素"} and on.count() == 2
    assert graph.induced(mini, found).count() == 2


def test_empty_graph(spark, mini):
    none = mini.limit(0)
    s = graph.stats(none).first()
    assert (s.nodes, s.edges, s.density, s.avg_degree) == (0, 0, None, None)
    assert graph.components(none, names(spark, "a")).collect()[0].component == "a"
    assert graph.louvain(none, names(spark, "a")).count() == 1
    assert graph.clustering(none).collect() == []


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def test_components_and_clustering(spark):
    pairs = random_edges(1, 60, 45)
    e = spark.createDataFrame([(a, b, "r", 1.0) for a, b in pairs], E)
    near = neighbours(pairs)
    lab = {}
    for v in sorted(near):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in lab:
                lab[x] = lab.get(v, v) if x != v else v
                todo += near[x]
    assert {r.name: r.component for r in graph.components(e, graph.nodes_of(e)).collect()} == lab
    pairs = random_edges(2, 20, 90)
    near = neighbours(pairs)
    got = {r.name: (r.triangles, r.clustering) for r in graph.clustering(spark.createDataFrame([(a, b, "r", 1.0) for a, b in pairs], E)).collect()}
    for v, (t, c) in got.items():
        k = len(near[v])
        true = sum(1 for a in near[v] for b in near[v] if a < b and b in near[a])
        assert t == true and c == pytest.approx(2 * true / (k * (k - 1)) if k > 1 else 0)


def test_long_chain_component(spark):
    e = spark.createDataFrame([(f"x{i:03d}", f"x{i + 1:03d}", "r", 1.0) for i in range(80)], E)
    assert {r.component for r in graph.components(e, graph.nodes_of(e)).collect()} == {"x000"}


def test_path_centrality(spark):
    line = [("a", "b"), ("b", "c"), ("c", "d")]
    got = {r.name: (r.closeness, r.betweenness) for r in centrality.paths_centrality(spark.createDataFrame([(a, b, "r", 1.0) for a, b in line], E)).collect()}
    assert got["b"] == (pytest.approx(3 / 4), pytest.approx(2 / 3)) and got["a"] == (pytest.approx(3 / 6), 0.0)
    star = spark.createDataFrame([("h", x, "r", 1.0) for x in "abc"], E)
    v = {r.name: r.eigenvector_centrality for r in centrality.eigenvector(star, 60).collect()}
    assert v["h"] == pytest.approx(1 / math.sqrt(2), abs=1e-3)


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    e = spark.createDataFrame([(a, b, "r", 1.0) for a, b in pairs], E)
    lou = {}
    for r in graph.louvain(e, graph.nodes_of(e)).collect():
        lou.setdefault(r.community, set()).add(r.name)
    assert sorted(map(sorted, lou.values())) == [list("abcd"), list("wxyz")]
    m = graph.modularity(e, graph.louvain(e, graph.nodes_of(e))).first()[0]
    assert m == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)
    lpa = graph.label_propagation(e, graph.nodes_of(e)).collect()
    assert len({r.community for r in lpa if r.name in "xyz"}) == 1


def test_summaries(spark):
    labels = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("z", "c2")], "name string, community string")
    concepts = spark.createDataFrame([("a", "host", 2), ("b", "host", 5)], "entity string, category string, importance int")
    got = {r.community: (r.title, r.core_concepts, r.theme, r.size) for r in search.community_summaries(labels, concepts).collect()}
    assert got == {"c1": ("HOST 相关知识 (2 概念)", "b, a", "host", 2), "c2": ("MIXED 相关知识 (1 概念)", "", "mixed", 1)}
