"""Queries on the whole graph against brute force: no pair is left out because few relations join it."""

import pytest
from oracle import DATA, connect

from boscograph import catalogue
from boscograph.plans import lens

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


@pytest.fixture(scope="module")
def near(duck):
    out = {}
    for a, b in duck.sql(f"with {lens.E}, {lens.PAIRS} select a, b from pairs").fetchall():
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def component_of(near):
    lab = {}
    for v in sorted(near):
        todo = [] if v in lab else [v]
        while todo:
            x = todo.pop()
            if x not in lab:
                lab[x] = v
                todo += near[x]
    return lab


def test_components_whole(spark, duck, near):
    lab = component_of(near)
    for (x,) in duck.sql(f"with {lens.C} select distinct entity from c").fetchall():
        lab.setdefault(x, x)
    n = {}
    for c in lab.values():
        n[c] = n.get(c, 0) + 1
    assert {r.component: r.n for r in run(spark, "kg_components")} == n
    assert {r.name: r.theme for r in run(spark, "kg_themes")} == {v: f"theme: {c}" for v, c in component_of(near).items()}
    assert {r.community: r["size"] for r in run(spark, "kg_community_summary")} == {c: sum(x == c for x in component_of(near).values()) for c in set(component_of(near).values())}


def test_triangles_and_degrees_whole(spark, near):
    got = {r.name: (r.degree, r.triangles) for r in run(spark, "kg_clustering")}
    assert got == {v: (len(x), sum(1 for a in x for b in x if a < b and b in near[a])) for v, x in near.items()}
    assert {r.name: r.degree_centrality for r in run(spark, "kg_centrality_degree")} == {v: pytest.approx(len(x) / (len(near) - 1), abs=1e-6) for v, x in near.items()}


def test_every_node_has_a_row(spark, near):
    for name in ("kg_louvain", "kg_centrality_eigen", "kg_centrality_paths"):
        assert {r.name for r in run(spark, name)} == set(near), name
    assert sum(r.n for r in run(spark, "kg_label_propagation")) == len(near)
    assert len(run(spark, "kg_modularity")) == 1
