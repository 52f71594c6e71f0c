"""Walks over relations of every type against a breadth-first search."""

import pytest
from oracle import DATA, connect

from boscograph import catalogue
from boscograph.plans import lens
from boscograph.plans.graphs import SEED

SF = f"{DATA}/sf0.001"
TARGET = "scarlet needle scorch"


@pytest.fixture(scope="module")
def edges():
    return connect("sf0.001").sql(f"with {lens.E} select src, rel_type, dst from e").fetchall()


@pytest.fixture(scope="module")
def near(edges):
    out = {}
    for a, _, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def walk(near, hops):
    dist, edge = {SEED: 0}, [SEED]
    for step in range(1, hops + 1):
        edge = sorted({x for v in edge for x in near.get(v, ())} - set(dist))
        dist.update(dict.fromkeys(edge, step))
    return dist


def test_neighbours_of_any_type(spark, edges, near):
    two, one = walk(near, 2), walk(near, 1)
    assert {r.name: r.dist for r in run(spark, "kg_khop")} == two
    of_one_type: dict = {}
    for a, rel, b in edges:
        if rel == "feeds_on" and a != b:
            of_one_type.setdefault(a, set()).add(b)
            of_one_type.setdefault(b, set()).add(a)
    assert len(two) > len(walk(of_one_type, 2))
    want = {}
    for a, _, b in edges:
        if a in one or b in one:
            want[a, b] = want.get((a, b), 0) + 1
    assert {(r.src, r.dst): r.n for r in run(spark, "kg_neighborhood")} == want
    kinds = {}
    for a, rel, b in edges:
        if a in one and b in one:
            kinds.setdefault(rel, []).append(a)
    assert {r.rel_type: (r.n, r.n_src) for r in run(spark, "kg_expand_induced")} == {k: (len(x), len(set(x))) for k, x in kinds.items()}
    lines = [r.line for r in sorted(run(spark, "kg_search_context"), key=lambda r: r.line_no)]
    assert lines[:15] == [f"- {n}" for n, _ in sorted(one.items(), key=lambda x: (x[1], x[0]))[:15]]


def test_shortest_path_over_any_type(spark, near):
    paths = {SEED: [SEED]}
    edge = dict(paths)
    for _ in range(5):
        new = {}
        for v, p in edge.items():
            for x in near.get(v, ()):
                if x not in paths:
                    new[x] = min(new.get(x, [*p, x]), [*p, x])
        paths.update(new)
        edge = new
    assert TARGET in paths
    assert [r.name for r in sorted(run(spark, "kg_shortest_path"), key=lambda r: r.step)] == paths[TARGET]
