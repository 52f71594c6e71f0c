"""Communities are sought until nothing changes any more."""

import pytest

from boscograph.operators import graph

E = "src string, dst string, rel_type string, weight double"


def chain(spark, n):
    return spark.createDataFrame([(f"x{i:04d}", f"x{i + 1:04d}", "r", 1.0) for i in range(n - 1)], E)


def test_labels_are_stable(spark):
    n = 12
    e = chain(spark, n)
    got = {r.name: r.community for r in graph.label_propagation(e, graph.nodes_of(e)).collect()}
    at = [got[f"x{i:04d}"] for i in range(n)]
    for i in range(n):
        votes = at[max(i - 1, 0) : i + 2]
        assert at[i] == min(votes, key=lambda c: (-votes.count(c), c)), (i, at)


def test_louvain_leaves_no_merge_that_gains(spark):
    n = 150
    e = chain(spark, n)
    got = {r.name: r.community for r in graph.louvain(e, graph.nodes_of(e)).collect()}
    at = [got[f"x{i:04d}"] for i in range(n)]
    vol, between, m = {}, {}, n - 1
    for i in range(n - 1):
        a, b = sorted((at[i], at[i + 1]))
        vol[a] = vol.get(a, 0) + 1
        vol[b] = vol.get(b, 0) + 1
        if a != b:
            between[a, b] = between.get((a, b), 0) + 1
    assert max(w / m - vol[a] * vol[b] / (2 * m * m) for (a, b), w in between.items()) < 1e-6


def test_limits_are_errors(spark):
    e = chain(spark, 16)
    with pytest.raises(RuntimeError):
        graph.label_propagation(e, graph.nodes_of(e), rounds=1)
    with pytest.raises(RuntimeError):
        graph.louvain(e, graph.nodes_of(e), levels=1)
