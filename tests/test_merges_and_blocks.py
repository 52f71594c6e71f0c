"""Merges in circles, and blocks of any size."""

import numpy as np

from boscograph import catalogue
from boscograph.operators import resolve


def test_merges_in_circles_end(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(resolve, "cut_table", lambda df, cut=resolve.cut_table: rounds.append(1) or cut(df))
    pairs = [("c", "a"), ("a", "b"), ("b", "c"), ("t", "c"), ("x", "y"), ("y", "x"), *((f"n{i:02}", f"n{i + 1:02}") for i in range(20))]
    df = spark.createDataFrame([(a, b, b, 0.99) for a, b in pairs], "entity1 string, entity2 string, keep string, confidence double")
    got = {r.name: r.canonical for r in resolve.merge_mapping(df).collect()}
    assert got == {"b": "a", "c": "a", "t": "a", "y": "x"} | {f"n{i:02}": "n20" for i in range(20)}
    assert len(rounds) < 10


def test_linkage_without_the_matrix(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(12, 5)), 9, axis=0) + 0.25 * rng.normal(size=(108, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sets = lambda label: {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())}
    monkeypatch.setattr(resolve, "STRIP", 10)
    for dense in (0, 2000):
        monkeypatch.setattr(resolve, "DENSE", dense)
        for cosine in (True, False):
            d = resolve._far(x, x, cosine)
            for t in (0.05, 0.15, 0.4, 1.0):
                assert sets(resolve.linkage_of(x, t, cosine)) == sets(resolve.average_linkage(d, t))


def test_blocks_over_8000_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8100, 6))
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(x.tolist())], "k int, g string, v array<double>")
    got = resolve.cluster(df, "k", "v", "g", 0.9999).toPandas()
    assert len(got) == 8100 and (got["cluster"] <= got["k"]).all()


def test_rows_of_the_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = 1 - u @ u.T
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(x.tolist())], "k int, g string, v array<double>")
    got = resolve.cluster(df, "k", "v", "g", -0.5, "rowwise_euclidean").orderBy("k").toPandas()["cluster"].tolist()
    assert got == resolve.average_linkage(d, 1.5).tolist() and len(set(got)) < 40


def test_names_of_large_categories(spark, tmp_path):
    n = 8100
    x = np.random.default_rng(7).normal(size=(n, 64))
    vectors = spark.createDataFrame([(i, f"name {i}", "host", v) for i, v in enumerate(x.tolist())], "vec_id long, entity string, category string, vector array<float>")
    vectors.write.parquet(str(tmp_path / "concept_vectors.parquet"))
    vectors.selectExpr("vec_id as concept_id", "entity", "3 as importance", "category", "'c' as chunk_id", "'t' as type", "vec_id as ord").write.parquet(str(tmp_path / "concepts.parquet"))
    assert catalogue.QUERIES["kg_cluster_names"](spark, str(tmp_path)).count() == n
