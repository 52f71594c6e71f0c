"""python -m boscograph.llm.recall DIR [WHOLE]: share of the true 5 most similar vectors that p7_neighbours finds, by brute force over all of DIR/concept_vectors.parquet. WHOLE sets
the rows of a bucket up to which it is compared whole, to measure the second hash on few vectors."""

import sys

import numpy as np

from boscograph.llm import neighbours
from boscograph.session import local_session
from boscograph.sources.tables import table


def main(sf_dir: str, whole: int = neighbours.WHOLE) -> None:
    spark = local_session(8, "recall")
    spark.sparkContext.setLogLevel("OFF")
    rows = [(r.vec_id, r.vector) for r in table(spark, sf_dir, "concept_vectors").where("size(vector) = 64").select("vec_id", "vector").collect()]
    rows = [(i, v) for i, v in rows if any(v)]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true: dict[int, set] = {}
    near: dict[int, set] = {}
    for a in range(0, len(x), 1000):
        s = x[a : a + 1000] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        top = np.argpartition(-s, 5, axis=1)[:, :5]
        for k in range(len(s)):
            true[ids[a + k]] = set(ids[top[k]].tolist())
            near[ids[a + k]] = {int(ids[j]) for j in top[k] if s[k, j] >= 0.85}
    found: dict[int, set] = {}
    for r in neighbours.similar(table(spark, sf_dir, "concept_vectors"), "vec_id", "vector", dim=64, k=5, whole=whole).collect():
        found.setdefault(r.vec_id, set()).add(r.other)
    hits = sum(len(true[i] & found.get(i, set())) for i in true)
    close = sum(len(near[i] & found.get(i, set())) for i in near)
    print(f"{len(x)} vectors: recall of the 5 most similar {hits / (5 * len(x)):.4f}, of those with cosine 0.85 or more {close / max(1, sum(map(len, near.values()))):.4f}")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
