"""Most similar vectors for every vector."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.session import cut_table, widely

#: Vectors of one bucket that meet in one task; a fuller bucket is hashed on, and cut into blocks where that doesn't help.
MOST_IN_BUCKET = 20_000
LEVELS = 3
#: Rows of a bucket, those that probe it included, that are compared whole; a larger one is hashed once more within its task.
WHOLE = 512
#: Vectors are broadcast up to this many bytes; beyond, they travel to the buckets, and are joined for the exact reranking, by shuffle.
MOST_BROADCAST = 64 << 20
#: A candidate as it travels: number of the vector and cosine.
_CANDIDATE = np.dtype([("j", "<i8"), ("s", "<f4")])


def _rotate(x: np.ndarray, table: int, level: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform."""
    signs = np.random.default_rng([seed, table, level]).choice(np.array([-1, 1], dtype=np.float32), (3, x.shape[1]))
    n, d = x.shape
    for s in signs:
        x, h = x * s, 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
        x /= np.sqrt(d, dtype=np.float32)
    return x


def _codes(x: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first."""
    far = np.abs(x)
    at = np.argsort(-far, axis=1, kind="stable")[:, :probes]
    return at * 2 + (np.take_along_axis(x, at, 1) > 0)


def _buckets(x: np.ndarray, tables: int, probes: int, more: int, hot: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, whether it is the row's own bucket) of all probes; hot has the buckets that are hashed on, by level."""
    pad = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, pad - x.shape[1]))) if pad != x.shape[1] else x
    rows, keys, owns = [], [], []
    for t in range(tables):
        row, key, own = np.arange(len(x)), np.full(len(x), t, dtype=np.int64), np.ones(len(x), dtype=bool)
        for level in range(len(hot) + 1):
            code = _codes(_rotate(x, t, level, seed), min(probes if level == 0 else more, pad))
            wide = code.shape[1]
            key = (key[:, None] * (2 * pad) + code[row] + tables).ravel()
            own = (own[:, None] & (np.arange(wide) == 0)).ravel()
            row = np.repeat(row, wide)
            on = np.isin(key, hot[level]) if level < len(hot) else np.zeros(len(key), dtype=bool)
            rows.append(row[~on])
            keys.append(key[~on])
            owns.append(own[~on])
            row, key, own = row[on], key[on], own[on]
            if not len(row):
                break
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(owns)


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(len(blobs), -1)


def _top(s: np.ndarray, rows: np.ndarray, cols: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the m largest of each row of s; rows and cols are the numbers of the rows and columns."""
    m = min(m, s.shape[1])
    at = np.argpartition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m :] if m < s.shape[1] else np.tile(np.arange(m), (len(s), 1))
    v = np.take_along_axis(s, at, 1).ravel()
    i, j = np.repeat(rows, m), cols[at].ravel()
    ok = v > -2
    return i[ok], j[ok], v[ok]


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The m largest of each i, each j once, sorted by i, then from the largest down."""
    order = np.lexsort((-s, j, i))
    i, j, s = i[order], j[order], s[order]
    first = np.ones(len(i), dtype=bool)
    first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, s = i[first], j[first], s[first]
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.array([], int)
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    keep = place < m
    return i[keep], j[keep], s[keep]


def _meet(x: np.ndarray, base: np.ndarray, query: np.ndarray, m: int, more: int, whole: int, bucket: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (row, row, cosine) among the rows of one bucket, both ways of every pair compared.

    Rows that only probe the bucket are compared with each other too. A small bucket is compared whole. In a larger one each row is hashed once more by a
    rotation of the bucket's own, and is compared with the rows whose `more` nearest axes hold its own.
    """
    out = []

    def compare(q: np.ndarray, b: np.ndarray, both: bool) -> None:
        for a in range(0, len(q), 1024):
            s = x[q[a : a + 1024]] @ x[b].T
            s[q[a : a + 1024, None] == b[None, :]] = -3
            out.append(_top(s, q[a : a + 1024], b, m))
            if both:
                out.append(_top(np.ascontiguousarray(s.T), b, q[a : a + 1024], m))

    if query.all():  # no cell of a cut bucket
        base = query
    if len(x) <= whole and query.all():
        every = np.arange(len(x))
        compare(every, every, False)
    elif base.any() and query.any():
        pad = 1 << max(1, int(x.shape[1] - 1).bit_length())
        code = _codes(_rotate(np.pad(x, ((0, 0), (0, pad - x.shape[1]))), bucket, LEVELS + 1, seed), min(more, pad))
        q = np.flatnonzero(query)
        probe, row = code[q].ravel(), np.repeat(q, code.shape[1])
        order = np.argsort(probe, kind="stable")
        probe, row = probe[order], row[order]
        own, b = code[base, 0], np.flatnonzero(base)
        order = np.argsort(own, kind="stable")
        own, b = own[order], b[order]
        for c in np.unique(own):
            compare(row[np.searchsorted(probe, c) : np.searchsorted(probe, c, "right")], b[np.searchsorted(own, c) : np.searchsorted(own, c, "right")], True)
    return _best(*(np.concatenate(z) for z in zip(*out)), m) if out else (np.array([], int), np.array([], int), np.array([], np.float32))


def similar(df: DataFrame, key: str, vector: str, dim: int = 64, k: int = 5, tables: int = 8, probes: int = 3, more_probes: int = 10, wanted: int = 32, whole: int = WHOLE, seed: int = 42) -> DataFrame:
    """(key, other, cosine) of the k vectors most similar to each, by cosine; like cosines go by the smaller key.

    Left out on both sides: null keys or vectors, vectors of other than dim numbers, with nulls or NaN in them, or all zero; a key that
    comes twice counts as two vectors. Vectors that are equal up to their length are compared once, by the one with the smallest key; its k + 1
    smallest keys stand for a group of copies, so a group with a third of all rows costs no more than another.

    Cross-polytope hashing: in each of the tables a vector belongs to the signed axis nearest to it after a fast pseudo-random rotation, and
    meets the vectors around the `probes` axes nearest to it (more where the collection is so small that an axis has fewer than `wanted`). Buckets over `whole` rows are hashed by a second rotation within their
    task and only vectors whose `more_probes` nearest axes hold each other's are compared, so the number of hashes follows from the number of vectors. Buckets over
    MOST_IN_BUCKET are hashed on before anything is sent, up to LEVELS times, and those that stay full are cut into blocks all
    pairs of which meet, so none is capped. The best candidates of each vector are reranked by exact cosines. Recall is in the README.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    m = k + 1  # one more than asked for, since cosines of candidates have the precision of one float

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), dim)
            x[~(np.abs(x) < 1e150)] = np.nan
            n = np.sqrt((x * x).sum(axis=1))
            ok = n > 0
            x = np.round(x[ok] / n[ok, None], 8) + 0.0
            yield pd.DataFrame({"i": pdf["i"].to_numpy()[ok], "g": [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], "v": [r.tobytes() for r in x.astype(np.float32)]})

    v = df.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null")
    v = widely(v.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))).mapInPandas(unit, f"i {kind}, g binary, v binary")
    # One row a direction: its smallest key is its head.
    units = v.groupBy("g").agg(F.min("i").alias("i"), F.min_by("v", "i").alias("v"), F.count("*").alias("copies"))
    units = cut_table(units.select(F.monotonically_increasing_id().alias("u"), "*"))
    width = 2 << max(1, (dim - 1).bit_length())
    total, copied = units.agg(F.count("*"), F.coalesce(F.max("copies"), F.lit(0)) > 1).first()

    probes = min(width // 2, max(probes, -(-wanted * width // max(1, total))))

    def owned(hot: list[np.ndarray]):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                _, b, own = _buckets(_matrix(pdf["v"]), tables, 1, 1, hot, seed)
                b, n = np.unique(b[own], return_counts=True)
                yield pd.DataFrame({"b": b, "n": n})

        return units.select("v").mapInPandas(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where(f"n > {MOST_IN_BUCKET}")

    # Full buckets number at most tables * rows / MOST_IN_BUCKET, so their list stays short.
    hot: list[np.ndarray] = []
    full = {r["b"]: r["n"] for r in owned(hot).collect()} if total > MOST_IN_BUCKET else {}
    while full and len(hot) < LEVELS - 1:
        hot.append(np.array(sorted(full), dtype=np.int64))
        full = {r["b"]: r["n"] for r in owned(hot).collect()}
    blocks = {b: -(-n // MOST_IN_BUCKET) for b, n in full.items()}

    near = None
    if total * dim * 4 <= MOST_BROADCAST:
        rows = units.select("u", "v").orderBy("u").collect()
        near = spark.sparkContext.broadcast((np.array([r["u"] for r in rows], dtype=np.int64), np.frombuffer(b"".join(r["v"] for r in rows), dtype=np.float32).reshape(len(rows), dim)))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                one = pdf.iloc[a : a + 2000]
                x = _matrix(one["v"])
                row, b, own = _buckets(x, tables, probes, probes, hot, seed)
                ids, sent = one["u"].to_numpy(), one["v"].to_numpy() if near is None else np.full(len(one), b"")
                cutting = np.isin(b, list(blocks)) if blocks else np.zeros(len(b), dtype=bool)
                plain = ~cutting
                yield pd.DataFrame({"b": b[plain], "x": 0, "y": 0, "u": ids[row[plain]], "p": sent[row[plain]], "base": own[plain], "query": True})
                extra = []
                for r, bucket, mine in zip(row[cutting], b[cutting], own[cutting]):
                    parts = blocks[int(bucket)]
                    h = int((int(ids[r]) * 2654435761 >> 8) % parts)
                    extra += [(bucket, x_, h, ids[r], sent[r], False, True) for x_ in range(parts)]
                    extra += [(bucket, h, y_, ids[r], sent[r], True, False) for y_ in range(parts)] if mine else []
                if extra:
                    yield pd.DataFrame(extra, columns=["b", "x", "y", "u", "p", "base", "query"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf["u"].to_numpy()
        x = _matrix(pdf["p"]) if near is None else near.value[1][np.searchsorted(near.value[0], u)]
        i, j, s = _meet(x, pdf["base"].to_numpy(), pdf["query"].to_numpy(), m, more_probes, whole, int(pdf["b"].iloc[0]), seed)
        i, j = u[i], u[j]  # a row may be base and query of a block, as two rows
        i, j, s = (z[i != j] for z in (i, j, s))
        found = np.empty(len(i), dtype=_CANDIDATE)
        found["j"], found["s"] = j, s
        start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.array([], int)
        end = np.append(start[1:], len(i))
        return pd.DataFrame({"u": i[start] if len(i) else i, "c": [found[a:b].tobytes() for a, b in zip(start, end)]})

    met = widely(units.select("u", "v")).mapInPandas(spread, "b long, x int, y int, u long, p binary, base boolean, query boolean").groupBy("b", "x", "y").applyInPandas(meet, "u long, c binary")

    # The best of each vector over all tables: groups of some thousand vectors, with at most tables * probes * m candidates each.
    parts = max(1, -(-total // 4000), min(spark.sparkContext.defaultParallelism, -(-total // 500)))

    def merged(pdf: pd.DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.frombuffer(b"".join(pdf["c"]), dtype=_CANDIDATE)
        i = np.repeat(pdf["u"].to_numpy(), [len(c) // _CANDIDATE.itemsize for c in pdf["c"]])
        return _best(i, found["j"], found["s"], most)

    groups = met.groupBy(F.pmod(F.xxhash64("u"), F.lit(parts)))
    if near is not None:

        def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, x = near.value
            i, j, _ = merged(pdf, m)
            cos = np.einsum("nd,nd->n", x[np.searchsorted(ids, i)].astype(np.float64), x[np.searchsorted(ids, j)].astype(np.float64))
            return pd.DataFrame({"a": i, "h": j, "cos": np.round(cos, 9)})

        links = groups.applyInPandas(rerank, "a long, h long, cos double")
    else:

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            i, j, _ = merged(pdf, m)
            return pd.DataFrame({"a": i, "h": j})

        def cosine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                cos = np.einsum("nd,nd->n", _matrix(pdf["va"]).astype(np.float64), _matrix(pdf["vh"]).astype(np.float64)) if len(pdf) else np.array([])
                yield pd.DataFrame({"a": pdf["a"], "h": pdf["h"], "cos": np.round(cos, 9)})

        both = groups.applyInPandas(best, "a long, h long").join(units.select(F.col("u").alias("a"), F.col("v").alias("va")), "a").join(units.select(F.col("u").alias("h"), F.col("v").alias("vh")), "h")
        links = both.mapInPandas(cosine, "a long, h long, cos double")
    links = links.join(units.select(F.col("u").alias("h"), F.col("i").alias("j"), "copies"), "h")
    order = W.partitionBy("a").orderBy(F.desc("cos"), "j")
    heads = units.select(F.col("u").alias("a"), F.col("i").alias("key"))
    if not copied:
        own = links.withColumn("n", F.row_number().over(order)).where(f"n <= {k}").join(heads, "a")
        return own.select(F.col("key").alias(key), F.col("j").alias("other"), F.col("cos").alias("cosine"))
    # Copies: the k + 1 smallest keys of a direction are shown for it, and every row of it answers with its list, less itself.
    copies = v.select("g", "i").join(units.where("copies > 1").select("g", "u"), "g")
    few = copies.withColumn("at", F.row_number().over(W.partitionBy("g").orderBy("i"))).where(f"at <= {k + 1}").select(F.col("u").alias("h"), "i")
    shown = links.where("copies = 1").select("a", "j", "cos").unionByName(links.where("copies > 1").select("a", "h", "cos").join(few.withColumnRenamed("i", "j"), "h").select("a", "j", "cos"))
    shown = shown.unionByName(few.select(F.col("h").alias("a"), F.col("i").alias("j"), F.lit(1.0).alias("cos")))
    lists = shown.withColumn("n", F.row_number().over(order)).where(f"n <= {k + 1}").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "j", "cos"))).alias("x"))
    named = units.where("copies = 1").select("i", F.col("u").alias("a")).unionByName(copies.select("i", F.col("u").alias("a")))
    own = named.join(lists, "a").select("i", F.slice(F.filter("x", lambda y: y.j != F.col("i")), 1, k).alias("x"))
    return own.select(F.col("i").alias(key), F.explode("x").alias("x")).select(key, F.col("x.j").alias("other"), F.col("x.cos").alias("cosine"))
