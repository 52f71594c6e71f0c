"""Which names mean one thing: canonical names, similarity, clusters."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.functions import vocabulary as V
from boscograph.operators.relations import mapped, numbered
from boscograph.session import cut, cut_table


def canonical(name: Column, extra: dict[str, str] | None = None) -> Column:
    """Canonical name by rule (case and outer blanks don't matter), else the name as it is; extra rules come first."""
    table = {x: c for c, xs in V.CANONICAL.items() for x in xs} | {k.lower(): v for k, v in (extra or {}).items()}
    return mapped(F.lower(F.trim(name)), table, name)


def tokens(c: Column) -> Column:
    """Different lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of the words of two texts; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def sparse_similarity(a: Column, b: Column) -> Column:
    """Cosine of two maps from term to weight; 0 without a common term or for a zero length."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    product = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) * F.try_element_at(b, k))
    length = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    n = length(a) * length(b)
    return F.when(n > 0, product / n).otherwise(0.0)


def hybrid(dense: Column, sparse: Column, alpha: float = 0.7) -> Column:
    return alpha * dense + (1 - alpha) * sparse


def grams(c: Column, low: int = 2, high: int = 3) -> Column:
    """Character n-grams of the lower-case text with its runs of blanks made one."""
    t = F.regexp_replace(F.lower(c), r"\s+", " ")
    one = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*(one(n) for n in range(low, high + 1))))


def tfidf(df: DataFrame, name: str, features: int = 100) -> DataFrame:
    """name, gram, weight: character 2- and 3-grams, the `features` most frequent of all, smooth idf, length 1; names must differ."""
    g = df.select(name, F.explode(grams(F.col(name))).alias("gram"))
    tf = g.groupBy(name, "gram").agg(F.count("*").alias("tf"))
    top = tf.groupBy("gram").agg(F.sum("tf").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "gram").limit(features)
    n = df.agg(F.count("*").alias("docs"))
    idf = F.broadcast(top.crossJoin(n).select("gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")))  # `features` rows
    w = tf.join(idf, "gram").select(name, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    size = w.groupBy(name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(size, name).select(name, "gram", (F.col("w") / F.col("size")).alias("weight"))


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all (Ratcliff and Obershelp)."""
    return SequenceMatcher(None, a, b).ratio()


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Matching characters of each pair, as ratio() counts them, for many pairs at once: the longest common run (the first of ties), then the same left and right of it."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    total = np.zeros(len(a), dtype=np.int64)
    slow = (np.maximum(la, lb) >= 200) | np.array(["\0" in x or "\0" in y for x, y in zip(a, b)], dtype=bool)  # SequenceMatcher has rules of its own for long texts
    for i in np.flatnonzero(slow):
        total[i] = sum(m.size for m in SequenceMatcher(None, a[i], b[i]).get_matching_blocks())
    pair = np.flatnonzero(~slow & (la > 0) & (lb > 0))
    if not len(pair):
        return total
    wide = max(la[pair].max(), lb[pair].max())
    code = lambda names: np.array(["" if z else x for x, z in zip(names, slow)], dtype=f"U{wide}").view(np.uint32).reshape(len(names), wide)
    x, y, zero = code(a), code(b), np.zeros(len(pair), dtype=np.int64)
    todo = [(pair, zero, la[pair], zero, lb[pair])]
    while todo:
        pair, a0, a1, b0, b1 = (np.concatenate(t) for t in zip(*todo))
        todo = []
        order = np.lexsort((b1 - b0, a1 - a0))
        for at in range(0, len(order), 4096):
            p, i0, i1, j0, j1 = (t[order[at : at + 4096]] for t in (pair, a0, a1, b0, b1))
            ia, jb = i0 + np.arange((i1 - i0).max())[:, None], j0 + np.arange((j1 - j0).max())[:, None]
            u = np.where(ia < i1, x[p, np.minimum(ia, wide - 1)], 0xFFFFFFFF)
            v = np.where(jb < j1, y[p, np.minimum(jb, wide - 1)], 0)
            old, new = np.zeros((len(v) + 1, len(p)), dtype=np.uint8), np.zeros((len(v) + 1, len(p)), dtype=np.uint8)
            place = (255 - np.arange(len(v), dtype=np.uint16))[:, None]
            best, end = np.zeros(len(p), dtype=np.uint16), np.zeros(len(p), dtype=np.int64)
            for i in range(len(u)):
                np.add(old[:-1], 1, out=new[1:])
                new[1:] *= v == u[i]
                run = ((new[1:].astype(np.uint16) << 8) | place).max(0)  # the longest run that ends here, the first of ties
                up = run >> 8 > best >> 8
                best, end = np.where(up, run, best), np.where(up, i, end)
                old, new = new, old
            k = (best >> 8).astype(np.int64)
            i, j = i0 + end - k + 1, j0 + 255 - (best & 255).astype(np.int64) - k + 1
            total += np.bincount(p, k, len(total)).astype(np.int64)
            for t in ((p, i0, i, j0, j), (p, i + k, i1, j + k, j1)):
                more = (k > 0) & (t[1] < t[2]) & (t[3] < t[4])
                if more.any():
                    todo.append(tuple(c[more] for c in t))
    return total


def _signatures(names: list[str]) -> np.ndarray:
    """128 bits of each name: every letter, repeated ones told apart, turns one bit. Names that differ in d letters differ in d bits at most."""
    known: dict[tuple[str, int], int] = {}
    out = []
    for s in names:
        seen: dict[str, int] = {}
        bits = 0
        for ch in s:
            n = seen[ch] = seen.get(ch, 0) + 1
            if (bit := known.get((ch, n))) is None:
                h = (ord(ch) * 2654435761 + n * 3928791) % (1 << 32)
                h = (h ^ (h >> 15)) * 2246822519 % (1 << 32)
                bit = known[ch, n] = 1 << ((h ^ (h >> 13)) % 128)
            bits ^= bit
        out.append((bits & (1 << 64) - 1, bits >> 64))
    return np.array(out, dtype=np.uint64).reshape(-1, 2)


def _near(x: tuple, y: tuple | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the chunks x and y (within x if y is None) of names of a group whose letters and lengths allow a ratio of `least`; chunks are sorted by group and length."""
    runs: dict[str, list] = {}
    for g, n, a, b in (y or x)[3]:
        runs.setdefault(g, []).append((n, a, b))
    u, v = np.ascontiguousarray(x[2].T), np.ascontiguousarray((y or x)[2].T)
    for g, la, a0, a1 in x[3]:
        for lb, b0, b1 in runs.get(g, ()):
            if y is None and b1 <= a0 or min(la, lb) * (2 - least) < max(la, lb) * least - 1e-9:
                continue
            most = int((1 - least) * (la + lb) + 1e-9)  # letters that may stay unmatched
            for i in range(a0, a1, 64):
                one = u[0, i : min(i + 64, a1), None]
                for j in range(b0, b1, 2048):
                    near = np.flatnonzero((np.bitwise_count(one ^ v[0, j : min(j + 2048, b1)]) <= most).ravel())
                    p, q = np.divmod(near, min(2048, b1 - j))
                    p, q = p + i, q + j
                    ok = np.bitwise_count(u[0, p] ^ v[0, q]) + np.bitwise_count(u[1, p] ^ v[1, q]) <= most
                    if y is None:
                        ok &= p < q
                    if ok.any():
                        yield p[ok], q[ok]


#: Names that a chunk of similar_pairs() holds, at least and at most.
CHUNK = 4096, 32768


def similar_pairs(df: DataFrame, key: str, name: str, least: float = 0.85, within: str | None = None) -> DataFrame:
    """(a, b, na, nb, ratio) for keys a < b whose names, in lower case, match by `least` or more; within: only in the same group.

    Exact, and no pair is laid out that isn't returned. Names are numbered by group and length and dealt into chunks; chunks of a group whose lengths
    can match meet in a task. There 128 bits made of the letters rule out nearly all pairs: letters in only one of two names can't be matched, and each
    of them turns one bit. The rest are compared, many at once. Time grows with the square of the names of a group (about 10 ns for a pair of fitting lengths),
    shuffled bytes with the names times chunks.
    """
    own = df.select(F.col(key).alias("k"), F.lower(F.col(name)).alias("s"), (F.col(within).cast("string") if within else F.lit("")).alias("g")).where("s is not null and k is not null and g is not null")
    same = own.groupBy("s", "g").agg(F.min("k").alias("k")).where("length(s) > 0").withColumn("n", F.length("s"))  # equal names are compared once
    kind = dict(df.dtypes)[key]
    rows = cut_table(numbered(same, ["g", "n", "s"], "no"))
    size = min(CHUNK[1], max(CHUNK[0], rows.count() // 24))
    rows = rows.withColumn("c", F.floor((F.col("no") - 1) / size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        g, n = pdf["g"].to_numpy(), pdf["n"].to_numpy()
        at = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (g[1:] != g[:-1])])
        runs = [(g[i], int(n[i]), int(i), int(j)) for i, j in zip(at, [*at[1:], len(g)])]
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "chunk": [pickle.dumps((pdf["k"].to_numpy(), list(pdf["s"]), _signatures(list(pdf["s"])), runs))]})

    chunks = cut_table(rows.groupBy("c").applyInPandas(pack, "c long, chunk binary"))
    ends = cut_table(rows.groupBy("c").agg(F.min(F.struct("g", "n")).alias("first"), F.max(F.struct("g", "n")).alias("last")))
    x, y = ends.select(F.col("c").alias("ca"), F.col("last.g").alias("g"), F.col("last.n").alias("na")), ends.select(F.col("c").alias("cb"), F.col("first.g").alias("g"), F.col("first.n").alias("nb"))
    meet = x.join(y, "g").where("ca < cb").where(F.col("na") * (2 - least) >= F.col("nb") * least - 1e-9).select("ca", "cb").unionByName(ends.select(F.col("c").alias("ca"), F.col("c").alias("cb")))
    meet = cut_table(meet)  # a pair of numbers for each two chunks
    sent = chunks.join(meet, F.col("c") == F.col("ca")).unionByName(chunks.join(meet.where("ca < cb"), F.col("c") == F.col("cb")))
    spark = df.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in batches:
            for ca, cb, c, chunk in zip(pdf["ca"], pdf["cb"], pdf["c"], pdf["chunk"]):
                chunk = pickle.loads(chunk)
                if c == ca:
                    first = chunk
                    if ca < cb:
                        continue
                u, v = first, chunk if ca < cb else None
                held: list = []
                for near in _near(u, v, least):
                    held.append(near)
                    if sum(len(p) for p, _ in held) > 50_000:
                        yield judge(u, v or u, held)
                        held = []
                if held:
                    yield judge(u, v or u, held)

    def judge(u: tuple, v: tuple, held: list) -> pd.DataFrame:
        p, q = (np.concatenate(t) for t in zip(*held))
        a, b, na, nb = u[0][p], v[0][q], np.array(u[1], dtype=object)[p], np.array(v[1], dtype=object)[q]
        turn = a > b
        a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
        out = pd.DataFrame({"a": a, "b": b, "na": na, "nb": nb})
        out["ratio"] = 2.0 * matched(list(na), list(nb)) / (out["na"].str.len() + out["nb"].str.len())
        return out[out["ratio"] >= least - 1e-12]

    dealt = sent.repartition(tasks, "ca", "cb").sortWithinPartitions("ca", "cb", "c")
    return dealt.select("ca", "cb", "c", "chunk").mapInPandas(compare, f"a {kind}, b {kind}, na string, nb string, ratio double")


def greedy_keep(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items (key, rank) with kept: in rank order each is kept unless one kept before is similar (pairs a, b).

    Instead of one after another: an item with no open similar item before it is kept, those similar to it are dropped, and the pairs of both are done with; rounds end when no pair is left.
    """
    arcs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("a").alias("other")))).alias("x")).select("x.*")
    rank = items.select("key", "rank")
    before = cut_table(arcs.join(rank, "key").join(rank.select(F.col("key").alias("other"), F.col("rank").alias("r2")), "other").where("r2 < rank").select("key", "other"))
    dropped = None
    while not before.isEmpty():
        waits = before.select(F.col("key").alias("other")).distinct()
        hit = cut_table(before.join(waits, "other", "left_anti").select("key").distinct())
        before = cut_table(before.join(hit, "key", "left_anti").join(hit.withColumnRenamed("key", "other"), "other", "left_anti").select("key", "other"))
        dropped = hit if dropped is None else dropped.unionByName(hit)
    if dropped is None:
        return items.withColumn("kept", F.lit(True))
    return items.join(dropped.withColumn("_out", F.lit(True)), "key", "left").withColumn("kept", F.col("_out").isNull()).drop("_out")


def _chains(n: int, row: Callable[[int], np.ndarray], join: Callable[[int, int], None], threshold: float) -> np.ndarray:
    """Cluster number of each row by chains of nearest neighbours, merges up to threshold. row(i): distances of cluster i from all, infinite from itself and merged ones; join(i, j) puts j into i."""
    alive, parent, chain = np.ones(n, dtype=bool), np.arange(n), []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            d = row(i)
            j = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        merges.append((d[j], i, j))
        join(i, j)
        alive[j] = False

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v, i, j in merges:
        if v <= threshold:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], dtype=int)


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster number of each row: average linkage by chains of nearest neighbours, merges up to threshold."""
    d, size = distance.astype(float).copy(), np.ones(len(distance))
    np.fill_diagonal(d, np.inf)

    def join(i: int, j: int) -> None:
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]

    return _chains(len(d), lambda i: d[i], join, threshold)


def _far(x: np.ndarray, y: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of rows: 1 - product of unit vectors, or Euclidean."""
    p = x @ y.T
    return 1 - p if cosine else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * p, 0))


#: Rows up to which linked vectors get a matrix of their distances, and vectors compared with all others at a time.
DENSE, STRIP = 2000, 512


def linkage_of(x: np.ndarray, threshold: float, cosine: bool) -> np.ndarray:
    """As average_linkage() of the distances of all rows, which are never held at once.

    Clusters merge up to the threshold only if some two of their rows are that near, so each set of rows linked by such pairs is clustered on its own. In a
    large set, the mean cosine between clusters is the product of their sums of unit vectors; Euclidean distances are computed again where they are needed.
    """
    n = len(x)
    label = np.arange(n)
    for i in range(0, n, STRIP):
        a, b = np.nonzero(_far(x[i : i + STRIP], x[i:], cosine) <= threshold + 1e-9)
        a, b = a + i, b + i
        while True:
            p, q = label[a], label[b]
            if (p == q).all():
                break
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
    out = np.arange(n)
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(rows) > 1:
            y = x[rows]
            out[rows] = rows[average_linkage(_far(y, y, cosine), threshold) if len(rows) <= DENSE else _wide_linkage(y, threshold, cosine)]
    return out


def _wide_linkage(x: np.ndarray, threshold: float, cosine: bool) -> np.ndarray:
    n = len(x)
    total, size, of = x.copy(), np.ones(n), np.arange(n)

    def row(i: int) -> np.ndarray:
        if cosine:
            d = 1 - (total @ total[i]) / np.maximum(size * size[i], 1)
        else:
            own, d = np.flatnonzero(of == i), np.zeros(n)
            for k in range(0, len(own), STRIP):
                d += np.bincount(of, _far(x[own[k : k + STRIP]], x, False).sum(0), n)
            d /= np.maximum(size * size[i], 1)
        d[size == 0] = np.inf
        d[i] = np.inf
        return d

    def join(i: int, j: int) -> None:
        total[i] += total[j]
        size[i] += size[j]
        size[j] = 0
        of[of == j] = i

    return _chains(n, row, join, threshold)


#: Rows that one block may have; None: any number. A larger block is an error, never a sample.
MOST_IN_BLOCK: int | None = None


def cluster(df: DataFrame, key: str, vector: str, block: str, similarity: float = 0.85, metric: str = "cosine") -> DataFrame:
    """key, block, cluster (smallest key in it): average-linkage clusters of the vectors of each block, cut at 1 - similarity.

    metric 'cosine' takes distances 1 - cosine; 'rowwise_euclidean' takes Euclidean distances between the rows of that matrix. A block is one task, whose
    memory grows with its rows and whose time grows with their square.
    """
    if metric not in ("cosine", "rowwise_euclidean"):
        raise ValueError(metric)
    rows = df.select(F.col(key).alias("k"), F.col(block).alias("g"), F.col(vector).alias("v")).where("k is not null and v is not null")
    big = rows.groupBy("g").agg(F.count("*").alias("n")).where(f"n > {MOST_IN_BLOCK}").orderBy("g").limit(1).collect() if MOST_IN_BLOCK is not None else []
    if big:
        raise ValueError(f"block {big[0]['g']} has {big[0]['n']} rows; at most {MOST_IN_BLOCK} can be clustered")
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if metric == "rowwise_euclidean":  # two rows of that matrix differ by x'(a - b), so by the length of a - b under x'x
            w, u = np.linalg.eigh(x.T @ x)
            x = x @ (u * np.sqrt(np.maximum(w, 0)))
        label = linkage_of(x, 1 - similarity, metric == "cosine")
        return pd.DataFrame({"k": pdf["k"], "g": pdf["g"], "c": pdf["k"].to_numpy()[label]})

    out = rows.groupBy("g").applyInPandas(one, f"k {kinds[key]}, g {kinds[block]}, c {kinds[key]}")
    return out.select(F.col("k").alias(key), F.col("g").alias(block), F.col("c").alias("cluster"))


def representatives(members: DataFrame, concepts: DataFrame) -> DataFrame:
    """entity, representative: the most important concept of each cluster, the first by ord of ties. members: entity, cluster."""
    m = members.join(concepts.select("entity", "importance", "ord"), "entity")
    best = m.groupBy("cluster").agg(F.max_by("entity", F.struct("importance", -F.col("ord"))).alias("representative"))
    return m.select("entity", "cluster").distinct().join(best, "cluster").select("entity", "representative")


def merge_candidates(concepts: DataFrame, least: float = 0.85, synonyms: dict = V.SYNONYMS) -> DataFrame:
    """Pairs of concepts (entity, category, ord) that should be one: entity1, entity2, keep, category, confidence, rule.

    contains: one name (of at least 3 characters) is a part of the other, categories alike or one of them 其他; found by a join of the
    whole name on the runs of characters of its length. similar: names match by more than `least` in one category. synonym: a known rule.
    """
    c = cut(concepts.where("entity is not null").select("ord", "entity", F.coalesce("category", F.lit(V.OTHER_CATEGORY)).alias("category"), F.lower("entity").alias("s")))
    other = F.lit(V.OTHER_CATEGORY)
    sizes = [r[0] for r in c.where("length(s) >= 3").select(F.length("s")).distinct().orderBy(F.length("s")).collect()]  # lengths of names: a few hundred numbers at most
    inside = c.select(F.col("ord").alias("o2"), F.col("entity").alias("e2"), F.col("category").alias("c2"), F.col("s").alias("s2"))
    runs = inside.withColumn("n", F.explode(F.array(*map(F.lit, sizes or [0])))).where("n <= length(s2) and n > 0")
    runs = runs.withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.length("s2") - F.col("n") + 1), lambda i: F.substring(F.col("s2"), i, F.col("n"))))).distinct()
    hit = c.where("length(s) >= 3").join(runs, "s").where("ord <> o2")
    hit = hit.where((F.length("s") < F.length("s2")) | (F.col("ord") < F.col("o2"))).where((F.col("category") == F.col("c2")) | (F.col("category") == other) | (F.col("c2") == other))
    first = F.col("ord") < F.col("o2")
    contains = hit.select(
        F.when(first, F.col("entity")).otherwise(F.col("e2")).alias("entity1"), F.when(first, F.col("e2")).otherwise(F.col("entity")).alias("entity2"), F.col("e2").alias("keep"),
        F.when(first, F.when(F.col("category") != other, F.col("category")).otherwise(F.col("c2"))).otherwise(F.when(F.col("c2") != other, F.col("c2")).otherwise(F.col("category"))).alias("category"),
        F.lit(0.9).alias("confidence"), F.lit("contains").alias("rule"),
    )
    p = similar_pairs(c, "ord", "entity", least, within="category").where(F.col("ratio") > least)
    e = c.select("ord", "entity", "category")
    j = p.join(e.select(F.col("ord").alias("a"), F.col("entity").alias("entity1"), "category"), "a").join(e.select(F.col("ord").alias("b"), F.col("entity").alias("entity2")), "b")
    similar = j.select("entity1", "entity2", F.when(F.length("entity1") >= F.length("entity2"), F.col("entity1")).otherwise(F.col("entity2")).alias("keep"), "category", F.round("ratio", 6).alias("confidence"), F.lit("similar").alias("rule"))
    rules = F.broadcast(concepts.sparkSession.createDataFrame([(k, s.lower()) for k, ss in synonyms.items() for s in ss], "k string, v string"))
    x = rules.join(c.select(F.col("s").alias("k"), F.col("entity").alias("entity1"), F.col("category").alias("c1")), "k").join(c.select(F.col("s").alias("v"), F.col("entity").alias("entity2"), F.col("category").alias("c2")), "v")
    known = x.select("entity1", "entity2", F.col("entity1").alias("keep"), F.when(F.col("c1") != other, F.col("c1")).otherwise(F.col("c2")).alias("category"), F.lit(1.0).alias("confidence"), F.lit("synonym").alias("rule"))
    return contains.unionByName(similar).unionByName(known)


def merge_mapping(candidates: DataFrame, least: float = 0.95) -> DataFrame:
    """name, canonical from the accepted candidates: each dropped name goes to what it was merged into first (highest confidence, then name), chains to their
    end; names merged into each other in a circle go to the smallest of the circle, which stays."""
    drop = F.when(F.col("keep") == F.col("entity2"), F.col("entity1")).otherwise(F.col("entity2"))
    m = candidates.where(F.col("confidence") >= least).select(drop.alias("name"), F.col("keep").alias("canonical"), "confidence").where("name <> canonical")
    m = cut_table(m.groupBy("name").agg(F.min_by("canonical", F.struct(-F.col("confidence"), "canonical")).alias("canonical")).withColumn("low", F.col("name")))
    up = lambda: m.select(F.col("name").alias("canonical"), F.col("canonical").alias("next"), F.col("low").alias("low2"))
    steps = 1  # each round doubles the length of chain followed; low is the smallest name on it
    while True:
        on = F.col("next").isNotNull()
        m = cut_table(m.join(up(), "canonical", "left").select("name", F.coalesce("next", "canonical").alias("canonical"), F.least("low", "low2").alias("low"), on.alias("moved")))
        open_ = m.where("moved").count()
        if open_ <= steps:  # a chain without end of more steps would have left more of its names open, so those that still move go round in circles
            break
        steps *= 2
    end = m.join(up(), "canonical", "left").select("name", F.when(F.col("next").isNotNull(), F.col("low2")).otherwise(F.col("canonical")).alias("canonical"))
    return end.where("name <> canonical")


def nearest_entity(text: Column, pronoun: str, entities: Column, default: str, window: int = 200) -> Column:
    """What a pronoun stands for: the entity that begins last in the window before its first occurrence, the first listed of ties, else default; null if the pronoun doesn't occur."""
    at = F.instr(text, pronoun)
    start = F.greatest(at - 1 - window, F.lit(0))
    before = F.substring(text, start + 1, at - 1 - start)
    last = lambda e: F.length(before) - F.length(e) - F.instr(F.reverse(before), F.reverse(e)) + 1
    found = F.filter(F.transform(entities, lambda e, i: F.struct(F.when(F.instr(before, e) > 0, last(e)).alias("p"), (-i).alias("i"), e.alias("e"))), lambda x: x.p.isNotNull())
    return F.when(at > 0, F.coalesce(F.array_max(found).e, F.lit(default)))


def replace_pronoun(text: Column, pronoun: str, entity: Column) -> Column:
    """The pronoun replaced where it stands as a word of its own; characters of Chinese words count as letters, so it must stand free of them."""
    return F.regexp_replace(text, F.lit(rf"(?U)\b{pronoun}\b"), F.regexp_replace(F.coalesce(entity, F.lit(pronoun)), r"([\\$])", r"\\$1"))


def _by_length(no: np.ndarray, names: np.ndarray, bits: np.ndarray) -> tuple:
    """A chunk as _near() takes it, of names of one group."""
    n = np.array([len(s) for s in names], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    n = n[order]
    at = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else []
    return no[order], names[order], bits[order], [("", int(n[i]), int(i), int(j)) for i, j in zip(at, [*at[1:], len(n)])]


def _alike(x: tuple, y: tuple | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers a < b of names in the chunks x and y (within x if y is None) that match by `least`, the name of the smaller number taken first."""

    def judge() -> tuple[np.ndarray, np.ndarray]:
        p, q = (np.concatenate(t) for t in zip(*held))
        a, b, na, nb = x[0][p], (y or x)[0][q], x[1][p], (y or x)[1][q]
        turn = a > b
        a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
        both = np.array([len(s) + len(t) for s, t in zip(na, nb)])
        ok = 2.0 * matched(list(na), list(nb)) / both >= least - 1e-12
        return a[ok], b[ok]

    held: list = []
    for near in _near(x, y, least):
        held.append(near)
        if sum(len(p) for p, _ in held) > 50_000:
            yield judge()
            held = []
    if held:
        yield judge()


def _seeds_of(names: np.ndarray, least: float) -> np.ndarray:
    """Place of the seed of each name: the first seed before it that it matches, else its own. A few names at a time meet the seeds so far, then each other."""
    bits, of, seeds = _signatures(list(names)), np.arange(len(names)), np.zeros(0, dtype=np.int64)
    chunk = lambda at: _by_length(at, names[at], bits[at])
    start, step = 0, 64
    while start < len(names):
        own = np.arange(start, min(start + step, len(names)))
        for a, b in _alike(chunk(seeds), chunk(own), least):
            np.minimum.at(of, b, a)
        rest = own[of[own] == own]
        before: dict[int, list[int]] = {}
        for a, b in _alike(chunk(rest), None, least):
            for i, j in zip(a.tolist(), b.tolist()):
                before.setdefault(j, []).append(i)
        for j in sorted(before):
            of[j] = min((i for i in before[j] if of[i] == i), default=j)
        seeds = np.r_[seeds, rest[of[rest] == rest]]
        start, step = start + step, min(2 * step, 512)
    return of


#: Names of a group among which seeds are chosen in one task, in the first round and at most; names that look for a seed together.
SEEDED, LOOKING = (4096, 32768), 4096


def _seeds(rows: DataFrame, least: float) -> DataFrame:
    """no, seed for rows (no, g, s): the number of the first seed that a name matches, by number within a group.

    In each round one task chooses the seeds among the first names of a group; the other names of the group, which all come later, look for the first of these seeds that
    they match, in chunks; those that find none go on to the next round. So names are compared with seeds, and nothing is laid out but a row a name.
    """
    spark = rows.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        of = _seeds_of(pdf["s"].to_numpy(dtype=object), least)
        no = pdf["no"].to_numpy()
        return pd.DataFrame({"g": pdf["g"], "no": no, "seed": no[of], "s": pdf["s"].where(of == np.arange(len(of)), None)})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["s"].to_numpy(dtype=object)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "names": [pickle.dumps((pdf["no"].to_numpy(), list(names)))]})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunk(packed: bytes) -> tuple:
            no, names = pickle.loads(packed)
            return _by_length(no, np.array(names, dtype=object), _signatures(names))

        for pdf in batches:
            for g, names, seeds in zip(pdf["g"], pdf["names"], pdf["seeds"]):
                x, y = chunk(seeds), chunk(names)
                order = np.argsort(y[0])
                no, s = y[0][order], y[1][order]
                found = no.copy()
                for a, b in _alike(x, y, least):
                    np.minimum.at(found, np.searchsorted(no, b), a)
                none = pd.Series(found == no)
                yield pd.DataFrame({"g": g, "no": no, "seed": pd.Series(found, dtype="Int64").mask(none), "s": pd.Series(s, dtype=object).where(none, None)})

    left, out, most = rows.select("g", "no", "s"), None, SEEDED[0]
    while True:
        first = left.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("no"))).where(F.col("r") <= most).select("g", "no", "s")
        chosen = cut_table(first.groupBy("g").applyInPandas(choose, "g string, no long, seed long, s string"))
        done = chosen.select("no", "seed")
        later = left.join(chosen.groupBy("g").agg(F.max("no").alias("last")), "g").where("no > last").select("g", "no", "s")
        seeds = chosen.where("s is not null").select("g", "no", "s").groupBy("g").applyInPandas(pack, "g string, names binary").withColumnRenamed("names", "seeds")
        names = later.withColumn("c", F.floor(F.col("no") / LOOKING)).groupBy("g", "c").applyInPandas(pack, "g string, names binary")
        met = names.join(seeds, "g").repartition(tasks).select("g", "names", "seeds")
        looked = cut_table(met.mapInPandas(look, "g string, no long, seed long, s string"))
        done = done.unionByName(looked.where("seed is not null").select("no", "seed"))
        out = done if out is None else out.unionByName(done)
        left, most = looked.where("seed is null").select("g", "no", "s"), min(2 * most, SEEDED[1])
        if left.isEmpty():
            return out


def seed_clusters(df: DataFrame, key: str, name: str, group: str, least: float = 0.85) -> DataFrame:
    """key, seed, representative: in key order within a group, a name similar to no earlier seed is a seed; others join their first similar seed. The
    shortest name of a cluster (the first of ties) represents it."""
    own = df.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(group).cast("string").alias("g")).where("key is not null and name is not null and g is not null")
    low = cut_table(own.select("key", "name", "g", F.lower("name").alias("s")))
    first = cut_table(numbered(low.groupBy("s", "g").agg(F.min("key").alias("head")), ["g", "head"], "no"))  # equal names are compared once, by the smallest key
    at = _seeds(first, least).join(first.select("no", "s", "g"), "no").join(first.select(F.col("no").alias("seed"), F.col("head").alias("_seed")), "seed")
    member = low.join(at.select("s", "g", F.col("_seed").alias("seed")), ["s", "g"])
    best = member.groupBy("seed").agg(F.min_by("name", F.struct(F.length("name"), "key")).alias("representative"))
    return member.join(best, "seed").select(F.col("key").alias(key), "seed", "representative")


#: Aliases are a list that people keep; more are an error.
MOST_ALIASES = 5000


def alias_normalise(df: DataFrame, name: str, aliases: dict[str, tuple[str, ...]] = V.ALIASES, least: float = 0.9) -> DataFrame:
    """name, standard for every different name: the standard name of the equal alias (without case), else of the first alias that matches by `least`, else the name."""
    table: dict[str, str] = {}
    for standard, names in aliases.items():
        for x in (standard, *names):
            table.setdefault(x.lower(), standard)
    if len(table) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    shared = df.sparkSession.sparkContext.broadcast(table)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            out = []
            for x in pdf["name"]:
                s = x.strip().lower()
                got = known.get(s)
                if got is None:
                    m = SequenceMatcher(None)
                    m.set_seq2(s)
                    for a, standard in known.items():
                        if min(len(a), len(s)) * (2 - least) >= max(len(a), len(s)) * least:
                            m.set_seq1(a)
                            if m.quick_ratio() >= least and ratio(s, a) >= least:
                                got = standard
                                break
                out.append(x if got is None else got)
            yield pdf.assign(standard=out)

    names = df.select(F.col(name).alias("name")).where("name is not null").distinct()
    return names.mapInPandas(match, "name string, standard string")


def link_entities(entities: DataFrame, edges: DataFrame, standard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, type) under their standard names (name, standard), each (name, type) once as first seen and numbered anew from 1, and edges
    (head, relation, tail, ord) rewritten and each once as first seen."""
    from boscograph.operators.relations import numbered

    std = standard.select(F.col("name").alias("_n"), "standard")
    e = entities.join(std, F.col("name") == F.col("_n"), "left").select("id", F.coalesce("standard", "name").alias("name"), "type")
    once = e.groupBy("name", "type").agg(F.min("id").alias("first"))
    for end in ("head", "tail"):
        edges = edges.join(std, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("standard", end)).drop("_n", "standard")
    rel = edges.groupBy("head", "relation", "tail").agg(F.min("ord").alias("ord"))
    return numbered(once, ["first", "type"], "id").select("id", "name", "type"), rel


def link_kb(entities: DataFrame, kb: DataFrame | None) -> DataFrame:
    """Entities (name, ...) with kb_id of a knowledge base (name, id), null where it holds none or is missing; the smallest id of a name."""
    if kb is None:
        return entities.withColumn("kb_id", F.lit(None).cast("string"))
    ids = kb.where("name is not null").groupBy(F.col("name").alias("_n")).agg(F.min(F.col("id").cast("string")).alias("kb_id"))
    return entities.join(ids, entities["name"] == F.col("_n"), "left").drop("_n")


def link_flow(entities: DataFrame, edges: DataFrame, standard: DataFrame, weight: dict[str, int] = V.TYPE_WEIGHT, kb: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Standard names, ids, and importance of entities in one go: (id, name, type, importance, kb_id) and the rewritten edges.

    importance is the number of the name's rewritten edges plus the weight of its type (1 for others).
    """
    from boscograph.operators.relations import mapped

    linked, rel = link_entities(entities, edges, standard)
    ends = rel.select(F.explode(F.array("head", "tail")).alias("_e")).groupBy("_e").agg(F.count("*").alias("_k"))
    scored = linked.join(ends, linked["name"] == F.col("_e"), "left")
    score = F.coalesce("_k", F.lit(0)) + mapped(F.lower("type"), {k.lower(): v for k, v in weight.items()}, F.lit(1))
    return link_kb(scored.select("id", "name", "type", score.cast("long").alias("importance")), kb), rel
