"""Alike names found in chunks, compared many at once."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from boscograph.operators import resolve
from boscograph.session import checkpoint_dir


def words(rng, letters, most, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_matched_counts_as_sequence_matcher():
    rng = random.Random(4)
    for letters, most in (("ab", 9), ("abcd 松材", 30), ("abc", 260)):
        a, b = words(rng, letters, most, 300), words(rng, letters, most, 300)
        a, b = [*a, "x\0", "same"], [*b, "\0x", "same"]
        got = resolve.matched(a, b)
        assert [2 * n / (len(x) + len(y)) if x or y else 1.0 for x, y, n in zip(a, b, got.tolist())] == [resolve.ratio(x, y) for x, y in zip(a, b)]


def test_pairs_across_chunks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CHUNK", (9, 9))
    rng = random.Random(6)
    names = [(i, w, rng.choice("gh")) for i, w in enumerate(dict.fromkeys(words(rng, "abc", 11, 150)))]
    rng.shuffle(names)
    df = spark.createDataFrame(names, "k long, s string, g string")
    for within in (None, "g"):
        got = {(r.a, r.b): r.ratio for r in resolve.similar_pairs(df, "k", "s", 0.8, within).collect()}
        true = {}
        for i, a, g in names:
            for j, b, h in names:
                if i < j and a and b and (within is None or g == h) and resolve.ratio(a, b) >= 0.8:
                    true[i, j] = resolve.ratio(a, b)
        assert got == true


def test_nothing_is_laid_out_but_pairs(spark):
    names = spark.range(600).select("id", F.concat(F.lit("plot "), F.substring(F.sha1(F.col("id").cast("string")), 1, 8), F.lit(" resin sample")).alias("s"))
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    resolve.similar_pairs(names, "id", "s").collect()
    assert size() - before < 200_000


def written(spark, work):
    """Bytes that work() leaves in the folder for cut lineage."""
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    work()
    return size() - before


def test_pairs_that_are_done_with_are_not_written_again(spark):
    items = spark.range(300).select(F.col("id").alias("key"), F.col("id").alias("rank"))
    pairs = items.select(F.col("key").alias("a")).crossJoin(items.select(F.col("key").alias("b"))).where("a < b")
    assert written(spark, lambda: resolve.greedy_keep(items, pairs).collect()) < 400_000
    assert [r.key for r in resolve.greedy_keep(items, pairs).where("kept").collect()] == [0]


def test_seeds_write_little(spark):
    names = spark.range(600).select("id", F.concat(F.lit("plot "), F.substring(F.sha1(F.col("id").cast("string")), 1, 8), F.lit(" resin sample")).alias("s"), F.lit("g").alias("g"))
    assert written(spark, lambda: resolve.seed_clusters(names, "id", "s", "g").collect()) < 400_000


def test_seeds_in_rounds_equal_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(resolve, "SEEDED", (5, 20))
    monkeypatch.setattr(resolve, "LOOKING", 4)
    rng = random.Random(9)
    names = [(i, w, rng.choice("gh")) for i, w in enumerate(["", *words(rng, "abc", 9, 90)])]
    true, seeds = {}, []
    for i, w, g in names:
        true[i] = next((j for j, v, h in seeds if h == g and (v == w or resolve.ratio(v, w) >= 0.8)), i)
        if true[i] == i:
            seeds.append((i, w, g))
    rng.shuffle(names)
    got = {r.k: r.seed for r in resolve.seed_clusters(spark.createDataFrame(names, "k int, s string, g string"), "k", "s", "g", 0.8).collect()}
    assert got == true and len(seeds) > 25


def test_seeds_lay_out_no_pairs(spark):
    names = lambda n: spark.range(n).select("id", F.concat(F.lit("plot "), F.substring(F.sha1(F.col("id").cast("string")), 1, 4), F.lit(" resin sample")).alias("s"), F.lit("g").alias("g"))
    few, many = (written(spark, lambda: resolve.seed_clusters(names(n), "id", "s", "g", 0.8).collect()) for n in (500, 2000))
    assert many < 6 * few
