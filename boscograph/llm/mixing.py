"""Mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.functions.text import fold, n_tokens

#: A table of targets is a setting, not data; more rows than this are an error.
MOST_SOURCES = 100_000


def _cut_points(mean: float, most: int) -> list[float]:
    """P(copies <= j) for j < most, where copies = min(Poisson(m), most) and m is such that their mean is `mean`.

    A mean of most or more can't be had by a Poisson number and gives most copies of each; a mean of 0 none.
    """
    if mean >= most:
        return [0.0] * most
    if mean <= 0:
        return [1.0] * most

    def below(m: float) -> list[float]:
        p, s, out = math.exp(-m), 0.0, []
        for j in range(most):
            s += p
            out.append(min(1.0, s))
            p *= m / (j + 1)
        return out

    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if most - sum(below(mid)) < mean else (low, mid)
    return below((low + high) / 2)


class Mix:
    """Records of the sources in targets, each source repeated to its share of the total size.

    Sources are compared folded. targets has source, target_share and max_repeats; several rows of one source add their shares
    and take the larger max_repeats; a null share counts as 0, a null max_repeats as 1, a row without source is ignored. Records
    of other sources, or of none, take no part; null and empty texts have size 0 and are drawn like the rest of their source.
    total is the size to make, by default that of all records taking part. An empty table on either side gives empty results
    (without records every source with a positive share falls short of a total of 0 by nothing, so none is short).

    Copies of a record: the hash of (seed, key, text) as a number in [0, 1) is put through the inverse of the distribution of
    min(Poisson(m), max_repeats), m being set so that its mean is the rate that the source needs. Repeated rows with the same key and
    text are drawn alike. Only one group-by of tokens per source precedes the drawing; the cut points of a few sources travel to the tasks as
    literals in a broadcast table of at most MOST_SOURCES rows.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, key: str, source: str, text: str, total: int | None = None, seed: int = 42):
        self.spark, self.key, self.seed = df.sparkSession, key, seed
        t = targets.select(fold(F.col("source")).alias("s"), F.coalesce("target_share", F.lit(0.0)).cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("most")).where("s is not null")
        wanted = t.groupBy("s").agg(F.sum("share").alias("share"), F.max("most").alias("most"))
        rows = wanted.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
        names = self.spark.createDataFrame([(r["s"],) for r in rows], "s string")
        self.records = df.select(F.col(key).alias("k"), fold(F.col(source)).alias("s"), n_tokens(F.col(text)).alias("n"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
        have = {r["s"]: (r["n"], r["c"]) for r in self.records.join(F.broadcast(names), "s", "left_semi").groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
        self.total = sum(n for n, _ in have.values())
        make = self.make = self.total if total is None else total
        plan = []
        for r in sorted(rows, key=lambda r: r["s"]):
            n, c = have.get(r["s"], (0, 0))
            rate = r["share"] * make / n if n else 0.0
            plan.append((r["s"], r["share"], r["most"], c, n, rate, r["most"] * n < r["share"] * make, _cut_points(rate, max(0, r["most"]))))
        self.plan = self.spark.createDataFrame(plan, "s string, share double, most int, c long, n long, rate double, short boolean, cuts array<double>")

    def drawn(self) -> DataFrame:
        """k, s, n, h and copies of each record that is drawn at least once."""
        unit = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
        cuts = F.broadcast(self.plan.select("s", "cuts"))
        return self.records.join(cuts, "s").select("k", "s", "n", "h", F.size(F.filter("cuts", lambda c: unit >= c)).alias("copies")).where("copies > 0")

    def sample(self) -> DataFrame:
        """One row per copy in a globally shuffled order: place (a random number that is the sort key), key, copy_no, source, n_tokens."""
        each = self.drawn().withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        each = each.select(F.xxhash64(F.lit(self.seed + 1), "h", "copy_no").alias("place"), F.col("k").alias(self.key), "copy_no", F.col("s").alias("source"), F.col("n").alias("n_tokens"))
        return each.orderBy("place", self.key, "copy_no")

    def report(self) -> DataFrame:
        """One row per source of the targets: what it had, what it was to give and what it gave; short if its repeats can't suffice."""
        got = self.drawn().groupBy("s").agg(F.sum(F.col("n") * F.col("copies")).alias("sampled_tokens"), F.max("copies").alias("most_copies"))
        total = F.sum("sampled_tokens").over(W.partitionBy())  # over one row per source
        return (
            self.plan.join(got, "s", "left").withColumn("all_tokens", total)
            .select(F.col("s").alias("source"), F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), F.col("c").alias("documents"), F.col("n").alias("tokens"), F.col("rate").alias("wanted_repeats"),
                    F.coalesce("sampled_tokens", F.lit(0)).alias("sampled_tokens"), F.coalesce(F.col("sampled_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "short")
        )

    def fell_short(self) -> DataFrame:
        """Sources whose part of the sample is below their share of the total although each of their records was drawn as often as allowed, by the copies of the sample; a source without records counts."""
        got = self.sample().groupBy("source").agg(F.sum("n_tokens").alias("sampled"), F.count("*").alias("copies"))
        each = self.plan.withColumnRenamed("s", "source").join(got, "source", "left")
        all_drawn = F.coalesce("copies", F.lit(0)) == F.greatest("most", F.lit(0)) * F.col("c")
        return each.where(all_drawn & (F.coalesce("sampled", F.lit(0)) < F.col("share") * F.lit(self.make))).select("source")
