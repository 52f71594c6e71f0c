"""Items that appear together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.session import cut, cut_table

#: Items with this share of all incidences or more are heavy; there are at most 1 / share of them.
HEAVY_SHARE = 1 / 4096
#: Records laid into one bit matrix.
BLOCK = 1 << 17
#: Records with more items than this are large; pairs of light items in them aren't laid out.
LARGE = 1000
#: Large records of one piece of an item's list.
PIECE = 4096


def _words(n: int) -> int:
    return -(-n // 64)


def _popcounts(row: np.ndarray, item: np.ndarray, n_rows: int, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, records of both) of the pairs x < y of items that meet, from a bit per item and record."""
    bits = np.zeros((n_items, _words(n_rows)), dtype=np.uint64)
    np.bitwise_or.at(bits, (item, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
    xs, ys, ns = [], [], []
    for x in range(n_items - 1):
        n = np.zeros(n_items - 1 - x, dtype=np.int64)
        for a in range(0, bits.shape[1], 512):  # in strips that stay in the cache
            n += np.bitwise_count(bits[x + 1 :, a : a + 512] & bits[x, a : a + 512]).sum(axis=1, dtype=np.int64)
        met = np.flatnonzero(n)
        xs.append(np.full(len(met), x))
        ys.append(met + x + 1)
        ns.append(n[met])
    return (np.concatenate(xs), np.concatenate(ys), np.concatenate(ns)) if xs else (np.array([], int),) * 3


def together(df: DataFrame, record: str, item: str, least: int = 8, least_lift: int = 8) -> DataFrame:
    """Pairs item_a < item_b with at least `least` records together and at least least_lift times the number expected by chance.

    Columns: item_a, item_b, n_together, n_a, n_b, n_records, lift. A row of df says that the item (a string) is in the record; rows with a
    null on either side don't count, repeated rows count once, and an empty table gives an empty one. Records are those with an item.

    Items in fewer than `least` records, or in more than a share 1 / least_lift of all, can't be in such a pair and are left out (exact).
    Heavy items, at most 4096 by the definition of HEAVY_SHARE, are laid into bit matrices, one per block of records chosen by hash,
    and their pairs counted by popcount; a block's size doesn't depend on how large a record is. Pairs with a light item are counted by a
    join on the record and a group-by: light with light, and light with the heavy ones of its records. In a large record that would lay
    out all pairs of its items; there each item keeps the list of its large records instead, in pieces by ranges of records. Pairs that also meet elsewhere add what
    the light item's pieces share with the other's of the same ranges, and those that meet in large records only are found by the rarest of these (all but the least - 1 largest ones of an
    item; two items that share `least` large records share one of those).
    """
    spark = df.sparkSession
    rows = df.select(F.col(record).alias("r"), F.col(item).alias("item")).where("r is not null and item is not null")
    for seed in range(16):  # a number for each record; tried again should two records ever get the same one
        count = rows.select("r").distinct().agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("r", F.lit(seed))).alias("h")).first()
        if count["n"] == count["h"]:
            break
    else:
        raise RuntimeError("no hash tells the records apart")
    n_records = count["n"]
    inc = cut_table(rows.select(F.xxhash64("r", F.lit(seed)).alias("h"), "item").distinct())
    n_inc = inc.count()
    items = inc.groupBy("item").agg(F.count("*").alias("c")).where((F.col("c") >= least) & (F.col("c") * least_lift <= n_records))
    items = cut(items.select(F.monotonically_increasing_id().alias("id"), "item", "c"))
    heavy = [r["id"] for r in items.where(F.col("c") >= max(least, n_inc * HEAVY_SHARE)).select("id").orderBy("id").collect()]
    code = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(heavy)], "id long, code int"))
    own = cut_table(inc.join(items, "item").select("h", "id", "c").join(code, "id", "left"))

    # Heavy with heavy.
    blocks = max(1, -(-n_records // BLOCK))
    if blocks < 2 * spark.sparkContext.defaultParallelism:  # smaller ones, so that all cores have one; not under an eighth
        blocks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-8 * n_records // BLOCK)))
    n_heavy = len(heavy)

    def count_block(pdf: pd.DataFrame) -> pd.DataFrame:
        code_of, row = np.unique(pdf["h"].to_numpy(), return_inverse=True)
        x, y, n = _popcounts(row, pdf["code"].to_numpy(), len(code_of), n_heavy)
        return pd.DataFrame({"x": x.astype(np.int32), "y": y.astype(np.int32), "n": n})

    dense = own.where("code is not null").select(F.pmod("h", F.lit(blocks)).cast("int").alias("block"), "h", "code").groupBy("block").applyInPandas(count_block, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    dense = dense.join(code.select(F.col("code").alias("x"), F.col("id").alias("a")), "x").join(code.select(F.col("code").alias("y"), F.col("id").alias("b")), "y").select("a", "b", "n")

    # Pairs with a light item.
    large = cut(own.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > LARGE))
    any_large = not large.isEmpty()
    small = own.join(large, "h", "left_anti") if any_large else own
    light = small.where("code is null").select("h", F.col("id").alias("a"))
    other = small.select("h", F.col("id").alias("b"), F.col("code").isNotNull().alias("heavy"))
    met = light.join(other, "h").where("heavy or a < b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    if any_large:
        inside = cut_table(own.join(large, "h").select("id", "h", "size", F.col("code").isNotNull().alias("heavy")))
        # Lists of an item's large records, in pieces of a range of records each, so that none is long and only those that a pair shares a range of are read.
        ranges = -(-large.count() // PIECE)
        pieces = inside.groupBy("id", F.pmod("h", F.lit(ranges)).alias("part")).agg(F.collect_list("h").alias("l"))
        last = inside.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("size"), F.desc("h")))).where(F.col("n") < least).select("id", "h")
        first = inside.join(last, ["id", "h"], "left_anti")
        lone = first.where("not heavy").select("h", F.col("id").alias("a")).join(first.select("h", F.col("id").alias("b"), "heavy"), "h").where("heavy or a < b")
        lone = lone.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("n", F.lit(0).cast("long"))
        met = cut_table(met.unionByName(lone).groupBy("a", "b").agg(F.sum("n").alias("n")))
        probing = met.join(code.select(F.col("id").alias("a"), F.lit(True).alias("heavy")), "a", "left").select("a", "b", F.when(F.col("heavy"), F.col("b")).otherwise(F.col("a")).alias("p"), F.when(F.col("heavy"), F.col("a")).otherwise(F.col("b")).alias("o"))
        probed = probing.join(pieces.select(F.col("id").alias("p"), "part", F.col("l").alias("lp")), "p").join(pieces.select(F.col("id").alias("o"), "part", F.col("l").alias("lo")), ["o", "part"])
        shared = probed.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("lp", "lo"))).alias("s"))
        met = met.join(shared, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("s", F.lit(0))).alias("n"))

    found = dense.unionByName(met).where(F.col("n") >= least)
    name = items.select("id", "item", "c")
    found = found.join(name.select(F.col("id").alias("a"), F.col("item").alias("ia"), F.col("c").alias("ca")), "a").join(name.select(F.col("id").alias("b"), F.col("item").alias("ib"), F.col("c").alias("cb")), "b")
    found = found.where(F.col("n").cast("decimal(19,0)") * F.lit(n_records).cast("decimal(19,0)") >= F.lit(least_lift).cast("decimal(5,0)") * (F.col("ca").cast("decimal(15,0)") * F.col("cb").cast("decimal(15,0)")))
    first_is_a = F.col("ia") < F.col("ib")
    return found.select(
        F.least("ia", "ib").alias("item_a"), F.greatest("ia", "ib").alias("item_b"), F.col("n").alias("n_together"), F.when(first_is_a, F.col("ca")).otherwise(F.col("cb")).alias("n_a"),
        F.when(first_is_a, F.col("cb")).otherwise(F.col("ca")).alias("n_b"), F.lit(n_records).cast("long").alias("n_records"), (F.col("n") * F.lit(float(n_records)) / F.col("ca") / F.col("cb")).alias("lift"),
    )
