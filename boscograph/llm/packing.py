"""Filling fixed-capacity containers with items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscograph.functions.text import n_tokens


class OpenBins:
    """Open bins by remaining capacity: a segment tree over 0..capacity counts them, a stack per capacity holds them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        count, at = self.count, room + self.leaves
        while at:
            count[at] += by
            at >>= 1

    def put(self, room: int, bin_no: int) -> None:
        self.stacks[room].append(bin_no)
        self._add(room, 1)

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity of at least size, or -1."""
        count, leaves, at = self.count, self.leaves, size + self.leaves
        if count[at]:
            return size
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < leaves:
                    at <<= 1
                    if not count[at]:
                        at += 1
                return at - leaves
            at >>= 1
        return -1

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.stacks[room].pop()


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, sizes being in falling order and none over capacity."""
    bins, out, opened = OpenBins(capacity), [], 0
    for size in sizes:
        room = bins.tightest(size)
        if room < 0:
            room, bin_no, opened = capacity, opened, opened + 1
        else:
            bin_no = bins.take(room)
        if room > size:
            bins.put(room - size, bin_no)
        out.append(bin_no)
    return out


def pack(df: DataFrame, key: str, text: str, capacity: int = 8192, shard_rows: int = 65536) -> DataFrame:
    """Items of df laid into containers of capacity tokens: container, key, start, n_tokens, n_pieces.

    An item over the capacity is cut into full containers and a rest that is packed as an item of its own; start and n_tokens
    give the range of its tokens, which are bytes and may be cut anywhere. No other item is split. Null and empty texts need no
    room and give no row. Null keys and repeated rows are packed like any other. Only sizes travel, never texts.

    Rows are dealt out to shards of about shard_rows at random by hash, so no value of any column makes a shard large. Each
    shard is packed best fit decreasing; what sharding wastes is the last open bins of each, under a thousandth.
    """
    shards = max(1, -(-df.count() // shard_rows))
    cap = F.lit(capacity).cast("long")
    own = df.select(F.col(key).alias("k"), n_tokens(F.col(text)).alias("n")).where("n > 0").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    own = own.withColumn("pieces", F.ceil(F.col("n") / cap).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    parts = own.select("shard", "k", (F.col("at") * cap).alias("start"), F.least(cap, F.col("n") - F.col("at") * cap).cast("int").alias("size"), "pieces")
    kind = dict(df.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k", "start"], ascending=[False, True, True], kind="stable")
        bins = pd.Series(best_fit(pdf["size"].tolist(), capacity), index=pdf.index, dtype="int64")
        return pdf.assign(container=bins + (int(pdf["shard"].iloc[0]) << 32)).drop(columns="shard")

    packed = parts.groupBy("shard").applyInPandas(one, f"container long, k {kind}, start long, size int, pieces int")
    return packed.select("container", F.col("k").alias(key), "start", F.col("size").alias("n_tokens"), F.col("pieces").alias("n_pieces"))


def fill(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of room left unused."""
    one = packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return one.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))
