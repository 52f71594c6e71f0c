"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boscograph.functions.text import is_stated


def _number(c: Column, kind: str) -> Column:
    return F.when(F.isnan(c), None).otherwise(c) if kind in ("double", "float") else c


def survive_by_field(df: DataFrame, group: str, fields: dict[str, tuple[Column, Column]], trust: str, recency: str, tie: str) -> DataFrame:
    """One row per group with the best value of each field, chosen on its own.

    fields: name of the result -> (value, whether it is stated). The stated value of the row with the highest trust, then the
    latest recency, then the highest tie wins; null or NaN trust and null recency rank last, rows alike in all three go by the
    larger value. A group none of whose rows states a field gets null there. Rows without a group belong to none and give no row;
    repeated rows change nothing; an empty table gives an empty one. Only the named columns are read, so others may be called anything.

    Each row is laid out once per field and ranked by a window over (group, field). Spark keeps the first rank of each group in
    every map task before the shuffle (WindowGroupLimit), so a group with a third of all rows sends one row per task and field.
    """
    kinds = dict(df.dtypes)
    each = F.array(*(F.struct(F.lit(k).alias("f"), F.when(ok, v).alias("v")) for k, (v, ok) in fields.items()))
    flat = df.select(
        F.col(group).alias("g"), _number(F.col(trust), kinds[trust]).alias("t"), F.col(recency).alias("r"), F.col(tie).alias("i"), F.explode(each).alias("x")
    ).where(F.col("g").isNotNull())
    flat = flat.select("g", "t", "r", "i", "x.f", "x.v")
    order = W.partitionBy("g", "f").orderBy(F.col("v").isNotNull().desc(), F.desc_nulls_last("t"), F.desc_nulls_last("r"), F.desc_nulls_last("i"), F.desc_nulls_last("v"))
    top = flat.withColumn("n", F.row_number().over(order)).where("n = 1")
    return top.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("f") == k, F.col("v"))).alias(k) for k in fields))


def survive_whole(df: DataFrame, group: str, columns: list[str], trust: str, recency: str, tie: str) -> DataFrame:
    """The best whole record of each group: most stated values among columns, then trust, recency and tie as in survive_by_field.

    Adds n_stated. Rows without a group give none. Copies alike in all of these are told apart by their columns' text.
    """
    kinds = dict(df.dtypes)
    stated = sum((F.when(is_stated(F.col(c)) if kinds[c] == "string" else F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    own = df.select(F.col(group).alias("g"), _number(F.col(trust), kinds[trust]).alias("t"), F.col(recency).alias("r"), F.col(tie).alias("i"), stated.alias("s"), F.struct(*{c: F.col(c) for c in [group, tie, *columns, trust, recency]}.values()).alias("x"))
    order = W.partitionBy("g").orderBy(F.desc("s"), F.desc_nulls_last("t"), F.desc_nulls_last("r"), F.desc_nulls_last("i"), F.desc_nulls_last(F.to_json("x")))
    top = own.where(F.col("g").isNotNull()).withColumn("n", F.row_number().over(order)).where("n = 1")
    return top.select("x.*", F.col("s").alias("n_stated"))
