"""Uniform samples of fixed size from data of unknown length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Random buckets of the layout, as hexadecimal digits of the key.
BUCKET_DIGITS = 3


def random_key(key: Column, seed: int) -> Column:
    """A random-looking but repeatable place of a key in the permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def permutation_sample(df: DataFrame, key_col: str, k: int, strata: Column | None = None, seed: int = 0) -> DataFrame:
    """``k`` rows of every stratum, each with the same chance, with ``stratum`` and ``position``.

    Random-permutation layout: every row is scattered to a random bucket, the bucket counts
    are summed up in order, and only the buckets that reach into the first ``k`` positions
    are shuffled within. The counts are at most 16**3 a stratum. ``df`` must have one row a
    key; the place depends on the key and the seed alone, so the sample does not depend on
    the order or the pieces in which the rows came. A stratum with fewer rows comes whole.
    Rows with a null key are no records. Existing columns ``stratum`` and ``position`` are
    replaced.
    """
    stratum = F.lit("all") if strata is None else strata
    placed = df.where(F.col(key_col).isNotNull()).withColumn("stratum", stratum).withColumn("_place", random_key(F.col(key_col), seed)).withColumn("_bucket", F.substring("_place", 1, BUCKET_DIGITS))
    counts = placed.groupBy("stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") < k).drop("_n")
    inside = Window.partitionBy("stratum", "_bucket").orderBy("_place", key_col)
    ranked = placed.join(before, ["stratum", "_bucket"]).withColumn("position", F.col("_before") + F.row_number().over(inside))
    return ranked.where(F.col("position") <= k).drop("_place", "_bucket", "_before")


def merge_sample(held: DataFrame, arrived: DataFrame, key_col: str, k: int, seed: int = 0) -> DataFrame:
    """The sample of everything seen so far from the held sample and a new piece.

    Positions follow the place of the key, so a row outside the first ``k`` of a piece can
    never enter later; a key delivered again takes its one place again.
    """
    both = held.select(key_col).unionByName(arrived.select(key_col)).where(F.col(key_col).isNotNull()).distinct()
    return permutation_sample(both, key_col, k, seed=seed)
