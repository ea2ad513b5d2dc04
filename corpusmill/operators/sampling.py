"""Splits and subsets that depend on a seed and on keys, never on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded


def holdout(df: DataFrame, keys: list[str], seed: str, share: float = 0.05) -> DataFrame:
    """df with split: "test" for about a share of the keys, by hash; no shuffle."""
    unit = F.conv(F.substring(seeded(seed, *(F.col(k) for k in keys)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(unit < share, "test").otherwise("train"))


def ranked(df: DataFrame, groups: list[str], keys: list[str], seed: str) -> DataFrame:
    """df with _r, each row's place in the seeded order of its group, and _n, the group's rows.

    A group of any size is ranked in 4096 parts by the leading digits of the hash: parts are
    ranked by themselves and moved up by the counts of the parts before, so no task holds a
    whole group.
    """
    part = [*groups, "_part"]
    hashed = df.withColumn("_h", seeded(seed, *(F.col(k) for k in keys))).withColumn("_part", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*part).agg(F.count("*").alias("_k"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_k").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(part)), before.alias("_before"), F.sum("_k").over(whole).alias("_n"))
    match = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(part)]
    own = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("_h", *keys)))
    out = own.join(moved, match).withColumn("_r", F.col("_r") + F.col("_before"))
    return out.drop("_h", "_part", "_before", *(f"_{i}" for i in range(len(part))))


def stratified(df: DataFrame, strata: list[str], keys: list[str], seed: str, shares: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """df with split: each stratum cut at the shares of its rows, in seeded order."""
    split, upto = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        upto += share
        cuts.append((name, round(upto, 10)))
    for name, cut in reversed(cuts):
        split = F.when(F.col("_r") <= F.round(F.col("_n") * F.lit(cut), 0), name).otherwise(split)
    return ranked(df, strata, keys, seed).withColumn("split", split).drop("_r", "_n")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, keys: list[str], seed: str, n: int | None = None) -> DataFrame:
    """Rows in seeded order, the first n of them if n is given."""
    order = [seeded(seed, *(F.col(k) for k in keys)), *(F.col(k) for k in keys)]
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


def sliced(df: DataFrame, order: list[str], start: int, n: int | None = None) -> DataFrame:
    """Rows from place start (negative: 0) in the order, n of them (None or less than 1: all).
    A start beyond the last row is an error."""
    start = max(0, start)
    if start and df.limit(start + 1).count() <= start:
        raise ValueError(f"start {start} is beyond the last row")
    out = df.orderBy(*order).offset(start)
    return out if n is None or n <= 0 else out.limit(n)
