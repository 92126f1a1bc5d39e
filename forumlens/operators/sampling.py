"""Samples, splits and display orders that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_bucket(column: str, buckets: int) -> Column:
    """0..buckets-1 from the first 28 bits of the value's md5, which other engines compute alike; null stays null."""
    return F.conv(F.left(F.md5(F.col(column).cast("string").cast("binary")), F.lit(7)), 16, 10).cast("bigint") % buckets


def hash_sample(df: DataFrame, key: str, keep: int, of: int) -> DataFrame:
    """Rows whose key falls into the first `keep` of `of` buckets: all rows of a key stay together. Null keys drop out."""
    return df.where(stable_bucket(key, of) < keep)


def hash_split(df: DataFrame, key: str, parts: dict[str, int], name: str = "part") -> DataFrame:
    """Labels every row with a part, by key and in the given percentages."""
    bucket, edge, label = stable_bucket(key, sum(parts.values())), 0, None
    for part, share in parts.items():
        edge += share
        label = F.when(bucket < edge, part) if label is None else label.when(bucket < edge, part)
    return df.withColumn(name, label)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """`n` rows by the order of a seeded hash of `key`: a top-n per task and a merge, not a full sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to `n` rows of every stratum, by the order of a seeded hash."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def sort_groups_together(df: DataFrame, group: str, value: str, name: str = "group_best") -> DataFrame:
    """Groups in the order of their best row, each group's rows side by side."""
    best = F.max(value).over(Window.partitionBy(group))
    return df.withColumn(name, best).orderBy(F.desc(name), F.asc(group), F.desc(value))
