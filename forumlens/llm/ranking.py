"""Top N items within every group (problem 4).

Two-stage salted ranking. Every group is hashed by item identifier into `salts` subgroups, each subgroup is ranked on
its own and keeps N rows, and the survivors (at most `salts * N` per group) are ranked once more by score and
identifier. A row of the true top N of a group is in the top N of its subgroup, so nothing is lost; a group with a
third of all rows is sorted by `salts` tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALT, _FIRST = "__rank_salt", "__rank_first"


def top_n_per_group(
    df: DataFrame,
    groups: Sequence[str | Column],
    order: Sequence[Column],
    n: int,
    identifier: Sequence[str],
    rank_name: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """The first `n` rows of each group under `order`, with their rank (1..n) in `rank_name`.

    `order` should end in a unique key; `identifier` columns are appended, ascending with nulls last, so rows that are
    equal in `order` still rank the same way on every run. Rows equal in `order` and `identifier` are repeats: each
    takes a rank of its own, and which of them is which does not matter because they rank as equals.

    Nulls: a null group key is a group of its own. Null scores follow the nulls placement given in `order`.
    An empty input gives an empty result; `n` below 1 is an error. Other columns pass through unchanged; a column
    already called `rank_name` is replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [F.col(g) if isinstance(g, str) else g for g in groups]
    full_order = [*order, *(F.col(c).asc_nulls_last() for c in identifier)]
    rows = df.drop(rank_name).withColumn(_SALT, F.pmod(F.xxhash64(*identifier), F.lit(salts)))
    first = Window.partitionBy(*keys, F.col(_SALT)).orderBy(*full_order)
    survivors = rows.withColumn(_FIRST, F.row_number().over(first)).where(F.col(_FIRST) <= n).drop(_FIRST, _SALT)
    second = Window.partitionBy(*keys).orderBy(*full_order)
    return survivors.withColumn(rank_name, F.row_number().over(second)).where(F.col(rank_name) <= n)


def latest_version(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per `keys`: the greatest by `newest` (nulls lowest), ties broken by the remaining columns.

    It is a partial aggregate, so a key with millions of versions is folded before the shuffle. Columns that cannot be
    compared (maps) are an error. A null in `keys` is a key of its own.
    """
    rest = [c for c in df.columns if c not in keys and c not in newest]
    packed = F.struct(*newest, *rest)
    best = df.groupBy(*keys).agg(F.max(packed).alias("__best"))
    return best.select(*(c if c in keys else F.col(f"__best.`{c}`").alias(c) for c in df.columns))


def topic_ranking(df_tsne: DataFrame, n: int = 5, salts: int = 32) -> DataFrame:
    """The `n` communities with the most `users_l7` per snapshot and topic: `rank_by_topic_v2` made anew.

    Of the rows of one (`pt`, `subreddit_id`) the last loaded counts; afterwards null `users_l7` or
    `curator_topic_v2` drop out. Topics are compared without case and outer spaces. Ties go by `posts_l7` descending
    (null last), lower-cased `subreddit_name`, then `subreddit_id`. The stored, unreliable rank is not read.
    """
    rows = df_tsne.select("pt", "subreddit_id", "subreddit_name", "curator_topic_v2", "users_l7", "posts_l7", "loaded_at")
    current = latest_version(rows, ["pt", "subreddit_id"], ["loaded_at", "users_l7", "posts_l7"])
    ranked = current.where("users_l7 is not null and curator_topic_v2 is not null").withColumns(
        {"topic": F.lower(F.trim("curator_topic_v2")), "name": F.lower("subreddit_name")}
    )
    order = [F.desc_nulls_last("users_l7"), F.desc_nulls_last("posts_l7"), F.asc_nulls_last("name")]
    return top_n_per_group(ranked, ["pt", "topic"], order, n, ["subreddit_id"], "rank_by_topic_v2", salts)
