"""Languages of communities (Q11 to Q13, Q58)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.operators import relational as R

from .registry import Tables, query


def language_ranks(posts: DataFrame, replies: DataFrame, keep: int = 20) -> DataFrame:
    """`community`, `kind` (posts, replies, both), `language`, `n`, `share`, `rank`. Inputs have community, language.

    The counts of both kinds are one union, so a community with only posts or only replies has its row for 'both'.
    """
    parts = posts.select("community", "language", F.lit("posts").alias("kind")).unionByName(replies.select("community", "language", F.lit("replies").alias("kind")))
    counted = parts.where("community is not null and language is not null").groupBy("community", "kind", "language").agg(F.count(F.lit(1)).alias("n"))
    both = counted.groupBy("community", "language").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("both"))
    every = counted.unionByName(both)
    shared = every.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("community", "kind")))
    return R.top_n(shared, ["community", "kind"], [F.desc("n"), F.asc("language")], keep)


def primary_and_secondary(ranks: DataFrame, least_share: float = 0.008) -> DataFrame:
    """`community`, `primary_language`, `primary_share`, `secondary_language`: a second language needs more than `least_share`."""
    both = ranks.where("kind = 'both'")
    first = both.where("rank = 1").select("community", F.col("language").alias("primary_language"), F.col("share").alias("primary_share"))
    second = both.where((F.col("rank") == 2) & (F.col("share") > least_share)).select("community", F.col("language").alias("secondary_language"))
    return first.join(second, "community", "left")


def community_aggregates(documents: DataFrame, languages: list[str]) -> DataFrame:
    """Shares of the given languages, most common type and median length per community; input has community, language, kind, length."""
    wide = R.counts_wide(documents, ["community"], "language", languages).select("community", "total", *(f"{v}_percent" for v in languages))
    mid = documents.groupBy("community").agg(F.median("length").alias("median_length"))
    return wide.join(mid, "community").join(R.majority(documents, ["community"], "kind", "main_kind"), "community", "left")


def rank_inputs(t: Tables):
    code = lambda c: F.nullif(F.get(F.split(F.lower(F.trim(c)), "-"), F.lit(0)), F.lit(""))
    posts = t.post_language_detection_cld3_clean.select(F.col("subreddit_id").alias("community"), code("weighted_language_code").alias("language"))
    replies = t.comment_language_detection_cld3_clean.select(F.col("subreddit_id").alias("community"), code("weighted_language_code").alias("language"))
    return posts, replies


_CODE = "nullif(split(lower(trim(weighted_language_code)), '-')[1], '')"
_RANKS = (
    f"(with p as (select subreddit_id as community, {_CODE} as language, 'posts' as kind from post_language_detection_cld3_clean union all select subreddit_id, {_CODE}, 'replies' from comment_language_detection_cld3_clean),"
    " c as (select community, kind, language, count(*) as n from p where community is not null and language is not null group by 1, 2, 3), e as (select * from c union all by name select community, 'both' as kind, language, sum(n)::bigint as n from c group by 1, 3)"
    " select *, n / sum(n) over (partition by community, kind) as share, row_number() over (partition by community, kind order by n desc, language)::int as rank from e)"
)


@query("Q11_language_ranks", f"select community, kind, language, n, round(share, 6) as share, rank from {_RANKS} where rank <= 20")
def q11(t: Tables):
    return language_ranks(*rank_inputs(t)).select("community", "kind", "language", "n", F.round("share", 6).alias("share"), "rank")


@query(
    "Q12_primary_secondary_language",
    f"with r as {_RANKS} select a.community, a.language as primary_language, round(a.share, 6) as primary_share, b.language as secondary_language from r a left join r b on b.community = a.community and b.kind = 'both' and b.rank = 2 and b.share > 0.008 where a.kind = 'both' and a.rank = 1",
)
def q12(t: Tables):
    return primary_and_secondary(language_ranks(*rank_inputs(t))).withColumn("primary_share", F.round("primary_share", 6))


_L = ("en", "de", "es")


@query(
    "Q13_community_aggregates",
    "with d as (select source as community, lang as language, post_type as kind, n_chars as length from documents), m as (select community, kind as main_kind from (select community, kind, count(*) as n from d where kind is not null group by 1, 2) qualify row_number() over (partition by community order by n desc, kind) = 1)"
    " select d.community, count(*) as total, " + ", ".join(f"round(count(case when language = '{v}' then 1 end) / count(*), 6) as {v}_percent" for v in _L) + ", round(median(length), 2) as median_length, any_value(main_kind) as main_kind from d left join m on m.community = d.community group by 1",
)
def q13(t: Tables):
    rows = t.documents.select(F.col("source").alias("community"), F.col("lang").alias("language"), F.col("post_type").alias("kind"), F.col("n_chars").alias("length"))
    out = community_aggregates(rows, list(_L))
    return out.withColumns({**{f"{v}_percent": F.round(f"{v}_percent", 6) for v in _L}, "median_length": F.round("median_length", 2)})


@query(
    "Q58_raw_vs_weighted_language",
    "with a as (select language as code, count(*) as raw_n from comment_language_v2 where language is not null group by 1), b as (select weighted_language as code, count(*) as weighted_n from comment_language_v2 where weighted_language is not null group by 1) select coalesce(a.code, b.code) as code, coalesce(raw_n, 0)::bigint as raw_n, coalesce(weighted_n, 0)::bigint as weighted_n, (coalesce(weighted_n, 0) - coalesce(raw_n, 0))::bigint as difference from a full join b on a.code = b.code",
)
def q58(t: Tables):
    n = lambda c, name: t.comment_language_v2.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("code")).agg(F.count(F.lit(1)).alias(name))
    both = R.full_outer(n("language", "raw_n"), n("weighted_language", "weighted_n"), ["code"]).na.fill(0, ["raw_n", "weighted_n"])
    return both.withColumn("difference", F.col("weighted_n") - F.col("raw_n"))
