"""Recommendations from neighbours, and top authors (Q29 to Q32)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.operators import relational as R

from .registry import Tables, query


def latest_neighbours(similar: DataFrame) -> DataFrame:
    """`a`, `b`, `cosine`: the neighbour pairs of each community's latest run, one row per pair; impossible values drop out."""
    newest = R.dedupe_latest(similar, ["subreddit_id"], [F.desc("pt"), F.desc("model_version"), F.desc(F.size("similar_subreddit"))])
    flat = newest.select(F.col("subreddit_id").alias("a"), F.explode("similar_subreddit").alias("x")).where("x.subreddit_id is not null and x.cosine_similarity between -1 and 1")
    return flat.groupBy("a", F.col("x.subreddit_id").alias("b")).agg(F.max("x.cosine_similarity").alias("cosine")).where("a <> b")


def counterparts(pairs: DataFrame, local: DataFrame, least: float = 0.77, keep: int = 5) -> DataFrame:
    """For every local community its most similar ones elsewhere: the first, and up to `keep` with `least` similarity.

    `local` has `id`; pairs between two local communities are left out by an anti join.
    """
    mine = pairs.join(local.select(F.col("id").alias("a")).distinct(), "a", "left_semi").join(local.select(F.col("id").alias("b")).distinct(), "b", "left_anti")
    ranked = R.top_n(mine, ["a"], [F.desc("cosine"), F.asc("b")], keep)
    return ranked.where((F.col("rank") <= 1) | (F.col("cosine") >= least))


def hybrid(text: DataFrame, behaviour: DataFrame, least_text: float, least_behaviour: float, keep: int = 10) -> DataFrame:
    """Union of two kinds of neighbours above their limits, nested per seed: those found by both come first, then by similarity."""
    none = F.lit(None).cast("double")
    strong = text.where(F.col("cosine") >= least_text).select("a", "b", F.col("cosine").alias("by_text"), none.alias("by_behaviour"))
    joint = behaviour.where(F.col("cosine") >= least_behaviour).select("a", "b", none.alias("by_text"), F.col("cosine").alias("by_behaviour"))
    both = strong.unionByName(joint).groupBy("a", "b").agg(F.max("by_text").alias("by_text"), F.max("by_behaviour").alias("by_behaviour"))
    found_by = F.col("by_text").isNotNull().cast("int") + F.col("by_behaviour").isNotNull().cast("int")
    order = [F.desc("found_by"), F.desc_nulls_last("by_text"), F.desc_nulls_last("by_behaviour"), F.asc("b")]
    top = R.top_n(both.withColumn("found_by", found_by), ["a"], order, keep)
    return top.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "b", "by_text", "by_behaviour"))).alias("recommendations"))


def similar_to_seeds(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """`b`, `seeds`, `fused`: neighbours of a set of seeds, ranked by how many seeds have them and how similar they are."""
    near = pairs.join(seeds.select(F.col("id").alias("a")).distinct(), "a", "left_semi").groupBy("b").agg(F.count(F.lit(1)).alias("seeds"), F.max("cosine").alias("best"))
    rank = lambda c: F.dense_rank().over(Window.orderBy(F.desc(c)))
    return near.select("b", "seeds", (0.6 * rank("seeds") + 0.4 * rank("best")).alias("fused"))


def top_authors(documents: DataFrame, period: str, keep: int = 3) -> DataFrame:
    """`period`, `community`, `user_id`, `n`, `rank` by documents per author; input has community, user_id, d."""
    n = documents.where("user_id is not null").groupBy(F.date_trunc(period, "d").cast("date").alias("period"), "community", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return R.top_n(n, ["period", "community"], [F.desc("n"), F.asc("user_id")], keep)


_NEAR = (
    "(with newest as (select * from similar_communities qualify row_number() over (partition by subreddit_id order by pt desc, model_version desc, len(similar_subreddit) desc) = 1), f as (select subreddit_id as a, unnest(similar_subreddit) as x from newest)"
    " select a, x.subreddit_id as b, max(x.cosine_similarity) as cosine from f where x.subreddit_id is not null and x.cosine_similarity between -1 and 1 and a <> x.subreddit_id group by 1, 2)"
)
_LOCAL = "(select distinct subreddit_id as id from post_language_detection_cld3_clean where geo_country_code in ('DE', 'FR') and subreddit_id is not null)"


def local_ids(t: Tables) -> DataFrame:
    return t.post_language_detection_cld3_clean.where("geo_country_code in ('DE', 'FR') and subreddit_id is not null").select(F.col("subreddit_id").alias("id")).distinct()


@query("Q29_counterparts", f"with r as (select *, row_number() over (partition by a order by cosine desc, b)::int as rank from {_NEAR} where a in (select id from {_LOCAL}) and b not in (select id from {_LOCAL})) select a, b, round(cosine, 5) as cosine, rank from r where rank <= 5 and (rank <= 1 or cosine >= 0.77)")
def q29(t: Tables):
    return counterparts(latest_neighbours(t.similar_communities), local_ids(t)).withColumn("cosine", F.round("cosine", 5))


def pairs_of_model(similar: DataFrame, version: str) -> DataFrame:
    """`a`, `b`, `cosine` of one model over all its runs: the highest possible value of a pair."""
    flat = similar.where(F.col("model_version") == version).select(F.col("subreddit_id").alias("a"), F.explode("similar_subreddit").alias("x"))
    flat = flat.where("x.subreddit_id is not null and x.cosine_similarity between -1 and 1 and a <> x.subreddit_id")
    return flat.groupBy("a", F.col("x.subreddit_id").alias("b")).agg(F.max("x.cosine_similarity").alias("cosine"))


def _model_sql(version: str) -> str:
    return (
        f"(select a, x.subreddit_id as b, max(x.cosine_similarity) as c from (select subreddit_id as a, unnest(similar_subreddit) as x from similar_communities where model_version = '{version}')"
        " where x.subreddit_id is not null and x.cosine_similarity between -1 and 1 and a <> x.subreddit_id group by 1, 2)"
    )


@query(
    "Q30_hybrid_recommendations",
    f"with u as (select a, b, c as t, null::double as h from {_model_sql('v0.6.1')} where c >= 0.3 union all select a, b, null, c from {_model_sql('v0.6.0')} where c >= 0.2), g as (select a, b, max(t) as t, max(h) as h from u group by 1, 2),"
    " r as (select *, row_number() over (partition by a order by (t is not null)::int + (h is not null)::int desc, t desc nulls last, h desc nulls last, b) as k from g) select a, string_agg(b, ',' order by k) as recommended from r where k <= 10 group by 1",
)
def q30(t: Tables):
    nested = hybrid(pairs_of_model(t.similar_communities, "v0.6.1"), pairs_of_model(t.similar_communities, "v0.6.0"), 0.3, 0.2)
    return nested.select("a", F.array_join(F.transform("recommendations", lambda r: r["b"]), ",").alias("recommended"))


@query(
    "Q31_similar_to_seed_set",
    f"with n as (select b, count(*) as seeds, max(cosine) as best from {_NEAR} where a in (select subreddit_id from embeddings_community where is_seed) group by 1) select b, seeds, round(0.6::double * dense_rank() over (order by seeds desc) + 0.4::double * dense_rank() over (order by best desc), 4) as fused from n",
)
def q31(t: Tables):
    seeds = t.embeddings_community.where("is_seed").select(F.col("subreddit_id").alias("id"))
    return similar_to_seeds(latest_neighbours(t.similar_communities), seeds).withColumn("fused", F.round("fused", 4))


@query(
    "Q32_top_authors",
    "with n as (select date_trunc('month', submit_date)::date as period, subreddit_id as community, user_id, count(*) as n from documents where user_id is not null group by 1, 2, 3), r as (select *, row_number() over (partition by period, community order by n desc, user_id)::int as rank from n) select period::varchar as period, community, user_id, n, rank from r where rank <= 3",
)
def q32(t: Tables):
    rows = t.documents.select(F.col("subreddit_id").alias("community"), "user_id", F.col("submit_date").alias("d"))
    return top_authors(rows, "month").withColumn("period", F.col("period").cast("string"))


@query(
    "Q32_top_authors_per_country",
    "with n as (select geolocation_country_code as country, user_id, count(*) as n from comment_language_v2 where user_id is not null and geolocation_country_code is not null group by 1, 2), r as (select *, row_number() over (partition by country order by n desc, user_id) as k from n) select country, string_agg(user_id || ' (' || n::varchar || ')', ', ' order by k) as top from r where k <= 5 group by 1",
)
def q32b(t: Tables):
    n = t.comment_language_v2.where("user_id is not null and geolocation_country_code is not null").groupBy(F.col("geolocation_country_code").alias("country"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    top = R.top_n(n, ["country"], [F.desc("n"), F.asc("user_id")], 5)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s (%d)", "user_id", "n").alias("s")))), lambda x: x["s"])
    return top.groupBy("country").agg(F.array_join(ordered, ", ").alias("top"))
