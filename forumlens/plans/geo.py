"""Where a community is relevant (Q1 to Q6): country names, candidates, shares, standard scores, selection.

Activity is `comment_language_v2`: community, user and country of every post and comment. Country names (Q1) come from the nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions import scalars as S
from forumlens.operators import relational as R

from .clusters import _LAB, labelled
from .registry import Tables, query


def country_names(lookup: DataFrame, overrides: DataFrame) -> DataFrame:
    """`country_code`, `country_name`, `region`: names up to the first comma or bracket, overridden where given."""
    short = F.trim(F.regexp_replace("country_name", r"[,(\[].*$", ""))
    named = lookup.select("country_code", short.alias("plain"), "region")
    return R.full_outer(named, overrides.select("country_code", F.col("country_name").alias("forced")), ["country_code"]).select(
        "country_code", F.coalesce("forced", "plain").alias("country_name"), "region"
    )


def candidate_communities(activity: DataFrame, documents: DataFrame, as_of: str, days: int, least_users: int, least_documents: int) -> DataFrame:
    """Communities whose users and documents in the window reach the limits, with both counts. `activity` has community, user_id, d; `documents` community, document_id, d."""
    window = S.within_days(F.col("d"), F.lit(as_of).cast("date"), days)
    users = activity.where(window).groupBy("community").agg(F.count_distinct("user_id").alias("users"))
    docs = documents.where(window).groupBy("community").agg(F.count_distinct("document_id").alias("documents"))
    both = users.join(docs, "community", "left").select("community", "users", F.coalesce("documents", F.lit(0)).alias("documents"))
    return both.where((F.col("users") >= least_users) & (F.col("documents") >= least_documents))


def relevance_raw(pairs: DataFrame) -> DataFrame:
    """Per community and country: `users`, `share_of_community`, `share_of_country`. `pairs` has community, country, user_id."""
    n = pairs.groupBy("community", "country").agg(F.count_distinct("user_id").alias("users"))
    of = lambda k: S.safe_divide(F.col("users"), F.sum("users").over(Window.partitionBy(k)))
    return n.select("community", "country", "users", of("community").alias("share_of_community"), of("country").alias("share_of_country"))


def relevance_standardised(raw: DataFrame, constant: float = 0.5) -> DataFrame:
    """Adds the score of the country share within its community, the combined score and the rank of the country."""
    w = Window.partitionBy("community")
    z = S.z_score(F.col("share_of_country"), F.avg("share_of_country").over(w), F.stddev_samp("share_of_country").over(w), constant)
    scored = raw.withColumn("z", z).withColumn("score", S.combined_score(F.col("share_of_community"), F.col("z")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.round("score", 9)), "country")))


def selected_countries(standard: DataFrame, least_share: float, least_z: float) -> DataFrame:
    """`community`, `countries`, `n`: the relevant countries in order of their names."""
    kept = standard.where((F.col("share_of_community") >= least_share) | (F.col("z") >= least_z))
    return kept.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("countries"), F.count(F.lit(1)).alias("n"))


def pairs_of(t: Tables) -> DataFrame:
    rows = t.comment_language_v2.where("subreddit_id is not null and geolocation_country_code is not null and user_id is not null")
    return rows.select(F.col("subreddit_id").alias("community"), F.upper(F.trim("geolocation_country_code")).alias("country"), "user_id")


_RAW = (
    "(select community, country, users, users / sum(users) over (partition by community) as share_of_community, users / sum(users) over (partition by country) as share_of_country from"
    " (select subreddit_id as community, upper(trim(geolocation_country_code)) as country, count(distinct user_id) as users from comment_language_v2 where subreddit_id is not null and geolocation_country_code is not null and user_id is not null group by 1, 2))"
)
_STD = (
    f"(select *, 0.8::double * share_of_community + 0.2::double * case when z > 5 then 1 when z > 0 then z / 5 else 0 end as score from (select *, case when coalesce(stddev_samp(share_of_country) over w, 0) = 0 then 0.5 else"
    f" (share_of_country - avg(share_of_country) over w) / stddev_samp(share_of_country) over w end as z from {_RAW} window w as (partition by community)))"
)


@query(
    "Q1_country_names",
    "select coalesce(n_nationkey::varchar, code) as country_code, coalesce(forced, trim(regexp_replace(n_name, '[,(\\[].*$', ''))) as country_name, r_name as region from nation join region on r_regionkey = n_regionkey full join (values ('3', 'Kanada'), ('99', 'Nowhere')) o(code, forced) on o.code = n_nationkey::varchar",
)
def q1(t: Tables):
    lookup = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("country_code"), F.col("n_name").alias("country_name"), F.col("r_name").alias("region"))
    return country_names(lookup, t.spark.createDataFrame([("3", "Kanada"), ("99", "Nowhere")], "country_code string, country_name string"))


@query(
    "Q2_candidate_communities",
    "with w as (select subreddit_id, user_id, doc_id from documents where submit_date > date '2023-02-01' - 90 and submit_date <= date '2023-02-01' and subreddit_id is not null) select subreddit_id as community, count(distinct user_id) as users, count(distinct doc_id) as documents from w group by 1 having count(distinct user_id) >= 2 and count(distinct doc_id) >= 2",
)
def q2(t: Tables):
    rows = t.documents.where("subreddit_id is not null").select(F.col("subreddit_id").alias("community"), "user_id", F.col("doc_id").alias("document_id"), F.col("submit_date").alias("d"))
    return candidate_communities(rows, rows, "2023-02-01", 90, 2, 2)


@query(
    "Q3_geo_default",
    "select subreddit_id as community, geolocation_country_code as country from comment_language_v2 where geolocation_country_code is not null and subreddit_id is not null and coalesce(probability, 0) >= 0.5 qualify row_number() over (partition by subreddit_id, geolocation_country_code order by pt desc, detection_id) = 1",
)
def q3(t: Tables):
    rows = t.comment_language_v2.where("geolocation_country_code is not null and subreddit_id is not null and coalesce(probability, 0) >= 0.5")
    latest = R.dedupe_latest(rows, ["subreddit_id", "geolocation_country_code"], [F.desc("pt"), F.asc("detection_id")])
    return latest.select(F.col("subreddit_id").alias("community"), F.col("geolocation_country_code").alias("country"))


@query("Q4_geo_relevance_raw", f"select community, country, users, round(share_of_community, 6) as share_of_community, round(share_of_country, 6) as share_of_country from {_RAW}")
def q4(t: Tables):
    raw = relevance_raw(pairs_of(t))
    return raw.withColumns({c: F.round(c, 6) for c in ("share_of_community", "share_of_country")})


@query("Q5_geo_relevance_standardised", f"select community, country, round(z, 5) as z, round(score, 5) as score, row_number() over (partition by community order by round(score, 9) desc, country)::int as rank from {_STD}")
def q5(t: Tables):
    std = relevance_standardised(relevance_raw(pairs_of(t)))
    return std.select("community", "country", F.round("z", 5).alias("z"), F.round("score", 5).alias("score"), "rank")


@query("Q6_geo_selected", f"select community, string_agg(country, ', ' order by country) as countries, count(*) as n from {_STD} where share_of_community >= 0.05 or z >= 1 group by 1")
def q6(t: Tables):
    return selected_countries(relevance_standardised(relevance_raw(pairs_of(t))), 0.05, 1.0)


def relevant_with_clusters(standard: DataFrame, flags: DataFrame, labels: DataFrame, country: str, least_share: float = 0.01, least_z: float = 1.0) -> DataFrame:
    """Communities relevant to `country` with their score, flag and cluster path; communities without a label are kept.

    `standard` comes from `relevance_standardised`; `flags` has `community`, `flag`; `labels` has `community`, `cluster`.
    """
    kept = standard.where(F.col("country") == country).where((F.col("share_of_community") >= least_share) | (F.col("z") >= least_z))
    return kept.join(flags, "community", "left").join(labels, "community", "left").select("country", "community", "users", "score", "z", "flag", "cluster")


@query(
    "Q28_relevant_with_clusters",
    f"select s.country, s.community, s.users, round(s.score, 5) as score, round(s.z, 5) as z, f.flag, l.path1 as cluster from {_STD} s left join (select subreddit_id as community, max(is_seed::int) = 1 as flag from embeddings_community where subreddit_id is not null group by 1) f on f.community = s.community left join {_LAB} l on l.subreddit_id = s.community where s.country = 'DE' and (s.share_of_community >= 0.01 or s.z >= 1)",
)
def q28(t: Tables):
    flags = t.embeddings_community.where("subreddit_id is not null").groupBy(F.col("subreddit_id").alias("community")).agg(F.max("is_seed").alias("flag"))
    labels = labelled(t).select(F.col("subreddit_id").alias("community"), F.col("path1").alias("cluster"))
    found = relevant_with_clusters(relevance_standardised(relevance_raw(pairs_of(t))), flags, labels, "DE")
    return found.withColumns({"score": F.round("score", 5), "z": F.round("z", 5)})


@query(
    "Q52_country_top",
    f"select country, community, round(score, 5) as score from {_STD} qualify row_number() over (partition by country order by round(score, 9) desc, community) <= 3",
)
def q52(t: Tables):
    std = relevance_standardised(relevance_raw(pairs_of(t))).withColumn("exact", F.round("score", 9))
    return R.top_n(std.drop("rank"), ["country"], [F.desc("exact"), F.asc("community")], 3).select("country", "community", F.round("score", 5).alias("score"))


@query("Q57_geo_bucket", "select detection_id, case when geolocation_country_code is null then 'MISSING' when geolocation_country_code in ('US', 'DE', 'FR') then geolocation_country_code else 'ROW' end as bucket from comment_language_v2")
def q57(t: Tables):
    c = F.col("geolocation_country_code")
    return t.comment_language_v2.select("detection_id", F.when(c.isNull(), "MISSING").when(c.isin("US", "DE", "FR"), c).otherwise("ROW").alias("bucket"))
