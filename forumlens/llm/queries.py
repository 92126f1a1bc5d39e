"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.sources.catalog import table

from . import langid, leakage, mixture, neighbours, packing, ranking, residue, survivorship, vectors


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivorship.surviving_fields(
        table(spark, sf_dir, "comment_language_v2"), table(spark, sf_dir, "post_language_detection_cld3_clean")
    )
    return found.select("id", "field_name", "detection_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.surviving_records(
        table(spark, sf_dir, "comment_language_v2"), table(spark, sf_dir, "post_language_detection_cld3_clean")
    )


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.consensus_fields(
        table(spark, sf_dir, "comment_language_v2"), table(spark, sf_dir, "post_language_detection_cld3_clean")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.cluster_rows(vectors.usable_vectors(table(spark, sf_dir, "embeddings_community")))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "cluster_labels").where("primary_topic is not null and subreddit_id is not null")
    return labels.groupBy(F.col("subreddit_id").alias("id")).agg(F.min(F.lower(F.trim("primary_topic"))).alias("topic"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.describe_components(vectors.usable_vectors(table(spark, sf_dir, "embeddings_community")), _topics(spark, sf_dir))


def p2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.describe_mixture(vectors.usable_vectors(table(spark, sf_dir, "embeddings_community")), _topics(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.relabelled_segments(
        table(spark, sf_dir, "comment_language_detection_cld3_clean"), table(spark, sf_dir, "language_lookup")
    )


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_segments(
        table(spark, sf_dir, "comment_language_detection_cld3_clean"), table(spark, sf_dir, "language_lookup")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.topic_ranking(table(spark, sf_dir, "df_tsne"))
    return ranked.select(F.date_format("pt", "yyyy-MM-dd").alias("pt"), "subreddit_id")


def p4_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.topic_ranking(table(spark, sf_dir, "df_tsne"))
    return ranked.select(
        F.date_format("pt", "yyyy-MM-dd").alias("pt"), "topic", "subreddit_id", "users_l7", F.col("rank_by_topic_v2").cast("bigint").alias("rank_by_topic_v2")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.neighbour_pairs(vectors.usable_vectors(table(spark, sf_dir, "embeddings_community")))
    return pairs.select("subreddit_id_a", "subreddit_id_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_rows(vectors.usable_vectors(table(spark, sf_dir, "embeddings_community")))


def p5_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists the seeds visit, of how many, and with how many rows they are compared, by number of lists."""
    seen = neighbours.probe_report(vectors.usable_vectors(table(spark, sf_dir, "embeddings_community")))
    return seen.groupBy("lists", "of_lists").agg(F.count(F.lit(1)).alias("queries"), F.avg("rows_compared").alias("rows_compared"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each kind, the tokens they hold and the part of their room that is unused."""
    used = p6_containers(spark, sf_dir).groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("piece_tokens").alias("used"))
    return used.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (1 - F.sum("used") / F.sum("capacity_tokens")).alias("unused")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.scored(table(spark, sf_dir, "documents")).where("is_residue").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.scored(table(spark, sf_dir, "documents"))


_BARE = "regexp_replace(lower(trim({0})), '^t[0-9]_', '')"
_USABLE = "{0} is not null and lower(trim({0})) not in ('', 'unprocessed', 'unknown', 'null', 'n/a', '[deleted]', '[removed]')"

_P1_ROWS = f"""
with author as (
  select distinct 't3_' || {_BARE.format('post_id')} as a_id, user_id as a_user
  from post_language_detection_cld3_clean where user_id is not null and post_id is not null
), r as (
  select case lower(trim(thing_type)) when 'post' then 't3_' when 'comment' then 't1_' end || {_BARE.format('id')} as id,
    user_id, created_timestamp, probability, detection_id, language, geolocation_country_code, app_name, text
  from comment_language_v2
), o as (
  select r.*, count(*) over (partition by r.id) as n,
    row_number() over (partition by r.id order by (a_id is not null) desc, created_timestamp desc nulls last, probability desc nulls last, detection_id) as rn
  from r left join author on r.id = a_id and r.user_id = a_user
  where r.id is not null
), f as (
  select id, rn, detection_id, 'language' as field_name, language as value from o where n >= 2 and probability between 0 and 1 and {_USABLE.format('language')}
  union all select id, rn, detection_id, 'geolocation_country_code', geolocation_country_code from o where n >= 2 and {_USABLE.format('geolocation_country_code')}
  union all select id, rn, detection_id, 'app_name', app_name from o where n >= 2 and {_USABLE.format('app_name')}
  union all select id, rn, detection_id, 'text', text from o where n >= 2 and {_USABLE.format('text')}
), w as (select * from (select f.*, row_number() over (partition by id, field_name order by rn) as k from f) z where k = 1)
"""
_P4_RANKS = """
with latest as (
  select *, row_number() over (partition by pt, subreddit_id order by loaded_at desc nulls last, users_l7 desc nulls last, posts_l7 desc nulls last) as v
  from df_tsne
), ranked as (
  select strftime(pt, '%Y-%m-%d') as pt, lower(trim(curator_topic_v2)) as topic, subreddit_id, users_l7,
    row_number() over (partition by pt, lower(trim(curator_topic_v2))
      order by users_l7 desc, posts_l7 desc nulls last, lower(subreddit_name), subreddit_id) as rank_by_topic_v2
  from latest where v = 1 and users_l7 is not null and curator_topic_v2 is not null
)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_records": p1_records,
        "p1_consensus": p1_consensus,
        "p2_found": p2_found,
        "p2_clusters": p2_clusters,
        "p2_components": p2_components,
        "p3_found": p3_found,
        "p3_segments": p3_segments,
        "p4_found": p4_found,
        "p4_ranks": p4_ranks,
        "p5_found": p5_found,
        "p5_pairs": p5_pairs,
        "p5_probes": p5_probes,
        "p6_containers": p6_containers,
        "p6_unused": p6_unused,
        "p7_found": p7_found,
        "p7_spans": p7_spans,
        "p8_found": p8_found,
        "p8_scores": p8_scores,
    }


def oracle_sql() -> dict[str, str]:
    pivot = ", ".join(f"max(case when field_name = '{f}' then value end) as {f}" for f in survivorship.FIELDS)
    return {
        "p1_found": _P1_ROWS + "select id, field_name, detection_id from w",
        "p1_records": _P1_ROWS + f"select id, {pivot} from w group by id",
        "p4_found": _P4_RANKS + "select pt, subreddit_id from ranked where rank_by_topic_v2 <= 5",
        "p4_ranks": _P4_RANKS + "select pt, topic, subreddit_id, users_l7, rank_by_topic_v2 from ranked where rank_by_topic_v2 <= 5",
    }
