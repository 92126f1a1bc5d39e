"""Types of the published tables; writers cast to them, readers declare them instead of inferring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, FloatType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


NEIGHBOUR = _struct(community_id=StringType(), community_name=StringType(), cosine_similarity=DoubleType(), distance_rank=LongType())
AUDIENCE_USER = _struct(rank=LongType(), user_id=StringType(), score=DoubleType())

COMMUNITY_EMBEDDINGS = _struct(pt=DateType(), model_version=StringType(), community_id=StringType(), community_name=StringType(), documents=LongType(), embeddings=ArrayType(FloatType()))
SIMILAR_COMMUNITIES = _struct(pt=DateType(), model_version=StringType(), community_id=StringType(), community_name=StringType(), similar=ArrayType(NEIGHBOUR))
CLUSTER_LABELS = _struct(community_id=StringType(), community_name=StringType(), k=LongType(), label=LongType(), majority_topic=StringType(), model_sort_order=LongType())
SEED_LISTS = _struct(pt=DateType(), geo=StringType(), cluster=StringType(), seed=StringType(), ids=ArrayType(StringType()), created_at=TimestampType())
CLUSTER_SUMMARY = _struct(cluster=StringType(), members=LongType(), seeds=LongType(), seed_list=StringType(), recommendable=LongType(), recommend_list=StringType(), is_orphan=BooleanType())
AUDIENCES = _struct(pt=DateType(), community_id=StringType(), geo=StringType(), top_users=ArrayType(AUDIENCE_USER))
USER_TIME_SHARE = _struct(user_id=StringType(), shares=MapType(StringType(), DoubleType()))
LANGUAGE_RANKS = _struct(community=StringType(), kind=StringType(), language=StringType(), n=LongType(), share=DoubleType(), rank=LongType())

PUBLISHED = {
    "community_embeddings": COMMUNITY_EMBEDDINGS, "similar_communities": SIMILAR_COMMUNITIES, "cluster_labels": CLUSTER_LABELS, "seed_lists": SEED_LISTS,
    "cluster_summary": CLUSTER_SUMMARY, "audiences": AUDIENCES, "user_time_share": USER_TIME_SHARE, "language_ranks": LANGUAGE_RANKS,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema` in its order and types: missing ones are null, others are left out."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
