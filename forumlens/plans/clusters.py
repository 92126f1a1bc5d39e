"""Clusters and the lists made from them (Q20 to Q25, Q42, Q43, Q50, Q51)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.operators import clustering as C
from forumlens.operators import relational as R

from .registry import Tables, query

#: Ids in one JSON object (some 14 bytes each) and copies of a cluster's list that share its objects; memory and balance only.
OBJECT_IDS, COPIES = 100_000, 32


def cluster_summary(members: DataFrame, separator: str = ", ") -> DataFrame:
    """One row per cluster: lists and counts of seeds, of recommendable, discoverable and private members, and whether it is an orphan.

    Input has cluster, id, is_seed, can_recommend; the lists of discoverable and private members come where it also has
    can_discover and is_private. An orphan has fewer than two members, or no member to recommend.
    """
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("id")))), separator)
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), n("is_seed").alias("seeds"), names("is_seed").alias("seed_list"), n("can_recommend").alias("recommendable"), names("can_recommend").alias("recommend_list"),
        *(made for c, count, listed in (("can_discover", "discoverable", "discover_list"), ("is_private", "private", "private_list")) if c in members.columns for made in (n(c).alias(count), names(c).alias(listed))),
    )
    return out.withColumn("is_orphan", (F.col("members") < 2) | (F.col("recommendable") == 0))


def seed_recommendations(members: DataFrame) -> DataFrame:
    """`cluster`, `seed`, `ids`: for every seed the recommendable others of its cluster, as a sorted array.

    The list of a cluster is built once and joined to its seeds; no pair of members is ever a row.
    """
    lists = members.where("can_recommend").groupBy("cluster").agg(F.array_sort(F.collect_set("id")).alias("all"))
    seeds = members.where("is_seed").select("cluster", F.col("id").alias("seed")).distinct()
    out = seeds.join(lists, "cluster").withColumn("ids", F.array_except("all", F.array("seed"))).drop("all")
    return out.where(F.size("ids") > 0)


def seed_objects(members: DataFrame, object_ids: int = OBJECT_IDS) -> DataFrame:
    """`cluster`, `part`, `json`: the lists of `seed_recommendations` as JSON objects from seed to list, seeds in order.

    The ids of a cluster grow with its seeds times its members, and a string ends at 2 GB. So an object takes as many seeds
    as have `object_ids` ids together, one at least: a cluster of no more ids is one object, a larger one has parts that hold every
    seed once, with its whole list. Seeds' lists exist only in the row that becomes JSON; what is shuffled are
    up to `COPIES` copies of a cluster's members, each with every `COPIES`-th part.
    """
    ids = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("id"))))
    both = members.where("cluster is not null").groupBy("cluster").agg(ids("can_recommend").alias("all"), ids("is_seed").alias("seeds")).where(F.size("all") > 0)
    # A list is empty only where the seed is the one member to recommend.
    both = both.withColumn("seeds", F.when(F.size("all") > 1, F.col("seeds")).otherwise(F.array_except("seeds", "all")))
    both = both.withColumn("step", F.greatest(F.floor(F.lit(object_ids) / F.size("all")), F.lit(1)).cast("int"))
    copies = both.withColumn("first", F.explode(F.transform(F.sequence(F.lit(0), F.lit(COPIES - 1)), lambda k: k.cast("bigint") * F.col("step") + 1))).where(F.col("first") <= F.size("seeds"))
    starts = F.when(F.col("first") <= F.size("seeds"), F.sequence("first", F.size("seeds").cast("bigint"), F.col("step").cast("bigint") * COPIES))
    parts = copies.repartition(COPIES, "cluster", "first").select("cluster", "all", "step", F.explode(starts).alias("start"), "seeds")
    entries = F.transform(F.slice("seeds", F.col("start").cast("int"), F.col("step")), lambda s: F.struct(s.alias("key"), F.array_remove("all", s).alias("value")))
    return parts.select("cluster", F.expr("(start - 1) div step").alias("part"), F.to_json(F.map_from_entries(entries)).alias("json"))


def labelled(t: Tables) -> DataFrame:
    """One row per community of the cluster table, with its nested paths."""
    one = R.dedupe_latest(t.cluster_labels.where("subreddit_id is not null and k_0023_label is not null"), ["subreddit_id"], [F.asc("model_sort_order"), *(F.asc_nulls_last(c) for c in ("k_0097_label", "primary_topic", "cluster_majority_primary_topic", "subreddit_name", "posts_for_modeling_count"))])
    return one.withColumns({"path1": C.nested_label(["k_0023_label"]), "path2": F.when(F.col("k_0097_label").isNotNull(), C.nested_label(["k_0023_label", "k_0097_label"]))})


def members_of(t: Tables) -> DataFrame:
    seeds = t.embeddings_community.where("is_seed").select("subreddit_id").distinct().withColumn("is_seed", F.lit(True))
    rows = labelled(t).join(seeds, "subreddit_id", "left")
    return rows.select(F.col("path1").alias("cluster"), F.col("subreddit_id").alias("id"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"), (F.col("posts_for_modeling_count") >= 5).alias("can_recommend"), F.col("posts_for_modeling_count").between(1, 4).alias("can_discover"), F.col("posts_for_modeling_count").isNull().alias("is_private"))


_LAB = (
    "(select *, lpad(k_0023_label::int::varchar, 4, '0') as path1, case when k_0097_label is not null then lpad(k_0023_label::int::varchar, 4, '0') || '-' || lpad(k_0097_label::int::varchar, 4, '0') end as path2 from cluster_labels"
    " where subreddit_id is not null and k_0023_label is not null qualify row_number() over (partition by subreddit_id order by model_sort_order nulls first, k_0097_label nulls last, primary_topic nulls last, cluster_majority_primary_topic nulls last, subreddit_name nulls last, posts_for_modeling_count nulls last) = 1)"
)
_MEM = f"(select path1 as cluster, subreddit_id as id, subreddit_id in (select subreddit_id from embeddings_community where is_seed and subreddit_id is not null) as is_seed, posts_for_modeling_count >= 5 as can_recommend, posts_for_modeling_count between 1 and 4 as can_discover, posts_for_modeling_count is null as is_private from {_LAB})"


@query("Q20_hierarchical_clusters")
def q20(t: Tables):
    labels = C.labels_long(t.embeddings, "vec_id", "embedding", (2, 4, 8, 16))
    return labels.groupBy("vec_id").pivot("k", [2, 4, 8, 16]).agg(F.max("label"))


@query("Q21_topic_mix", f"select subreddit_id, case when primary_topic is null then coalesce(cluster_majority_primary_topic, '') when cluster_majority_primary_topic is null or cluster_majority_primary_topic = primary_topic then primary_topic else primary_topic || ' | ' || cluster_majority_primary_topic end as topic_mix from {_LAB}")
def q21(t: Tables):
    return C.topic_mix(labelled(t), "subreddit_id", ["primary_topic", "cluster_majority_primary_topic"])


def _dynamic(n: int) -> str:
    return f"(select subreddit_id, case when path2 is null or count(*) over (partition by path2) <= {n} then 0 else 1 end as level, path1, path2 from {_LAB})"


@query("Q22_dynamic_clusters", f"select subreddit_id, level::int as level, case when level = 0 then path1 else path2 end as cluster from {_dynamic(2)}")
def q22(t: Tables):
    return C.dynamic_clusters(labelled(t), "subreddit_id", ["path1", "path2"], 2)


_ORPHANS = " union all ".join(
    f"select {n} as n, (select count(*) from (select case when level = 0 then path1 else path2 end as cluster, count(*) as members, count(case when subreddit_id in (select subreddit_id from embeddings_community where is_seed and subreddit_id is not null) then 1 end) as seeds from {_dynamic(n)} group by 1) where members < 2 or seeds = 0) as orphans"
    for n in (5, 6, 7, 8, 9)
)


@query("Q23_best_minimum", f"select n::int as n, orphans, row_number() over (order by orphans, n) = 1 as is_best from ({_ORPHANS})")
def q23(t: Tables):
    return C.best_minimum(labelled(t), "subreddit_id", ["path1", "path2"], t.embeddings_community.where("is_seed"), (5, 6, 7, 8, 9))


@query(
    "Q24_cluster_summary",
    f"select cluster, count(*) as members, count(case when is_seed then 1 end) as seeds, coalesce(string_agg(case when is_seed then id end, ', ' order by id), '') as seed_list, count(case when can_recommend then 1 end) as recommendable, coalesce(string_agg(case when can_recommend then id end, ', ' order by id), '') as recommend_list, count(case when can_discover then 1 end) as discoverable, coalesce(string_agg(case when can_discover then id end, ', ' order by id), '') as discover_list, count(case when is_private then 1 end) as private, coalesce(string_agg(case when is_private then id end, ', ' order by id), '') as private_list, count(*) < 2 or count(case when can_recommend then 1 end) = 0 as is_orphan from {_MEM} group by 1",
)
def q24(t: Tables):
    return cluster_summary(members_of(t))


@query("Q25_seed_lists", f"select a.cluster, a.id as seed, string_agg(b.id, ',' order by b.id) as ids from {_MEM} a join {_MEM} b on b.cluster = a.cluster and b.can_recommend and b.id <> a.id where a.is_seed group by 1, 2")
def q25(t: Tables):
    return seed_recommendations(members_of(t)).select("cluster", "seed", F.array_join("ids", ",").alias("ids"))


@query("Q25_seed_json", f"select cluster, count(*) as seeds from (select a.cluster, a.id from {_MEM} a join {_MEM} b on b.cluster = a.cluster and b.can_recommend and b.id <> a.id where a.is_seed group by 1, 2) group by 1")
def q25b(t: Tables):
    back = F.from_json("json", "map<string,array<string>>")
    return seed_objects(members_of(t)).groupBy("cluster").agg(F.sum(F.size(back)).alias("seeds"))


@query(
    "Q42_distance_check_table",
    f"with p as (select s.subreddit_id as a, u.x.subreddit_id as b, max(u.x.cosine_similarity) as c from similar_communities s, lateral (select unnest(s.similar_subreddit) as x) u where u.x.subreddit_id is not null group by 1, 2), l as {_LAB} select p.a, p.b, round(p.c, 5) + 0 as c, la.path1 = lb.path1 as same_cluster from p join l la on la.subreddit_id = p.a join l lb on lb.subreddit_id = p.b qualify row_number() over (partition by p.a order by p.c desc nulls last, p.b) <= 3",
)
def q42(t: Tables):
    pairs = t.similar_communities.select(F.col("subreddit_id").alias("a"), F.explode("similar_subreddit").alias("x")).where("x.subreddit_id is not null")
    best = pairs.groupBy("a", F.col("x.subreddit_id").alias("b")).agg(F.max("x.cosine_similarity").alias("c"))
    paths = labelled(t).select("subreddit_id", "path1")
    both = best.join(paths.toDF("a", "pa"), "a").join(paths.toDF("b", "pb"), "b").withColumn("same_cluster", F.col("pa") == F.col("pb"))
    return R.top_n(both, ["a"], [F.desc_nulls_last("c"), F.asc("b")], 3).select("a", "b", (F.round("c", 5) + F.lit(0.0)).alias("c"), "same_cluster")


@query("Q43_flagged_clusters", f"select subreddit_id, coalesce(path1 = '0003' or path2 like '0007-00%', false) as flagged from {_LAB}")
def q43(t: Tables):
    hit = (F.col("path1") == "0003") | F.col("path2").startswith("0007-00")
    return labelled(t).select("subreddit_id", F.coalesce(hit, F.lit(False)).alias("flagged"))


@query("Q50_clean_sheet", f"select subreddit_id as id, 'c/' || subreddit_name as link, path1 as cluster, null::varchar as checked from {_LAB} where posts_for_modeling_count >= 3")
def q50(t: Tables):
    kept = labelled(t).where("posts_for_modeling_count >= 3")
    return kept.select(F.col("subreddit_id").alias("id"), F.concat(F.lit("c/"), "subreddit_name").alias("link"), F.col("path1").alias("cluster"), F.lit(None).cast("string").alias("checked"))


@query("Q51_cluster_lists", f"select path1 as cluster, count(*) as members, string_agg(subreddit_id, ', ' order by subreddit_id) as ids from {_LAB} group by 1")
def q51(t: Tables):
    return labelled(t).groupBy(F.col("path1").alias("cluster")).agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("subreddit_id")), ", ").alias("ids"))

