"""Window, sort, sampling and set operators (W, T, O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from forumlens.operators import clustering as C
from forumlens.operators import relational as R
from forumlens.operators import sampling
from forumlens.operators import vectors as V

from .registry import Tables, query


@query("W1_dedupe_latest", "select id, detection_id from comment_language_v2 qualify row_number() over (partition by id order by created_timestamp desc nulls last, detection_id desc) = 1")
def w1(t: Tables):
    return R.dedupe_latest(t.comment_language_v2, ["id"], [F.desc_nulls_last("created_timestamp"), F.desc("detection_id")]).select("id", "detection_id")


@query("W2_top_n_per_group", "select subreddit_id, doc_id, rank::int as rank from (select subreddit_id, doc_id, row_number() over (partition by subreddit_id order by upvotes desc nulls last, doc_id) as rank from documents) where rank <= 8")
def w2(t: Tables):
    return R.top_n(t.documents, ["subreddit_id"], [F.desc_nulls_last("upvotes"), F.asc("doc_id")], 8).select("subreddit_id", "doc_id", "rank")


@query("W3_global_row_number", "select n_nationkey, row_number() over (order by n_name)::int as nth from nation")
def w3(t: Tables):
    return t.nation.select("n_nationkey", F.row_number().over(Window.orderBy("n_name")).alias("nth"))


@query(
    "W4_rank_fusion",
    "select s_nationkey, round(0.7::double * dense_rank() over (order by n desc) + 0.3::double * dense_rank() over (order by total desc), 4) as fused from (select s_nationkey, count(*) as n, round(sum(s_acctbal), 2) as total from supplier group by 1)",
)
def w4(t: Tables):
    g = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    rank = lambda c: F.dense_rank().over(Window.orderBy(F.desc(c)))
    return g.select("s_nationkey", F.round(0.7 * rank("n") + 0.3 * rank("total"), 4).alias("fused"))


@query("W5_share_of_total", "select event_type, user_id, round(count(*) / sum(count(*)) over (partition by user_id), 6) as share from events group by 1, 2")
def w5(t: Tables):
    return R.share_of_total(t.events, ["user_id"], ["event_type"]).select("event_type", "user_id", F.round("share", 6).alias("share"))


@query("W6_count_over_all", "select lang, count(*) as n, (select count(*) from documents) as documents from documents group by 1")
def w6(t: Tables):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("documents", F.sum("n").over(Window.partitionBy()))


@query("W7_distinct_over_all", "select event_type, count(*) as n, (select count(distinct user_id) from events) as users from events group by 1")
def w7(t: Tables):
    users = t.events.agg(F.count_distinct("user_id").alias("users"))  # one row
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(users), F.lit(True))


@query("W8_stable_rank", "select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by round(c_acctbal / 1000), c_custkey)::int as nth from customer")
def w8(t: Tables):
    w = Window.partitionBy("c_nationkey").orderBy(F.round(F.col("c_acctbal") / 1000), "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(w).alias("nth"))


@query("W9_dense_rank", "select p_partkey, dense_rank() over (partition by p_brand order by p_size desc)::int as nth from part")
def w9(t: Tables):
    return t.part.select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("nth"))


@query("W10_running_total", "select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 3) as total from events")
def w10(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.round(F.sum("value").over(w), 3).alias("total"))


_DAILY = "(select event_type, cast(ts as date) as d, count(*) as n from events group by 1, 2)"


@query("W11_second_difference", f"select event_type, d::varchar as d, n - 2 * lag(n) over w + lag(n, 2) over w as acceleration from {_DAILY} window w as (partition by event_type order by d)")
def w11(t: Tables):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return daily.select("event_type", F.col("d").cast("string").alias("d"), C.second_difference(F.col("n"), Window.partitionBy("event_type").orderBy("d")).alias("acceleration"))


@query(
    "W12_argmax_per_interval",
    f"select lo, d::varchar as d from (select lo, d, sum(n) as n from {_DAILY} join (values (1), (8), (15), (22)) i(lo) on day(d) between lo and lo + 6 group by 1, 2) qualify row_number() over (partition by lo order by n desc, d) = 1",
)
def w12(t: Tables):
    daily = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    intervals = t.spark.createDataFrame([(1,), (8,), (15,), (22,)], "lo int")
    inside = daily.join(F.broadcast(intervals), F.dayofmonth("d").between(F.col("lo"), F.col("lo") + 6))
    return R.dedupe_latest(inside, ["lo"], [F.desc("n"), F.asc("d")]).select("lo", F.col("d").cast("string").alias("d"))


@query("W13_several_ranks", "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::int as in_brand, row_number() over (partition by p_type order by p_retailprice desc, p_partkey)::int as in_type from part")
def w13(t: Tables):
    nth = lambda k: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.select("p_partkey", nth("p_brand").alias("in_brand"), nth("p_type").alias("in_type"))


@query(
    "W14_formatted_top_shares",
    "with s as (select source, lang, n, n / sum(n) over (partition by source) as share from (select source, lang, count(*) as n from documents where lang is not null group by 1, 2)), r as (select *, row_number() over (partition by source order by n desc, lang) as k from s)"
    " select source, string_agg(round(100 * share)::int::varchar || '% ' || lang, ', ' order by k) as top from r where k <= 5 group by 1",
)
def w14(t: Tables):
    shares = R.share_of_total(t.documents.where("lang is not null"), ["source"], ["lang"])
    top = R.top_n(shares, ["source"], [F.desc("n"), F.asc("lang")], 5)
    text = F.format_string("%d%% %s", F.round(100 * F.col("share")).cast("int"), F.col("lang"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("s")))), lambda x: x["s"])
    return top.groupBy("source").agg(F.array_join(ordered, ", ").alias("top"))


@query("T1_mixed_sort", "select n_regionkey, n_name from nation order by n_regionkey desc, n_name asc")
def t1(t: Tables):
    return t.nation.select("n_regionkey", "n_name").orderBy(F.desc("n_regionkey"), F.asc("n_name"))


@query("T2_groups_together", "select s_nationkey, s_suppkey, max(s_acctbal) over (partition by s_nationkey) as group_best from supplier order by group_best desc, s_nationkey, s_acctbal desc, s_suppkey")
def t2(t: Tables):
    return sampling.sort_groups_together(t.supplier, "s_nationkey", "s_acctbal", "group_best").select("s_nationkey", "s_suppkey", "group_best")


@query("T3_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def t3(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(25)


@query(
    "T4_top_similar_to_one",
    "with q as (select embedding::double[] as e from embeddings where vec_id = 7) select vec_id, label, round(list_cosine_similarity(embedding::double[], (select e from q)), 5) as cosine from embeddings where vec_id <> 7 order by list_cosine_similarity(embedding::double[], (select e from q)) desc, vec_id limit 10",
)
def t4(t: Tables):
    one = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q"))
    near = t.embeddings.where("vec_id <> 7").join(F.broadcast(one), F.lit(True)).withColumn("c", V.cosine(F.col("embedding"), F.col("q")))
    return near.orderBy(F.desc("c"), F.asc("vec_id")).limit(10).select("vec_id", "label", F.round("c", 5).alias("cosine"))


@query(
    "T4b_similar_side_by_side",
    "with x as (select vec_id, embedding::double[] as e from embeddings), r as (select a.vec_id as q, b.vec_id as id, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.e, b.e) desc, b.vec_id) as k from x a, x b where a.vec_id in (3, 5) and a.vec_id <> b.vec_id)"
    " select k::int as rank, max(case when q = 3 then id end) as for_3, max(case when q = 5 then id end) as for_5 from r where k <= 8 group by 1",
)
def t4b(t: Tables):
    found = V.cosine_topk(t.embeddings, "vec_id", "embedding", 8, F.col("vec_id").isin(3, 5))
    return found.groupBy(F.col("distance_rank").alias("rank")).agg(*(F.max(F.when(F.col("id_a") == q, F.col("id_b"))).alias(f"for_{q}") for q in (3, 5)))


@query("T4c_name_only_the_top", "select s_suppkey, case when row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) = 1 then s_name else '' end as shown from supplier")
def t4c(t: Tables):
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")) == 1
    return t.supplier.select("s_suppkey", F.when(first, F.col("s_name")).otherwise("").alias("shown"))


@query("T5_hash_sample", "select c_custkey from customer where (('0x' || left(md5(c_custkey::varchar), 7))::bigint % 10) < 8")
def t5(t: Tables):
    return sampling.hash_sample(t.customer, "c_custkey", 8, 10).select("c_custkey")


@query("T6_seeded_sample", "select 20::bigint as n")
def t6(t: Tables):
    return sampling.seeded_sample(t.customer, 20, seed=42, key="c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "T7_stratified_split",
    "select o_orderkey, case when (('0x' || left(md5(o_orderkey::varchar), 7))::bigint % 100) < 70 then 'train' when (('0x' || left(md5(o_orderkey::varchar), 7))::bigint % 100) < 85 then 'validate' else 'test' end as part from orders",
)
def t7(t: Tables):
    return sampling.hash_split(t.orders, "o_orderkey", {"train": 70, "validate": 15, "test": 15}).select("o_orderkey", "part")


@query("O1_union_all", "select s_nationkey as k from supplier union all select c_nationkey from customer")
def o1(t: Tables):
    return t.supplier.select(F.col("s_nationkey").alias("k")).unionByName(t.customer.select(F.col("c_nationkey").alias("k")))


@query("O2_union_distinct", "select l_suppkey as k from lineitem union select s_suppkey from supplier union select c_custkey from customer")
def o2(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("k")).union(t.supplier.select("s_suppkey")).union(t.customer.select("c_custkey")).distinct()


@query(
    "O3_concat_keep_first",
    "with a as (select subreddit_id, primary_topic as topic, 1 as src from cluster_labels union all select subreddit_id, curator_topic, 2 from df_tsne) select subreddit_id, topic from a where topic is not null qualify row_number() over (partition by subreddit_id order by src, topic) = 1",
)
def o3(t: Tables):
    a = t.cluster_labels.select("subreddit_id", F.col("primary_topic").alias("topic"), F.lit(1).alias("src"))
    b = t.df_tsne.select("subreddit_id", F.col("curator_topic").alias("topic"), F.lit(2).alias("src"))
    return R.dedupe_latest(a.unionByName(b).where("topic is not null"), ["subreddit_id"], [F.asc("src"), F.asc("topic")]).select("subreddit_id", "topic")


@query("O4_set_difference", "select subreddit_id from embeddings_community except select subreddit_id from cluster_labels")
def o4(t: Tables):
    return t.embeddings_community.select("subreddit_id").subtract(t.cluster_labels.select("subreddit_id"))


@query(
    "O5_set_overlap",
    "with i as (select distinct subreddit_id as id, 1 as s from embeddings_community union all select distinct subreddit_id, 2 from cluster_labels union all select distinct subreddit_id, 3 from df_tsne), f as (select id, bool_or(s = 1) as vectors, bool_or(s = 2) as clusters, bool_or(s = 3) as tsne from i where id is not null group by 1)"
    " select vectors, clusters, tsne, count(*) as n from f group by 1, 2, 3",
)
def o5(t: Tables):
    ids = lambda df: df.select(F.col("subreddit_id").alias("id"))
    return R.set_overlap(vectors=ids(t.embeddings_community), clusters=ids(t.cluster_labels), tsne=ids(t.df_tsne))
