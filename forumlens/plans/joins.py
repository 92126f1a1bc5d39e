"""Join operators (J). Only tables of a fixed size (nation, region, lookups) carry a broadcast hint; the rest is Catalyst's choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import relational as R
from forumlens.operators import vectors as V

from .registry import Tables, query


@query("J1_inner_join", "select o_orderkey, c_name from orders join customer on c_custkey = o_custkey")
def j1(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("J2_left_join", "select c_custkey, coalesce(n, 0)::bigint as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def j2(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    "J3_full_outer_three",
    "select coalesce(a.k, b.k, c.k) as k, customers, suppliers, late from (select c_nationkey as k, count(*) as customers from customer group by 1) a"
    " full join (select s_nationkey as k, count(*) as suppliers from supplier group by 1) b on a.k = b.k"
    " full join (select n_nationkey as k, 1::bigint as late from nation) c on coalesce(a.k, b.k) = c.k",
)
def j3(t: Tables):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = t.nation.select(F.col("n_nationkey").alias("k"), F.lit(1).cast("bigint").alias("late"))
    return R.full_outer(R.full_outer(a, b, ["k"]), c, ["k"])


@query(
    "J4_full_outer_fill",
    "select coalesce(a.subreddit_id, b.subreddit_id) as subreddit_id, coalesce(a.subreddit_name, b.subreddit_name) as subreddit_name, topic, posts from"
    " (select subreddit_id, min(lower(trim(subreddit_name))) as subreddit_name, min(primary_topic) as topic from cluster_labels where subreddit_id is not null group by 1) a full join"
    " (select subreddit_id, min(lower(trim(subreddit_name))) as subreddit_name, count(*) as posts from post_language_detection_cld3_clean where subreddit_id is not null group by 1) b on a.subreddit_id = b.subreddit_id",
)
def j4(t: Tables):
    name = F.min(F.lower(F.trim("subreddit_name"))).alias("subreddit_name")
    a = t.cluster_labels.where("subreddit_id is not null").groupBy("subreddit_id").agg(name, F.min("primary_topic").alias("topic"))
    b = t.post_language_detection_cld3_clean.where("subreddit_id is not null").groupBy("subreddit_id").agg(name, F.count(F.lit(1)).alias("posts"))
    return R.full_outer(a, b, ["subreddit_id"], ["subreddit_name"])


@query("J5_right_join", "select n_nationkey, count(s_suppkey) as suppliers from supplier right join nation on s_nationkey = n_nationkey group by 1")
def j5(t: Tables):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right")
    return joined.groupBy("n_nationkey").agg(F.count("s_suppkey").alias("suppliers"))


@query("J6_one_row_relation", "select s_suppkey, round(s_acctbal / (select max(s_acctbal) from supplier), 6) as part from supplier")
def j6(t: Tables):
    top = t.supplier.agg(F.max("s_acctbal").alias("top"))  # one row
    return t.supplier.join(F.broadcast(top), F.lit(True)).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("top"), 6).alias("part"))


@query("J7_scalar_subquery", "select o_orderkey from orders where o_totalprice > (select 1.5 * avg(o_totalprice) from orders)")
def j7(t: Tables):
    return t.spark.sql("select o_orderkey from {o} where o_totalprice > (select 1.5 * avg(o_totalprice) from {o})", o=t.orders)


@query("J8_semi_join_in", "select c_custkey from customer where c_custkey in (select distinct o_custkey from orders where o_orderpriority = '1-URGENT')")
def j8(t: Tables):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey")


@query("J9_semi_join_distinct", "select d.doc_id from documents d join (select distinct subreddit_id from embeddings_community where is_seed) s on s.subreddit_id = d.subreddit_id")
def j9(t: Tables):
    return t.documents.join(t.embeddings_community.where("is_seed"), "subreddit_id", "left_semi").select("doc_id")


@query("J10_anti_join", "select p_partkey from part left join lineitem on l_partkey = p_partkey and l_quantity > 45 where l_partkey is null")
def j10(t: Tables):
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("J11_self_join_pairs", "select a.n_nationkey as id_a, b.n_nationkey as id_b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def j11(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")).select(F.col("a.n_nationkey").alias("id_a"), F.col("b.n_nationkey").alias("id_b"))


_POSTS = "(select distinct post_id, dt from post_language_detection_cld3_clean where post_id is not null)"


@query(
    "J12_range_equi_join",
    f"select d.doc_id, p.dt::varchar as detected from documents d join {_POSTS} p on p.post_id = d.post_id and p.dt between d.submit_date and d.submit_date + 1",
)
def j12(t: Tables):
    p = t.post_language_detection_cld3_clean.where("post_id is not null").select("post_id", F.col("dt").alias("found")).distinct()
    near = t.documents.join(p, "post_id").where("found between submit_date and date_add(submit_date, 1)")
    return near.select("doc_id", F.col("found").cast("string").alias("detected"))


@query(
    "J13_point_in_time_join",
    "with daily as (select user_id, cast(ts as date) as d, count(*) as n from events group by 1, 2) select e.event_id, daily.n from events e join daily on daily.user_id = e.user_id and daily.d = cast(e.ts as date) - 1 where e.event_type = 'purchase'",
)
def j13(t: Tables):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    bought = t.events.where("event_type = 'purchase'").withColumn("d", F.date_sub(F.to_date("ts"), 1))
    return bought.join(daily, ["user_id", "d"]).select("event_id", "n")


@query(
    "J14_two_roles",
    "select a.n_name as customer_nation, b.n_name as supplier_nation, count(*) as n from customer join nation a on a.n_nationkey = c_nationkey join supplier on s_suppkey = c_custkey join nation b on b.n_nationkey = s_nationkey group by 1, 2",
)
def j14(t: Tables):
    a = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    b = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    both = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")).join(F.broadcast(a), "c_nationkey").join(F.broadcast(b), "s_nationkey")
    return both.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J15_left_join_unnest",
    "select s.subreddit_id, u.x.subreddit_id as other, u.x.distance_rank as distance_rank from similar_communities s left join lateral (select unnest(s.similar_subreddit) as x) u on true where s.model_version = 'v0.6.1'",
)
def j15(t: Tables):
    rows = t.similar_communities.where("model_version = 'v0.6.1'").select("subreddit_id", F.explode_outer("similar_subreddit").alias("x"))
    return rows.select("subreddit_id", F.col("x.subreddit_id").alias("other"), F.col("x.distance_rank").alias("distance_rank"))


@query("J16_cross_unnest", "select subreddit_id, x.subreddit_id as other from (select subreddit_id, unnest(similar_subreddit) as x from similar_communities)")
def j16(t: Tables):
    return t.similar_communities.select("subreddit_id", F.explode("similar_subreddit").alias("x")).select("subreddit_id", F.col("x.subreddit_id").alias("other"))


@query("J17_using", "select n_name, r_name from nation join (select r_regionkey as n_regionkey, r_name from region) using (n_regionkey)")
def j17(t: Tables):
    return t.nation.join(F.broadcast(t.region.withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey").select("n_name", "r_name")


@query("J18_index_merge", "select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on o_orderkey = l_orderkey")
def j18(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("J19_lookup_join", "select d.doc_id, l.language_name from documents d left join language_lookup l on l.language_code = d.lang")
def j19(t: Tables):
    names = F.broadcast(t.language_lookup.select(F.col("language_code").alias("lang"), "language_name"))  # a fixed lookup
    return t.documents.join(names, "lang", "left").select("doc_id", "language_name")


@query(
    "J20_seed_and_neighbours",
    "with n as (select s.subreddit_id as seed, u.x.subreddit_id as id from similar_communities s, lateral (select unnest(s.similar_subreddit) as x) u where u.x.subreddit_id is not null),"
    " all_ids as (select id, count(*) as links from (select distinct seed, id from n union select distinct seed, seed from n) group by id),"
    " target as (select distinct subreddit_id as id from cluster_labels where subreddit_id is not null)"
    " select coalesce(a.id, b.id) as id, coalesce(links, 0)::bigint as links, b.id is not null as is_target from all_ids a full join target b on a.id = b.id",
)
def j20(t: Tables):
    n = t.similar_communities.select(F.col("subreddit_id").alias("seed"), F.explode("similar_subreddit.subreddit_id").alias("id")).where("id is not null")
    both = n.select("seed", "id").union(n.select("seed", F.col("seed").alias("id"))).distinct()
    links = both.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    target = t.cluster_labels.where("subreddit_id is not null").select(F.col("subreddit_id").alias("id")).distinct().withColumn("is_target", F.lit(True))
    joined = R.full_outer(links, target, ["id"])
    return joined.select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("is_target", F.lit(False)).alias("is_target"))


@query(
    "J21_vector_join",
    "with x as (select vec_id, embedding::double[] as e from embeddings), p as (select a.vec_id as id_a, b.vec_id as id_b, list_cosine_similarity(a.e, b.e) as c from x a, x b where a.vec_id <> b.vec_id)"
    " select id_a, id_b, round(c, 4) as cosine_similarity from p qualify row_number() over (partition by id_a order by c desc, id_b) <= 1",
)
def j21(t: Tables):
    best = V.cosine_topk(t.embeddings, "vec_id", "embedding", 1)
    return best.select("id_a", "id_b", F.round("cosine_similarity", 4).alias("cosine_similarity"))
