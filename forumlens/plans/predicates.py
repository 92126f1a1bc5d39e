"""Projection, filter and predicate operators (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import predicates as P
from forumlens.operators import relational as R

from .registry import Tables, query


@query("P1_projection", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def p1(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("P2_star_except", "select * exclude (c_acctbal, c_mktsegment) from customer")
def p2(t: Tables):
    return t.customer.drop("c_acctbal", "c_mktsegment")


@query("P3_qualified_star", "select n.*, r.r_name from nation n join region r on r.r_regionkey = n.n_regionkey")
def p3(t: Tables):
    return t.nation.alias("n").join(F.broadcast(t.region.alias("r")), F.expr("r.r_regionkey = n.n_regionkey")).select("n.*", "r.r_name")


@query("P4_columns_to_front", "select s_name, s_suppkey, s_nationkey, s_acctbal from supplier")
def p4(t: Tables):
    return R.column_order(t.supplier, ["s_name"])


@query("P5_case_normalised_filter", "select subreddit_id, pt::varchar as pt from df_tsne where lower(trim(curator_topic)) = 'gaming'")
def p5(t: Tables):
    return t.df_tsne.where(P.same_text(F.col("curator_topic"), F.lit("GAMING"))).select("subreddit_id", F.col("pt").cast("string").alias("pt"))


@query("P6_null_safe_guard", "select post_id, dt::varchar as dt from post_language_detection_cld3_clean where coalesce(is_deleted, false) = false")
def p6(t: Tables):
    return t.post_language_detection_cld3_clean.where(~F.coalesce("is_deleted", F.lit(False))).select("post_id", F.col("dt").cast("string").alias("dt"))


@query(
    "P7_soft_removed",
    "select p.post_id, count(*) as n from post_language_detection_cld3_clean p left join (select post_id, max(upvotes) as upvotes from documents group by 1) d on d.post_id = p.post_id"
    " where coalesce(removed, 0) = 0 or (removed = 1 and coalesce(d.upvotes, 0) >= 20) group by 1",
)
def p7(t: Tables):
    votes = t.documents.groupBy("post_id").agg(F.max("upvotes").alias("upvotes"))
    kept = t.post_language_detection_cld3_clean.join(votes, "post_id", "left").where(P.not_soft_removed("removed", "upvotes", 20))
    return kept.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))


@query("P8_flag_or_approved", "select p_partkey from part where not (p_size > 25) or (p_size > 25 and p_brand in ('Brand#11', 'Brand#22'))")
def p8(t: Tables):
    return t.part.where(P.unless_flagged(F.col("p_size") > 25, F.col("p_brand"), ["Brand#11", "Brand#22"])).select("p_partkey")


@query("P9_regex_filter", "select subreddit_name from cluster_labels where subreddit_name is not null and not regexp_matches(lower(subreddit_name), '^[a-m]') group by 1")
def p9(t: Tables):
    return t.cluster_labels.where(~F.lower("subreddit_name").rlike("^[a-m]")).select("subreddit_name").distinct()


@query("P10_like", "select p_partkey, p_name from part where p_name like '%a%' and p_name not like '%e_%'")
def p10(t: Tables):
    return t.part.where(F.col("p_name").like("%a%") & ~F.col("p_name").like("%e_%")).select("p_partkey", "p_name")


@query("P11_in_list", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority in ('1-URGENT', '2-HIGH')")
def p11(t: Tables):
    return t.orders.where(F.col("o_orderstatus").isin("F", "P") & F.array_contains(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("o_orderpriority"))).select("o_orderkey")


@query(
    "P12_block_list",
    "select doc_id from documents where text is not null and lower(trim(text)) not in (select lower(trim(text)) from documents where text is not null group by 1 having count(*) >= 3)",
)
def p12(t: Tables):
    said = t.documents.where("text is not null").withColumn("bare", F.lower(F.trim("text")))
    boilerplate = said.groupBy("bare").count().where("count >= 3").select("bare")
    return said.join(boilerplate, "bare", "left_anti").select("doc_id")


@query("P13_date_window", "select o_orderkey from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1995-03-31'")
def p13(t: Tables):
    return t.orders.where(F.col("o_orderdate").between("1995-01-01", "1995-03-31")).select("o_orderkey")


@query("P14_blank_guard", "select doc_id from documents where coalesce(text, '') <> ''")
def p14(t: Tables):
    return t.documents.where(P.not_blank("text")).select("doc_id")


@query("P15_having", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 12")
def p15(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("P16_qualify", "select c_nationkey, c_custkey from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) = 1")
def p16(t: Tables):
    return R.dedupe_latest(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey")


@query("P17_mask_with_missing", "select subreddit_id, model_sort_order from cluster_labels where primary_topic is distinct from 'Gaming'")
def p17(t: Tables):
    return t.cluster_labels.where(R.not_equal_or_null(F.col("primary_topic"), "Gaming")).select("subreddit_id", "model_sort_order")


@query("P18_keyword_removal", "select subreddit_name from cluster_labels where not (contains(lower(subreddit_name), 'drill') or contains(lower(subreddit_name), 'garden')) group by 1")
def p18(t: Tables):
    return t.cluster_labels.where(~P.contains_any(F.lower("subreddit_name"), ["drill", "garden"])).select("subreddit_name").distinct()


@query("P19_prefix_block_list", "select subreddit_id, cluster_label from cluster_labels where cluster_label is null or not (cluster_label like '0001%' or cluster_label like '0010%')")
def p19(t: Tables):
    return t.cluster_labels.where(~F.coalesce(P.starts_with_any(F.col("cluster_label"), ["0001", "0010"]), F.lit(False))).select("subreddit_id", "cluster_label")


@query("P20_enough_documents", "select subreddit_id, pt::varchar as pt from embeddings_community where posts_for_embeddings_count >= 3 and is_seed")
def p20(t: Tables):
    kept = t.embeddings_community.where((F.col("posts_for_embeddings_count") >= 3) & F.col("is_seed"))
    return kept.select("subreddit_id", F.col("pt").cast("string").alias("pt"))
