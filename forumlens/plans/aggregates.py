"""Aggregation operators (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from forumlens.operators import metrics
from forumlens.operators import relational as R

from .registry import Tables, query

_GRADED = "(select p_partkey, case when p_size > 25 then 'big' else 'small' end as truth, case when p_partkey % 3 = 0 then 'big' else 'small' end as found from part)"


def graded(t: Tables):
    size = F.when(F.col("p_size") > 25, "big").otherwise("small").alias("truth")
    return t.part.select("p_partkey", size, F.when(F.col("p_partkey") % 3 == 0, "big").otherwise("small").alias("found"))


@query(
    "A1_group_by",
    "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price, min(l_discount) as least, max(l_tax) as most, count(*) as n from lineitem group by 1, 2",
)
def a1(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.min("l_discount").alias("least"), F.max("l_tax").alias("most"), F.count(F.lit(1)).alias("n"),
    )


@query("A2_count_distinct", "select event_type, count(distinct user_id) as users from events group by 1")
def a2(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query(
    "A3_conditional_aggregates",
    "select user_id, count(case when event_type = 'click' then 1 end) as clicks, round(sum(case when event_type = 'purchase' then value else 0 end), 4) as bought, count(distinct case when event_type = 'view' then cast(ts as date) end) as view_days from events group by 1",
)
def a3(t: Tables):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.count(F.when(kind == "click", 1)).alias("clicks"), F.round(F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0)), 4).alias("bought"),
        F.count_distinct(F.when(kind == "view", F.to_date("ts"))).alias("view_days"),
    )


@query("A4_ordered_string_agg", "select n_regionkey, string_agg(n_name, ', ' order by n_name desc) as names from nation group by 1")
def a4(t: Tables):
    return t.spark.sql("select n_regionkey, listagg(n_name, ', ') within group (order by n_name desc) as names from {n} group by 1", n=t.nation)


@query("A5_distinct_string_agg", "select source, string_agg(distinct lower(trim(lang)), ', ' order by lower(trim(lang))) as langs from documents group by 1")
def a5(t: Tables):
    return t.spark.sql("select source, listagg(distinct bare, ', ') within group (order by bare) as langs from (select source, lower(trim(lang)) as bare from {d}) group by 1", d=t.documents)


@query(
    "A6_top_n_string_agg",
    "select c_nationkey, string_agg(c_name, ', ' order by c_acctbal desc, c_custkey) as best from (select * from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 5) group by 1",
)
def a6(t: Tables):
    top = R.top_n(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "c_name"))), lambda s: s["c_name"])
    return top.groupBy("c_nationkey").agg(F.array_join(names, ", ").alias("best"))


@query(
    "A7_array_of_structs",
    "select s_nationkey, string_agg(s_suppkey::varchar || ':' || round(s_acctbal, 2)::varchar, ';' order by s_acctbal desc, s_suppkey) as list from supplier group by 1",
)
def a7(t: Tables):
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("o"), "s_suppkey", "s_acctbal")))
    shown = F.array_join(F.transform(ordered, lambda s: F.concat(s["s_suppkey"].cast("string"), F.lit(":"), F.round(s["s_acctbal"], 2).cast("string"))), ";")
    return t.supplier.groupBy("s_nationkey").agg(shown.alias("list"))


@query("A8_count_over_window", "select event_type, user_id, count(*) as n, count(*) over (partition by event_type) as users from events group by 1, 2")
def a8(t: Tables):
    n = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("users", F.count(F.lit(1)).over(Window.partitionBy("event_type")))


@query("A9_any_value", "select o_custkey, any_value(c_name) as c_name, count(*) as n from orders join customer on c_custkey = o_custkey group by 1")
def a9(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_custkey").agg(F.any_value("c_name").alias("c_name"), F.count(F.lit(1)).alias("n"))


@query("A10_quantiles", "select source, quantile_disc(n_chars, 0.25) as p25, quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.9) as p90 from documents group by 1")
def a10(t: Tables):
    q = ", ".join(f"percentile_disc({p}) within group (order by n_chars) as {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.9, "p90")))
    return t.spark.sql(f"select source, cast(p25 as bigint) p25, cast(p50 as bigint) p50, cast(p90 as bigint) p90 from (select source, {q} from {{d}} group by 1)", d=t.documents)


@query("A11_stddev", "select s_nationkey, round(coalesce(stddev_samp(s_acctbal), 0), 4) as sd from supplier group by 1")
def a11(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.round(F.coalesce(F.stddev_samp("s_acctbal"), F.lit(0.0)), 4).alias("sd"))


@query("A12_distinct", "select distinct l_partkey, l_suppkey from lineitem")
def a12(t: Tables):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("A13_keep_first", "select subreddit_id, pt::varchar as pt, is_seed from embeddings_community qualify row_number() over (partition by subreddit_id order by pt desc, is_seed desc, posts_for_embeddings_count desc) = 1")
def a13(t: Tables):
    kept = R.dedupe_latest(t.embeddings_community, ["subreddit_id"], [F.desc("pt"), F.desc("is_seed"), F.desc("posts_for_embeddings_count")])
    return kept.select("subreddit_id", F.col("pt").cast("string").alias("pt"), "is_seed")


@query("A14_named_aggregates", "select c_mktsegment, count(distinct c_nationkey) as nations, round(median(c_acctbal), 4) as mid, len(list(c_custkey)) as customers from customer group by 1")
def a14(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(
        F.count_distinct("c_nationkey").alias("nations"), F.round(F.median("c_acctbal"), 4).alias("mid"), F.count("c_custkey").alias("customers")
    )


@query(
    "A15_value_counts",
    "select value, n, round(n / sum(n) over (), 6) as percent, round(sum(n) over (order by n desc, value nulls first rows unbounded preceding) / sum(n) over (), 6) as cumulative_percent from (select o_orderpriority as value, count(*) as n from orders group by 1)",
)
def a15(t: Tables):
    return R.value_counts(t.orders, "o_orderpriority").select("value", "n", F.round("percent", 6).alias("percent"), F.round("cumulative_percent", 6).alias("cumulative_percent"))


@query(
    "A16_column_profile",
    " union all ".join(
        f"select '{c}' as \"column\", count({c}) as n, count(distinct {c}) as uniques, count(*) - count({c}) as nulls, round((count(*) - count({c})) / count(*), 6) as null_percent from documents"
        for c in ("lang", "source", "user_id", "upvotes")
    ),
)
def a16(t: Tables):
    return R.profile(t.documents, ["lang", "source", "user_id", "upvotes"]).withColumn("null_percent", F.round("null_percent", 6))


@query(
    "A17_majority_label",
    "select cluster_label, primary_topic as majority from (select cluster_label, primary_topic, count(*) as n from cluster_labels where primary_topic is not null group by 1, 2) qualify row_number() over (partition by cluster_label order by n desc, primary_topic) = 1",
)
def a17(t: Tables):
    return R.majority(t.cluster_labels, ["cluster_label"], "primary_topic")


@query(
    "A18_counts_wide",
    "select o_orderstatus, count(*) as total, " + ", ".join(f"count(case when o_orderpriority = '{v}' then 1 end) as \"{v}_count\", round(count(case when o_orderpriority = '{v}' then 1 end) / count(*), 6) as \"{v}_percent\"" for v in ("1-URGENT", "2-HIGH")) + " from orders group by 1",
)
def a18(t: Tables):
    wide = R.counts_wide(t.orders, ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return wide.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in wide.columns if c.endswith("_percent")})


@query("A19_counts_long", "select source, lang, count(*) as n, round(count(*) / sum(count(*)) over (partition by source), 6) as share from documents group by 1, 2")
def a19(t: Tables):
    return R.share_of_total(t.documents, ["source"], ["lang"]).withColumn("share", F.round("share", 6))


@query(
    "A20_row_argmax",
    "select subreddit_id, kind as best, v as most from (select subreddit_id, kind, max(v) as v from (select subreddit_id, 'k_0023' as kind, k_0023_label as v from cluster_labels union all select subreddit_id, 'k_0097', k_0097_label from cluster_labels) where v is not null group by 1, 2) qualify row_number() over (partition by subreddit_id order by v desc, kind) = 1",
)
def a20(t: Tables):
    long = R.stack(t.cluster_labels.select("subreddit_id", F.col("k_0023_label").alias("k_0023"), F.col("k_0097_label").alias("k_0097")), ["subreddit_id"], ["k_0023", "k_0097"], "kind", "v")
    best = long.groupBy("subreddit_id", "kind").agg(F.max("v").alias("v"))
    return R.dedupe_latest(best, ["subreddit_id"], [F.desc("v"), F.asc("kind")]).select("subreddit_id", F.col("kind").alias("best"), F.col("v").alias("most"))


@query("A21_head_per_group", "select s_nationkey, s_suppkey from supplier qualify row_number() over (partition by s_nationkey order by s_suppkey) <= 2")
def a21(t: Tables):
    return R.top_n(t.supplier, ["s_nationkey"], [F.asc("s_suppkey")], 2).select("s_nationkey", "s_suppkey")


@query(
    "A22_weighted_mean_vector",
    "select label, pos, round(sum(w * x) / sum(w), 5) as v from (select label, ln(2 + vec_id) as w, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2",
)
def a22(t: Tables):
    from forumlens.operators import vectors as V

    means = V.mean_vector(t.embeddings, ["label"], "embedding", F.log(2 + F.col("vec_id")))
    return means.select("label", F.posexplode("vector").alias("pos", "v")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("v", 5).alias("v"))


_REPORT = (
    f"select label, support, predicted, hits, coalesce(hits / nullif(predicted, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall from"
    f" (select truth as label, count(*) as support, count(case when truth = found then 1 end) as hits from {_GRADED} group by 1) a join (select found as label, count(*) as predicted from {_GRADED} group by 1) b using (label)"
)


@query("A23_recall_precision", f"select label, round(precision, 6) as precision, round(recall, 6) as recall from ({_REPORT})")
def a23(t: Tables):
    return metrics.class_report(graded(t), "truth", "found").select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "A24_averaged_metrics",
    f"with r as ({_REPORT}), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from r)"
    " select 'macro' as average, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f"
    " union all select 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) from f",
)
def a24(t: Tables):
    out = metrics.averages(metrics.class_report(graded(t), "truth", "found"))
    return out.select("average", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("A24_confusion_matrix", f"select truth, count(case when found = 'big' then 1 end) as big, count(case when found = 'small' then 1 end) as small from {_GRADED} group by 1")
def a24b(t: Tables):
    return metrics.confusion(graded(t), "truth", "found", ["big", "small"])


@query("A25_two_level_distinct", "select event_type, count(*) as user_days, count(distinct user_id) as users from (select distinct event_type, user_id, cast(ts as date) as d from events) group by 1")
def a25(t: Tables):
    once = t.events.select("event_type", "user_id", F.to_date("ts").alias("d")).distinct()
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("user_days"), F.count_distinct("user_id").alias("users"))


@query("A26_uniqueness", "select count(*) as row_count, count(distinct comment_id) as unique_count from comment_language_detection_cld3_clean")
def a26(t: Tables):
    return R.uniqueness(t.comment_language_detection_cld3_clean, ["comment_id"])
