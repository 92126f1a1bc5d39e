"""Date, time, math and conditional operators (DT, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import scalars as S

from .registry import Tables, query

AS_OF = "2024-01-30"


@query("DT1_date_and_timestamp", "select event_id, cast(ts as date)::varchar as d, strftime(cast(cast(ts as date) as timestamp), '%Y-%m-%d %H:%M:%S') as midnight from events")
def dt1(t: Tables):
    d = F.to_date("ts")
    return t.events.select("event_id", d.cast("string").alias("d"), F.date_format(d.cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("midnight"))


@query("DT2_date_arithmetic", "select doc_id, (submit_date + 7)::varchar as later, (submit_date - 30)::varchar as sooner from documents")
def dt2(t: Tables):
    return t.documents.select("doc_id", F.date_add("submit_date", 7).cast("string").alias("later"), F.date_sub("submit_date", 30).cast("string").alias("sooner"))


@query("DT3_trailing_windows", "select user_id, " + ", ".join(f"count(case when cast(ts as date) > date '{AS_OF}' - {n} and cast(ts as date) <= date '{AS_OF}' then 1 end) as t{n}" for n in (7, 14, 30)) + " from events group by 1")
def dt3(t: Tables):
    as_of, d = F.lit(AS_OF).cast("date"), F.to_date("ts")
    return t.events.groupBy("user_id").agg(*(F.count(F.when(S.within_days(d, as_of, n), 1)).alias(f"t{n}") for n in (7, 14, 30)))


@query("DT4_as_of", f"select event_id from events where cast(ts as date) = date '{AS_OF}' - 1")
def dt4(t: Tables):
    return t.events.where(F.to_date("ts") == F.date_sub(F.lit(AS_OF).cast("date"), 1)).select("event_id")


@query("DT5_truncate", "select event_id, strftime(date_trunc('hour', ts - interval 90 minute), '%Y-%m-%d %H') as hour from events")
def dt5(t: Tables):
    return t.events.select("event_id", F.date_format(F.date_trunc("hour", F.col("ts") - F.expr("interval 90 minutes")), "yyyy-MM-dd HH").alias("hour"))


@query("DT6_calendar_difference", "select o_orderkey, date_diff('month', o_orderdate, timestamp '1998-01-01') as months, date_diff('year', o_orderdate, timestamp '1998-01-01') as years from orders")
def dt6(t: Tables):
    end = F.lit("1998-01-01").cast("date")
    return t.orders.select(
        "o_orderkey", S.months_between_calendar(end, F.col("o_orderdate")).cast("bigint").alias("months"), (F.year(end) - F.year("o_orderdate")).cast("bigint").alias("years")
    )


@query("DT7_parse_timestamp", "select distinct strftime(ts, '%Y%m%d') as compact, strftime(strptime(strftime(ts, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') as parsed from events")
def dt7(t: Tables):
    compact = F.date_format("ts", "yyyyMMdd")
    return t.events.select(compact.alias("compact"), F.date_format(F.to_timestamp(compact, "yyyyMMdd"), "yyyy-MM-dd").alias("parsed")).distinct()


@query("DT8_extract", "select year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, count(*) as n from orders group by 1, 2")
def dt8(t: Tables):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query("DT9_days_active", "select user_id, min(cast(ts as date))::varchar as first, max(cast(ts as date))::varchar as last, count(distinct cast(ts as date)) as days from events group by 1")
def dt9(t: Tables):
    d = F.to_date("ts")
    return t.events.groupBy("user_id").agg(F.min(d).cast("string").alias("first"), F.max(d).cast("string").alias("last"), F.count_distinct(d).alias("days"))


@query("DT10_backfill", "select d::varchar as d, count(*) as n from (select unnest([date '2024-01-05', date '2024-01-12', date '2024-01-19']) as d) join events on cast(ts as date) = d group by 1")
def dt10(t: Tables):
    # The days of a backfill are one relation; the job over them is one plan instead of one per day.
    days = t.spark.createDataFrame([("2024-01-05",), ("2024-01-12",), ("2024-01-19",)], "d string")
    joined = t.events.select(F.to_date("ts").cast("string").alias("d")).join(F.broadcast(days), "d")
    return joined.groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query("M1_log_feature", "select doc_id, round(ln(1 + coalesce(greatest(upvotes, 0), 0)), 6) as v from documents")
def m1(t: Tables):
    return t.documents.select("doc_id", F.round(S.log_feature(F.when(F.col("upvotes") >= 0, F.col("upvotes")).otherwise(F.when(F.col("upvotes") < 0, 0))), 6).alias("v"))


@query("M2_safe_divide", "select user_id, round(buys / nullif(clicks, 0), 6) as rate from (select user_id, count(case when event_type = 'purchase' then 1 end) as buys, count(case when event_type = 'error' then 1 end) as clicks from events group by 1)")
def m2(t: Tables):
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    g = t.events.groupBy("user_id").agg(kind("purchase").alias("buys"), kind("error").alias("clicks"))
    return g.select("user_id", F.round(S.safe_divide(F.col("buys"), F.col("clicks")), 6).alias("rate"))


@query("M3_natural_log", "select p_partkey, round(ln(p_retailprice), 8) as v from part")
def m3(t: Tables):
    return t.part.select("p_partkey", F.round(F.log("p_retailprice"), 8).alias("v"))


@query("M4_round_abs_mod", "select c_custkey, round(abs(c_acctbal), 1) as a, (c_custkey % 7)::bigint as m from customer")
def m4(t: Tables):
    return t.customer.select("c_custkey", F.round(F.abs("c_acctbal"), 1).alias("a"), F.pmod("c_custkey", F.lit(7)).cast("bigint").alias("m"))


@query("M5_greatest_strict", "select subreddit_id, pt::varchar as pt, case when users_l7 is null or posts_l7 is null then null else greatest(users_l7, posts_l7) end as g from df_tsne")
def m5(t: Tables):
    return t.df_tsne.select("subreddit_id", F.col("pt").cast("string").alias("pt"), S.greatest_strict(F.col("users_l7"), F.col("posts_l7")).alias("g"))


_COHORT = "case when n >= 60 then 4 when n >= 40 then 3 when n >= 20 then 2 when n >= 1 then 1 else 0 end"


@query("M6_case_chain", f"select user_id, ({_COHORT})::int as cohort from (select user_id, count(*) as n from events group by 1)")
def m6(t: Tables):
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", S.bins(F.col("n"), [1, 20, 40, 60]).alias("cohort"))


@query("M7_if_coalesce", "select doc_id, coalesce(case when upvotes > 10 then lang end, source, '-') as v from documents")
def m7(t: Tables):
    return t.documents.select("doc_id", F.coalesce(F.when(F.col("upvotes") > 10, F.col("lang")), "source", F.lit("-")).alias("v"))


@query("M8_integer_ratio", "select p_partkey, round(p_size / 7, 6) as v from part")
def m8(t: Tables):
    return t.part.select("p_partkey", F.round(F.col("p_size") / 7, 6).alias("v"))


_Z = "select s_suppkey, case when coalesce(stddev_samp(s_acctbal) over w, 0) = 0 then 0.5 else (s_acctbal - avg(s_acctbal) over w) / stddev_samp(s_acctbal) over w end as z from supplier window w as (partition by s_nationkey)"


def z_scores(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    return t.supplier.select("s_suppkey", S.z_score(F.col("s_acctbal"), F.avg("s_acctbal").over(w), F.stddev_samp("s_acctbal").over(w), 0.5).alias("z"))


@query("M9_z_score", f"select s_suppkey, round(z, 5) as z from ({_Z})")
def m9(t: Tables):
    return z_scores(t).withColumn("z", F.round("z", 5))


@query("M10_combined_score", f"select s_suppkey, round(0.8::double * 0.5 + 0.2::double * case when z > 5 then 1 when z > 0 then z / 5 else 0 end, 6) as score from ({_Z})")
def m10(t: Tables):
    return z_scores(t).select("s_suppkey", F.round(S.combined_score(F.lit(0.5), F.col("z")), 6).alias("score"))


@query("M11_significance", f"select s_suppkey from ({_Z}) where abs(z) > 1.5")
def m11(t: Tables):
    return z_scores(t).where(S.is_significant(F.col("z"), 1.5)).select("s_suppkey")


@query("M12_bins", "select p_partkey, (case when p_size < 10 then 0 when p_size < 20 then 1 when p_size < 40 then 2 else 3 end)::int as bin, ntile(4) over (order by p_retailprice, p_partkey)::int as quarter from part")
def m12(t: Tables):
    from pyspark.sql import Window

    return t.part.select("p_partkey", S.bins(F.col("p_size"), [10, 20, 40]).alias("bin"), F.ntile(4).over(Window.orderBy("p_retailprice", "p_partkey")).alias("quarter"))


@query("M13_safe_cast", "select subreddit_id, try_cast(cluster_label as int) as n from cluster_labels")
def m13(t: Tables):
    return t.cluster_labels.select("subreddit_id", F.col("cluster_label").try_cast("int").alias("n"))
