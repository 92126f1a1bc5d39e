"""Scans, sources, sinks and table management (S and K operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.sources import store
from forumlens.sources.catalog import table

from .registry import Tables, query


@query("S1_partitioned_scan", "select event_id, user_id, event_type from events where cast(ts as date) = date '2024-01-15'")
def s1(t: Tables):
    day = (F.col("ts") >= "2024-01-15") & (F.col("ts") < "2024-01-16")
    return t.events.where(day).select("event_id", "user_id", "event_type")


@query("S2_latest_partition", "select subreddit_id, users_l7 from df_tsne where pt = (select max(pt) from df_tsne)")
def s2(t: Tables):
    return store.latest_partition(t.df_tsne, "pt").select("subreddit_id", "users_l7")


@query("S3_snapshot_clamp", "select subreddit_id, loaded_at::varchar as loaded from df_tsne where pt = greatest(date '2019-01-10', date '2019-01-14')")
def s3(t: Tables):
    pt = F.greatest(F.lit("2019-01-10").cast("date"), F.lit("2019-01-14").cast("date"))
    return t.df_tsne.where(F.col("pt") == pt).select("subreddit_id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@query("S4_pruned_scan", "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '1998-06-01'")
def s4(t: Tables):
    return t.lineitem.where("l_shipdate >= timestamp '1998-06-01'").select("l_orderkey", "l_quantity")


@query("S5_file_slice", "select r_regionkey, r_name from region")
def s5(t: Tables):
    return store.file_slice(t.spark, t.sf_dir, "region.parquet", 0, None).select("r_regionkey", "r_name")


@query("S6_rows_by_file", "select count(*) as files_rows, 1::bigint as files from supplier")
def s6(t: Tables):
    rows = t.supplier.select(F.input_file_name().alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.sum("n").alias("files_rows"), F.least(F.count(F.lit(1)), F.lit(1).cast("bigint")).alias("files"))


@query("S7_templated_scan", "select p_partkey, p_brand from part where p_size >= 40")
def s7(t: Tables):
    return store.templated(t.spark, "select {columns} from {source} where p_size >= :least", {"least": 40}, columns=["p_partkey", "p_brand"], source=t.part)


@query("S8_run_artifact", "select n_nationkey, n_name from nation")
def s8(t: Tables):
    return store.read_artifact(t.spark, t.sf_dir, "", "nation.parquet").select("n_nationkey", "n_name")


@query("S9_csv_rows", "select c_custkey, c_name from customer")
def s9(t: Tables):
    lines = t.customer.select(F.concat_ws(",", "c_custkey", "c_name").alias("line"))
    return lines.select(F.from_csv("line", "c_custkey bigint, c_name string").alias("r")).select("r.*")


@query("S10_multi_run_scan", "select s_suppkey as id, s_name as name from supplier union all select c_custkey, c_name from customer")
def s10(t: Tables):
    return store.concat_runs([t.supplier.selectExpr("s_suppkey id", "s_name name"), t.customer.selectExpr("c_name name", "c_custkey id")])


@query("S11_constant_relation", "select * from (values ('KP', 'North Korea'), ('XK', 'Kosovo'), ('FK', 'Falkland Islands')) v(code, country_name)")
def s11(t: Tables):
    return t.spark.createDataFrame([("KP", "North Korea"), ("XK", "Kosovo"), ("FK", "Falkland Islands")], "code string, country_name string")


@query("S12_array_relation", "select unnest(['en', 'de', 'fr']) as code")
def s12(t: Tables):
    return t.spark.range(1).select(F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("fr"))).alias("code"))


@query("S13_external_table", "select s_nationkey, count(*) as n from supplier group by s_nationkey")
def s13(t: Tables):
    view = store.external_view(t.spark, "forumlens_supplier_external", f"{t.sf_dir}/supplier.parquet")
    return t.spark.sql(f"select s_nationkey, count(*) as n from {view} group by s_nationkey")


@query("S14_sheet_scan", "select lower(trim(language_name)) as language_name, min(language_code) as language_code from language_lookup group by 1")
def s14(t: Tables):
    raw = t.language_lookup.select(F.col("language_name").alias(" Language Name "), F.col("language_code").alias("Language Code"))
    sheet = store.clean_header(raw)
    return sheet.groupBy(F.lower(F.trim("language_name")).alias("language_name")).agg(F.min("language_code").alias("language_code"))


@query(
    "S15_reference_seeds",
    "select subreddit_name, seed_no, seed from (select lower(trim(subreddit_name)) as subreddit_name, 'primary_topic' as seed_no, lower(trim(primary_topic)) as seed from cluster_labels"
    " union all select lower(trim(subreddit_name)), 'cluster_majority_primary_topic', lower(trim(cluster_majority_primary_topic)) from cluster_labels) where seed is not null",
)
def s15(t: Tables):
    return store.reference_seeds(t.cluster_labels, "subreddit_name", ["primary_topic", "cluster_majority_primary_topic"])


@query("K1_create_table_as", "select o_orderstatus, count(*) as n from orders group by 1")
def k1(t: Tables):
    return store.write_and_read(t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "k1")


@query("K2_partitioned_table", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2")
def k2(t: Tables):
    counted = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return store.write_and_read(counted, "k2", partition_by=["o_orderstatus"])


@query("K3_clustered_table", "select user_id, sum(value) as total from (select user_id, round(sum(value), 4) as value from events group by user_id) group by user_id")
def k3(t: Tables):
    totals = t.events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return store.write_and_read(totals, "k3", cluster_by=["user_id"])


@query("K4_partition_upsert", "select n_regionkey, n_nationkey, case when n_regionkey = 1 then upper(n_name) || '!' else n_name end as n_name from nation")
def k4(t: Tables):
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    path = store.scratch(t.spark, "k4")
    store.overwrite_partitions(rows, path, ["n_regionkey"])
    store.overwrite_partitions(rows.where("n_regionkey = 1").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), path, ["n_regionkey"])
    return t.spark.read.parquet(path)


@query("K5_upsert_into_missing", "select n_regionkey, n_nationkey from nation where n_regionkey <= 1")
def k5(t: Tables):
    path = store.scratch(t.spark, "k5")
    store.overwrite_partitions(t.nation.where("n_regionkey <= 1").select("n_nationkey", "n_regionkey"), path, ["n_regionkey"])
    return t.spark.read.parquet(path)


@query("K6_temp_table", "select event_type, count(*) as n from events where value > 0 group by event_type")
def k6(t: Tables):
    with store.temp_view(t.events.where("value > 0"), "tmp_events") as name:
        return t.spark.sql(f"select event_type, count(*) as n from {name} group by event_type")


@query("K7_staging_to_prod", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 2")
def k7(t: Tables):
    staging, prod = store.scratch(t.spark, "k7-staging"), store.scratch(t.spark, "k7-prod")
    store.overwrite_partitions(t.nation.select("n_nationkey", "n_name", "n_regionkey"), staging, ["n_regionkey"])
    store.copy_partition(t.spark, staging, prod, "n_regionkey", 2)
    return t.spark.read.parquet(prod)


@query("K8_view", "select c_nationkey, count(*) as customers from customer group by 1")
def k8(t: Tables):
    t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")).createOrReplaceTempView("forumlens_customers")
    return t.spark.table("forumlens_customers")


@query("K9_parquet_export", "select region.r_name, nation.n_name from region join nation on n_regionkey = r_regionkey")
def k9(t: Tables):
    named = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return store.write_and_read(named, "k9")


@query("K10_sized_chunks", "select count(*) as n, sum(s_suppkey)::bigint as keys from supplier")
def k10(t: Tables):
    path = store.scratch(t.spark, "k10")
    store.write_chunks(t.supplier, path, target_mb=64, bytes_per_row=60)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys"))


@query("K11_ndjson_with_metadata", "select 'v1' as model_version, vec_id, round(embedding[1]::double, 5) as first, len(embedding)::int as dims from embeddings")
def k11(t: Tables):
    path = store.scratch(t.spark, "k11")
    store.write_ndjson(t.embeddings.select("vec_id", "embedding"), path, {"model_version": "v1"})
    back = t.spark.read.schema("model_version string, vec_id bigint, embedding array<float>").json(path)
    return back.select("model_version", "vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.size("embedding").alias("dims"))


@query(
    "K12_nested_ndjson",
    "select c_nationkey, rnk, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rnk from customer) where rnk <= 3",
)
def k12(t: Tables):
    path = store.scratch(t.spark, "k12")
    store.write_nested_ndjson(t.customer, path, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], ["c_custkey"], 3)
    back = t.spark.read.schema("c_nationkey int, records array<struct<rnk: bigint, c_custkey: bigint>>").json(path)
    return back.select("c_nationkey", F.explode("records").alias("r")).select("c_nationkey", "r.*")


@query("K13_geo_seed_json", "select n_regionkey, json_group_object(n_name, n_nationkey) is not null as has_json, count(*) as seeds from nation group by 1")
def k13(t: Tables):
    seeds = t.nation.groupBy("n_regionkey", "n_name").agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("string"))).alias("ids"))
    lists = store.nested_json(seeds, "n_regionkey", "n_name", "ids")
    return lists.select("n_regionkey", F.col("json").isNotNull().alias("has_json"), F.size(F.from_json("json", "map<string,array<string>>")).cast("bigint").alias("seeds"))


@query("K14_load_with_expiry", "select n_regionkey, count(*) as n from nation where n_regionkey >= 2 group by 1")
def k14(t: Tables):
    path = store.scratch(t.spark, "k14")
    store.load_partitions(t.nation.select("n_nationkey", "n_regionkey"), path, "n_regionkey", keep_from=2)
    return t.spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("K15_bulk_load", "select count(*) as n from part")
def k15(t: Tables):
    return store.write_and_read(t.spark.read.parquet(f"{t.sf_dir}/part*.parquet").select("p_partkey"), "k15").agg(F.count(F.lit(1)).alias("n"))


@query(
    "K16_copy_with_override",
    "select s.s_suppkey, coalesce(upper(n.n_name), s.s_name) as label from supplier s left join (select * from nation where n_regionkey = 0) n on n.n_nationkey = s.s_nationkey",
)
def k16(t: Tables):
    labels = t.nation.where("n_regionkey = 0").select("n_nationkey", F.upper("n_name").alias("new"))
    return t.supplier.join(F.broadcast(labels), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("new", "s_name").alias("label"))

