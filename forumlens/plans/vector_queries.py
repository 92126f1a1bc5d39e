"""Vector, similarity, clustering and model operators (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import clustering as C
from forumlens.operators import metrics
from forumlens.operators import relational as R
from forumlens.operators import vectors as V

from .registry import Tables, query

_CELLS = "(select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1)::int - 1 as pos from embeddings)"


def positions(df, *keys, vector="vector", digits=5):
    return df.select(*keys, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.round("v", digits) + F.lit(0.0))  # no negative zero


@query("V1_weighted_mean", f"select label, pos, round(sum(ln(3 + vec_id) * x) / sum(ln(3 + vec_id)), 5) + 0 as v from {_CELLS} group by 1, 2")
def v1(t: Tables):
    return positions(V.mean_vector(t.embeddings, ["label"], "embedding", F.log(3 + F.col("vec_id"))), "label")


@query("V1b_length_weighted_mean", f"select label, pos, round(sum(ln(2 + vec_id % 50) * x) / sum(ln(2 + vec_id % 50)), 5) + 0 as v from {_CELLS} group by 1, 2")
def v1b(t: Tables):
    return positions(V.mean_vector(t.embeddings, ["label"], "embedding", F.log(2 + F.col("vec_id") % 50)), "label")


@query("V2_mean", f"select label, pos, round(avg(x), 5) + 0 as v from {_CELLS} group by 1, 2")
def v2(t: Tables):
    return positions(V.mean_vector(t.embeddings, ["label"], "embedding"), "label")


# Every tenth vector stands for a document, the nine that follow for the replies to it.
def documents_and_replies(t: Tables):
    doc = t.embeddings.where("vec_id % 10 = 0").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("d"), "label")
    replies = t.embeddings.where("vec_id % 10 <> 0").withColumn("doc", F.expr("vec_id - vec_id % 10"))
    return doc.join(V.mean_vector(replies, ["doc"], "embedding", name="r"), "doc", "left")


_DOC = "(select vec_id as doc, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1)::int - 1 as pos from embeddings where vec_id % 10 = 0)"
_REP = "(select vec_id - vec_id % 10 as doc, pos, avg(x) as x from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1)::int - 1 as pos from embeddings where vec_id % 10 <> 0) group by 1, 2)"
_COM = f"(select label, pos, avg(x) as x from {_CELLS} group by 1, 2)"
_B = f"(select d.doc, d.label, d.pos, case when r.x is null then d.x else (70 * d.x + 20 * r.x) / 90 end as x from {_DOC} d left join {_REP} r on r.doc = d.doc and r.pos = d.pos)"


@query("V3_mix_with_replies", f"select doc, pos, round(x, 5) + 0 as v from {_B}")
def v3(t: Tables):
    mixed = documents_and_replies(t).withColumn("vector", V.mix([(F.col("d"), 70), (F.col("r"), 20)]))
    return positions(mixed, "doc")


def with_community(t: Tables, weights):
    b = documents_and_replies(t).withColumn("b", V.mix([(F.col("d"), 70), (F.col("r"), 20)]))
    community = V.mean_vector(t.embeddings, ["label"], "embedding", name="c")
    return b.join(community, "label", "left").withColumn("vector", V.mix([(F.col("b"), weights[0]), (F.col("c"), weights[1])]))


@query("V4_mix_with_community", f"select doc, b.pos, round((90 * b.x + 10 * c.x) / 100, 5) + 0 as v from {_B} b join {_COM} c on c.label = b.label and c.pos = b.pos")
def v4(t: Tables):
    return positions(with_community(t, (90, 10)), "doc")


@query("V4b_latest_mix", f"select doc, b.pos, round((0.85::double * b.x + 0.15::double * c.x) / 1.0, 5) + 0 as v from {_B} b join {_COM} c on c.label = b.label and c.pos = b.pos")
def v4b(t: Tables):
    return positions(with_community(t, (0.85, 0.15)), "doc")


_GROUP = "case when vec_id < 20 then vec_id when vec_id < 60 then 100 + vec_id // 2 else 200 + label end"


@query(
    "V4c_community_rollup",
    f"with e as (select {_GROUP} as g, unnest(embedding)::double as x, generate_subscripts(embedding, 1)::int - 1 as pos from embeddings), c as (select pos, avg(x) as x from e group by 1), d as (select g, pos, sum(x) as s, count(*) as k from e group by 1, 2)"
    " select d.g::bigint as g, d.pos, d.k as documents, round(case when d.k >= 3 then d.s / d.k else (d.s + c.x) / (d.k + 1) end, 5) + 0 as v from d join c on c.pos = d.pos union all select -1::bigint, pos, 0::bigint, round(x, 5) + 0 from c",
)
def v4c(t: Tables):
    from .content import community_rollup

    grouped = t.embeddings.withColumn("g", F.expr(_GROUP.replace("vec_id // 2", "vec_id div 2")).cast("bigint"))
    overall = V.mean_vector(t.embeddings.withColumn("every", F.lit(1)), ["every"], "embedding", name="community")  # one row
    keys = grouped.select("g").distinct().unionByName(t.spark.createDataFrame([(-1,)], "g bigint"))
    rolled = community_rollup(grouped.select("g", "embedding"), keys.join(F.broadcast(overall), F.lit(True)).drop("every"), "g", "embedding", 3)
    return rolled.select("g", "documents", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("V4d_plain_rollups", f"select label, 'documents' as kind, pos, round(avg(x), 5) + 0 as v from {_CELLS} where vec_id % 10 = 0 group by 1, 3 union all select label, 'with replies', pos, round(avg(x), 5) + 0 from {_CELLS} where true group by 1, 3")
def v4d(t: Tables):
    a = V.mean_vector(t.embeddings.where("vec_id % 10 = 0"), ["label"], "embedding").withColumn("kind", F.lit("documents"))
    b = V.mean_vector(t.embeddings.where("true"), ["label"], "embedding").withColumn("kind", F.lit("with replies"))
    return positions(a.unionByName(b), "label", "kind")


def _topk_sql(k: int, where: str = "true") -> str:
    return (
        f"with x as (select vec_id, label, embedding::double[] as e from embeddings), p as (select a.vec_id as id_a, b.vec_id as id_b, a.label as label_a, b.label as label_b, list_cosine_similarity(a.e, b.e) as c from x a, x b where a.vec_id <> b.vec_id and {where})"
        f" select *, row_number() over (partition by id_a order by c desc, id_b)::int as distance_rank from p qualify distance_rank <= {k}"
    )


@query("V5_exact_top_20", f"select id_a, id_b, label_a, label_b, round(c, 4) as cosine_similarity, distance_rank from ({_topk_sql(20)})")
def v5(t: Tables):
    best = V.cosine_topk(t.embeddings, "vec_id", "embedding", 20)
    meta = t.embeddings.select("vec_id", "label")
    out = best.join(meta.select(F.col("vec_id").alias("id_a"), F.col("label").alias("label_a")), "id_a").join(meta.select(F.col("vec_id").alias("id_b"), F.col("label").alias("label_b")), "id_b")
    return out.withColumn("cosine_similarity", F.round("cosine_similarity", 4))


@query("V6_neighbour_index", f"select id_a, count(*) as neighbours from ({_topk_sql(10)}) group by 1")
def v6(t: Tables):
    return V.cosine_topk(t.embeddings, "vec_id", "embedding", 10, block=64).groupBy("id_a").agg(F.count(F.lit(1)).alias("neighbours"))


@query("V7_top_k_for_all", f"select id_a, id_b, distance_rank, round(1 - (2 - 2 * c) / 2, 4) as cosine from ({_topk_sql(5)})")
def v7(t: Tables):
    best = V.cosine_topk(t.embeddings, "vec_id", "embedding", 5)
    d = F.sqrt(2 - 2 * F.col("cosine_similarity"))
    return best.select("id_a", "id_b", "distance_rank", F.round(V.angular_to_cosine(d), 4).alias("cosine"))


@query("V7b_top_k_for_one", f"select id_a, id_b, distance_rank from ({_topk_sql(5, 'a.vec_id = 11')})")
def v7b(t: Tables):
    return V.cosine_topk(t.embeddings, "vec_id", "embedding", 5, F.col("vec_id") == 11).select("id_a", "id_b", "distance_rank")


@query("V8_filtered_candidates", "select subreddit_id, pt::varchar as pt from embeddings_community where posts_for_embeddings_count >= 3 or is_seed")
def v8(t: Tables):
    return t.embeddings_community.where("posts_for_embeddings_count >= 3 or is_seed").select("subreddit_id", F.col("pt").cast("string").alias("pt"))


@query("V9_l2_normalise", "select vec_id, pos, round(x / sqrt(sum(x * x) over (partition by vec_id)), 5) + 0 as v from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1)::int - 1 as pos from embeddings)")
def v9(t: Tables):
    return positions(t.embeddings.withColumn("vector", V.l2_normalise(F.col("embedding"))), "vec_id")


@query("V10_reduce")
def v10(t: Tables):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from forumlens.operators.models import pipeline

    rows = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    done = pipeline([("reduce", {"k": 8})]).fit(rows).transform(rows)
    return positions(done.select("vec_id", vector_to_array("features_reduce").alias("vector")), "vec_id")


@query("V10b_reduction_is_orthonormal", "select vec_id, 8 as dims, round(sqrt(list_sum([x::double * x::double for x in embedding])), 4) as length, true as kept_is_less from embeddings")
def v10b(t: Tables):
    """With as many components as dimensions the projection only turns, so lengths stay; with fewer it can only shorten."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from forumlens.operators.models import pipeline

    rows = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    every = pipeline([("reduce", {"k": t.embeddings.select(F.size("embedding")).first()[0]})]).fit(rows).transform(rows).select("vec_id", vector_to_array("features_reduce").alias("whole"))
    done = pipeline([("reduce", {"k": 8})]).fit(rows).transform(rows).select("vec_id", vector_to_array("features_reduce").alias("part"))
    both = every.join(done, "vec_id")
    return both.select("vec_id", F.size("part").alias("dims"), F.round(V.norm(F.col("whole")), 4).alias("length"), (V.norm(F.col("part")) <= V.norm(F.col("whole")) + 1e-9).alias("kept_is_less"))


def ward(t: Tables, counts=(2, 5, 10, 23)):
    return C.labels_long(t.embeddings, "vec_id", "embedding", counts)


@query("V11_ward_clusters")
def v11(t: Tables):
    return ward(t)


@query("V12_kmeans")
def v12(t: Tables):
    from pyspark.ml.functions import array_to_vector

    from forumlens.operators.models import pipeline

    rows = t.embeddings.select("vec_id", "label", array_to_vector("embedding").alias("features"))
    return pipeline([("kmeans", {"k": 10})]).fit(rows).transform(rows).select("vec_id", "label_found")


@query("V12b_kmeans_is_nearest", "select vec_id, true as in_its_nearest from embeddings")
def v12b(t: Tables):
    """Every row lies in the cluster whose centre is nearest to it."""
    from pyspark.ml.functions import array_to_vector

    from forumlens.operators.models import pipeline

    rows = t.embeddings.select("vec_id", "embedding", array_to_vector("embedding").alias("features"))
    model = pipeline([("kmeans", {"k": 10})]).fit(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.stages[-1].clusterCenters()))
    far = F.transform(centres, lambda c: F.aggregate(F.zip_with(c, "embedding", lambda a, b: (a - b.cast("double")) * (a - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return model.transform(rows).select("vec_id", (F.get(far, F.col("label_found")) <= F.array_min(far) + 1e-9).alias("in_its_nearest"))


@query("V13_linkage")
def v13(t: Tables):
    return C.linkage(t.embeddings, "vec_id", "embedding")


@query(
    "V13b_linkage_adds_up",
    "with x as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings), m as (select pos, avg(x) as m from x group by 1) select (select count(*) - 1 from embeddings) as merges, (select count(*) from embeddings) as leaves, (select count(*)::int from embeddings) as largest, round((select sum((x - m) ** 2) from x join m using (pos)), 2) as total",
)
def v13b(t: Tables):
    """Each merge of Ward's tree adds half its squared distance to the sum of squares, which ends at that of all rows."""
    tree = C.linkage(t.embeddings, "vec_id", "embedding")
    return tree.agg(F.count("merge").alias("merges"), F.count_distinct("leaf").alias("leaves"), F.max("count").alias("largest"), F.round(F.sum(F.col("distance") * F.col("distance") / 2), 2).alias("total"))


@query("V14_flat_cuts", "select k, k::bigint as clusters, (select count(*) from embeddings) as rows from (values (2), (5), (10), (23)) v(k)")
def v14(t: Tables):
    return ward(t).groupBy("k").agg(F.count_distinct("label").alias("clusters"), F.count(F.lit(1)).alias("rows"))


@query("V11b_cuts_are_nested", "select fine, coarse, fine::bigint as pairs from (values (23, 10), (10, 5), (5, 2)) v(fine, coarse)")
def v11b(t: Tables):
    """Every cluster of a finer cut lies in one cluster of the coarser."""
    rows = ward(t)
    lanes = [rows.where(F.col("k") == a).select("vec_id", F.col("label").alias("la")).join(rows.where(F.col("k") == b).select("vec_id", F.col("label").alias("lb")), "vec_id").agg(F.count_distinct("la", "lb").alias("pairs")).select(F.lit(a).alias("fine"), F.lit(b).alias("coarse"), "pairs") for a, b in ((23, 10), (10, 5), (5, 2))]
    return lanes[0].unionByName(lanes[1]).unionByName(lanes[2])


@query("V15b_order_keeps_clusters_together", "select k, (select count(*) from embeddings) as positions, k::bigint as stretches from (values (2), (5), (10), (23)) v(k)")
def v15b(t: Tables):
    """Along the leaf order every cluster of every cut is one stretch, and every position is taken once."""
    spans = ward(t).groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"), (F.max("model_sort_order") - F.min("model_sort_order") + 1).alias("span"))
    return spans.groupBy("k").agg(F.sum("span").alias("positions"), F.count(F.when(F.col("n") == F.col("span"), 1)).alias("stretches"))


@query("V15_leaf_order")
def v15(t: Tables):
    return ward(t, (2,)).select("vec_id", "model_sort_order")


#: 23 ranges of k from a handful to thousands, each about a third wider than the one before.
INTERVALS = [(low, high) for low, high in zip([2, *(int(8 * 1.33**k) + 1 for k in range(22))], [int(8 * 1.33**k) for k in range(23)])]


@query("V16_best_counts")
def v16(t: Tables):
    tree = C.ward_tree(*C.tree_points(t.embeddings, "vec_id", "embedding", normalise=True))
    found = C.best_counts(tree, INTERVALS)
    return t.spark.createDataFrame(found, "low int, high int, k int, acceleration double")


@query(
    "V17_majority_per_cluster",
    "with c as (select 'k_0023' as k, k_0023_label::int as label, primary_topic from cluster_labels union all select 'k_0097', k_0097_label::int, primary_topic from cluster_labels), n as (select k, label, primary_topic, count(*) as n from c where primary_topic is not null and label is not null group by 1, 2, 3)"
    " select k, label, primary_topic as majority from n qualify row_number() over (partition by k, label order by n desc, primary_topic) = 1",
)
def v17(t: Tables):
    long = R.stack(t.cluster_labels.select("primary_topic", F.col("k_0023_label").alias("k_0023"), F.col("k_0097_label").alias("k_0097")), ["primary_topic"], ["k_0023", "k_0097"], "k", "label")
    return R.majority(long.withColumn("label", F.col("label").cast("int")), ["k", "label"], "primary_topic")


_AGREE = (
    "with c as (select lower(trim(primary_topic)) as a, k_0023_label::int as b, count(*) as n from cluster_labels where primary_topic is not null and k_0023_label is not null group by 1, 2), t as (select sum(n)::double as t from c),"
    " ra as (select a, sum(n)::double as n from c group by 1), rb as (select b, sum(n)::double as n from c group by 1),"
    " h as (select (select sum(-n / t * ln(n / t)) from ra, t) as ha, (select sum(-n / t * ln(n / t)) from rb, t) as hb, (select sum(-c.n / t * ln(c.n / rb.n)) from c join rb using (b), t) as hab, (select sum(-c.n / t * ln(c.n / ra.n)) from c join ra using (a), t) as hba,"
    " (select sum(n::double * (n - 1) / 2) from c) as i, (select sum(n * (n - 1) / 2) from ra) as pa, (select sum(n * (n - 1) / 2) from rb) as pb, (select t * (t - 1) / 2 from t) as al)"
)


@query(
    "V18_cluster_agreement",
    _AGREE + " select (select t::bigint from t) as n, round(1 - hab / ha, 5) as homogeneity, round(1 - hba / hb, 5) as completeness, round(2 * (1 - hab / ha) * (1 - hba / hb) / ((1 - hab / ha) + (1 - hba / hb)), 5) as v_measure, round((i - pa * pb / al) / ((pa + pb) / 2 - pa * pb / al), 5) as adjusted_rand from h",
)
def v18(t: Tables):
    rows = t.cluster_labels.select(F.lower(F.trim("primary_topic")).alias("a"), F.col("k_0023_label").cast("int").alias("b"))
    one = metrics.cluster_agreement(rows, "a", "b")
    return one.select("n", *(F.round(c, 5).alias(c) for c in ("homogeneity", "completeness", "v_measure", "adjusted_rand")))


@query("V19_projection_with_metadata", "select distinct t.subreddit_id, t.pt::varchar as pt, t.tsne1 as x, t.tsne2 as y, c.topic from df_tsne t left join (select subreddit_id, min(primary_topic) as topic from cluster_labels group by 1) c on c.subreddit_id = t.subreddit_id")
def v19(t: Tables):
    topics = t.cluster_labels.groupBy("subreddit_id").agg(F.min("primary_topic").alias("topic"))
    rows = t.df_tsne.select("subreddit_id", F.col("pt").cast("string").alias("pt"), F.col("tsne1").alias("x"), F.col("tsne2").alias("y"))
    return rows.join(topics, "subreddit_id", "left").distinct()


@query(
    "V20_user_vector",
    f"with s as (select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) as share from events group by 1, 2), m as (select label, pos, avg(x) as x from {_CELLS} group by 1, 2), k as (select * from (values ('view', 0), ('click', 1), ('purchase', 2), ('signup', 3)) v(event_type, label))"
    " select user_id, pos, round(avg(share * x), 5) + 0 as v from s join k using (event_type) join m using (label) group by 1, 2",
)
def v20(t: Tables):
    shares = R.share_of_total(t.events, ["user_id"], ["event_type"])
    kinds = t.spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2), ("signup", 3)], "event_type string, label int")
    means = V.mean_vector(t.embeddings, ["label"], "embedding", name="m")
    scaled = shares.join(F.broadcast(kinds), "event_type").join(means, "label").withColumn("s", F.transform("m", lambda x: x * F.col("share")))
    return positions(V.mean_vector(scaled, ["user_id"], "s"), "user_id")


@query("V21_alignment", "select vec_id, 1.0::double as cosine from embeddings")
def v21(t: Tables):
    from forumlens.operators.alignment import procrustes

    a = t.embeddings.select("vec_id", "embedding")
    b = a.select("vec_id", F.reverse("embedding").alias("other"))
    turned = procrustes(a, b, "vec_id", "embedding", "other")
    both = turned.join(b, "vec_id")
    return both.select("vec_id", F.round(V.cosine(F.col("aligned"), F.col("other")), 3).alias("cosine"))


@query("V22_encoder")
def v22(t: Tables):
    return V.batches_of(t.comment_language_detection_cld3_clean.select("comment_id", "comment_body_text"), V.hashed_encoder(64), "comment_body_text", "comment_id", 64)


@query("V23_classifier_grid")
def v23(t: Tables):
    from pyspark.ml.functions import array_to_vector

    from forumlens.operators.models import classifier_grid

    rows = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"), (F.col("label") < 3).cast("double").alias("label"))
    counted = [metrics.contingency(classifier_grid(kind).fit(rows).transform(rows), "label", "prediction").select(F.lit(kind).alias("kind"), "*") for kind in ("logistic", "forest", "boosted")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("V24_tuple_pairs", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def v24(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))
