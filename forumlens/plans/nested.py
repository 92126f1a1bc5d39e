"""Array, struct, map and JSON operators (Y), and user functions as expressions (U)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from forumlens.functions import text as X
from forumlens.operators import relational as R
from forumlens.operators import vectors as V

from .registry import Tables, query


@query("Y1_array_functions", "select n_regionkey, array_to_string(list_reverse(list_sort(list(n_name))), ',') as names, len(list_concat(list(n_name), list(n_name)))::int as twice from nation group by 1")
def y1(t: Tables):
    names = F.array_sort(F.collect_list("n_name"))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.reverse(names), ",").alias("names"), F.size(F.concat(names, names)).alias("twice"))


@query("Y2_unnest_with_position", "select vec_id, generate_subscripts(embedding, 1)::int - 1 as pos, round(unnest(embedding)::double, 5) as v from embeddings")
def y2(t: Tables):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5))


@query("Y3_struct_access", "select subreddit_id, similar_subreddit[1].subreddit_id as best, round(similar_subreddit[1].cosine_similarity, 5) as c from similar_communities")
def y3(t: Tables):
    first = F.get("similar_subreddit", F.lit(0))
    return t.similar_communities.select("subreddit_id", first["subreddit_id"].alias("best"), F.round(first["cosine_similarity"], 5).alias("c"))


@query("Y4_json_path", "select event_id, json_extract_string(props, '$.k') as k from events")
def y4(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("Y5_json_map_rows", "select event_id, 'k' as key, (json_extract_string(props, '$.k'))::double as v from events where (json_extract_string(props, '$.k'))::double >= 10")
def y5(t: Tables):
    pairs = t.events.select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "v"))
    return pairs.where("v >= 10")


@query("Y6_vector_to_columns", "select vec_id, round(embedding[1]::double, 5) as e0, round(embedding[2]::double, 5) as e1, round(embedding[64]::double, 5) as e63 from embeddings")
def y6(t: Tables):
    return t.embeddings.select("vec_id", *(F.round(F.col("embedding")[k].cast("double"), 5).alias(f"e{k}") for k in (0, 1, 63)))


@query("Y7_wide_to_long", "select s_suppkey, 'nation' as name, s_nationkey::double as value from supplier union all select s_suppkey, 'balance', s_acctbal from supplier")
def y7(t: Tables):
    wide = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return R.stack(wide, ["s_suppkey"], ["nation", "balance"])


@query("Y8_long_to_wide", "select user_id, " + ", ".join(f"count(case when event_type = '{e}' then 1 end) as {e}" for e in ("view", "click", "error")) + " from events group by 1")
def y8(t: Tables):
    return R.unstack(t.events, ["user_id"], "event_type", F.count(F.lit(1)), ["view", "click", "error"])


@query(
    "Y9_long_similarity_pairs",
    "with x as (select vec_id, embedding::double[] as e from embeddings) select a.vec_id as id_a, b.vec_id as id_b, round(list_cosine_similarity(a.e, b.e), 4) as c from x a, x b where a.vec_id <> b.vec_id qualify row_number() over (partition by a.vec_id order by list_cosine_similarity(a.e, b.e) desc, b.vec_id) <= 3",
)
def y9(t: Tables):
    best = V.cosine_topk(t.embeddings, "vec_id", "embedding", 3)
    return best.select("id_a", "id_b", F.round("cosine_similarity", 4).alias("c"))


@query("Y10_list_to_string", "select event_type, string_agg(user_id::varchar, ' | ' order by user_id) as users from (select distinct event_type, user_id from events) group by 1")
def y10(t: Tables):
    ids = t.events.groupBy("event_type").agg(F.array_sort(F.collect_set("user_id")).alias("ids"))
    return ids.select("event_type", F.array_join(F.transform("ids", lambda x: x.cast("string")), " | ").alias("users"))


@query("Y11_list_to_columns", "select n_regionkey, list_sort(list(n_name))[1] as a, list_sort(list(n_name))[2] as b from nation group by 1")
def y11(t: Tables):
    names = F.array_sort(F.collect_list("n_name"))
    return t.nation.groupBy("n_regionkey").agg(F.get(names, F.lit(0)).alias("a"), F.get(names, F.lit(1)).alias("b"))


@query("U1_expression_function", "select n_nationkey, lower(trim(n_name)) || '!' as v from nation")
def u1(t: Tables):
    shout = lambda c: F.concat(F.lower(F.trim(c)), F.lit("!"))  # noqa: E731 - a function is a function of columns
    return t.nation.select("n_nationkey", shout("n_name").alias("v"))


@query("U2_struct_function", "select event_id, (json_extract_string(props, '$.k'))::bigint as k, (json_extract_string(props, '$.k'))::bigint % 2 = 0 as even from events")
def u2(t: Tables):
    parsed = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", F.struct(parsed.alias("k"), (parsed % 2 == 0).alias("even")).alias("s")).select("event_id", "s.*")


@query("U3_group_mean", "select label, round(avg(embedding[1]::double), 5) as first from embeddings group by 1")
def u3(t: Tables):
    return V.mean_vector(t.embeddings, ["label"], "embedding").select("label", F.round(F.col("vector")[0], 5).alias("first"))


@query("U4_batched_encoder")
def u4(t: Tables):
    return V.batches_of(t.documents, V.hashed_encoder(32), "text", "doc_id", 32)


@query("U4b_encoded_characters", "select doc_id, length(text)::int as chars, text is not null as has_vector from documents")
def u4b(t: Tables):
    encoded = V.batches_of(t.documents, V.hashed_encoder(32), "text", "doc_id", 32)
    return encoded.select("doc_id", "chars", (F.size("vector") == 32).alias("has_vector")).fillna({"has_vector": False})


@query("U5_batch_scoring", "select p_partkey, round(1 / (1 + exp(-(0.05::double * p_size - 0.001::double * p_retailprice))), 6) as p from part")
def u5(t: Tables):
    weights = t.spark.sparkContext.broadcast((0.05, -0.001))

    @F.pandas_udf("double")
    def score(size: pd.Series, price: pd.Series) -> pd.Series:
        import numpy as np

        a, b = weights.value
        return 1 / (1 + np.exp(-(a * size + b * price)))

    return t.part.select("p_partkey", F.round(score("p_size", "p_retailprice"), 6).alias("p"))


@query("U6_registry_function", "select doc_id, " + ", ".join(f"array_to_string({X.tokens_sql('text', n)}, ' ') as {n}" for n in X.SQL_TOKENIZERS) + " from documents")
def u6(t: Tables):
    return t.documents.select("doc_id", *(F.array_join(X.tokens(F.col("text"), n), " ").alias(n) for n in X.SQL_TOKENIZERS))


@query("U7_parallel_map", "select s_nationkey, max(s_acctbal) as best from supplier group by 1")
def u7(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))


@query("U7b_parallel_python_map", "select doc_id, length(text)::int as chars from documents where text is not null")
def u7b(t: Tables):
    """A function that only Python has (Unicode normal forms), over Arrow batches; what comes out is checked by its length."""
    import unicodedata
    from collections.abc import Iterator

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            back = [unicodedata.normalize("NFC", unicodedata.normalize("NFD", x)) == unicodedata.normalize("NFC", x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "chars": [len(x) if same else -1 for x, same in zip(b["text"], back)]})

    return t.documents.where("text is not null").select("doc_id", "text").mapInPandas(forms, "doc_id long, chars int")


@query("U8_configured_pipeline", "select vec_id, round(sqrt(list_sum([x::double * x::double for x in embedding])), 4) as before, 1.0::double as after from embeddings")
def u8(t: Tables):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from forumlens.operators.models import pipeline

    rows = t.embeddings.select("vec_id", "embedding", array_to_vector("embedding").alias("features"))
    done = pipeline([("normalise", {})]).fit(rows).transform(rows)
    out = vector_to_array("features_normalise")
    return done.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("before"), F.round(V.norm(out), 4).alias("after"))
