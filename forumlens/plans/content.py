"""Documents and replies for modelling (Q7 to Q10, Q18, Q19, Q48, Q54, Q55, Q59, Q60)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions import text as X
from forumlens.operators import relational as R
from forumlens.operators import vectors as V

from .registry import Tables, query
from .texts import LINKS
from .vector_queries import _B, _COM, with_community


def image_texts(images: DataFrame, most: int = 300) -> DataFrame:
    """`post_id`, `image_text`: the texts read from a post's images in order, joined and cleaned.

    Input has post_id, at, image_id, text. Only the first `most` characters are ever shown, so as many texts are kept.
    """
    rows = images.where("post_id is not null and text is not null and trim(text) <> ''")
    first = R.top_n(rows, ["post_id"], [F.asc_nulls_first("at"), F.asc("image_id")], most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.trim("text").alias("s")))), lambda r: r["s"])
    return first.groupBy("post_id").agg(F.array_join(ordered, "\n").alias("a")).select("post_id", X.cleaned(F.col("a"), X.OCR).alias("image_text"))


def selected_documents(documents: DataFrame, detections: DataFrame, keep: int = 8400) -> DataFrame:
    """The rows of the latest load, the `keep` most voted per community, with `rank_in_community` and `language`.

    Documents without a detection keep the language 'UNPROCESSED'.
    """
    latest = R.dedupe_latest(documents.where("post_id is not null and subreddit_id is not null"), ["post_id"], [F.desc_nulls_last("dt"), F.asc("doc_id")])
    top = R.top_n(latest, ["subreddit_id"], [F.desc_nulls_last("upvotes"), F.asc("doc_id")], keep, "rank_in_community")
    language = R.dedupe_latest(detections.where("post_id is not null"), ["post_id"], [F.desc_nulls_last("dt"), F.asc_nulls_last("weighted_language_code")]).select(
        "post_id", F.coalesce("weighted_language_code", F.lit("UNPROCESSED")).alias("language")
    )
    return top.join(language, "post_id", "left").na.fill("UNPROCESSED", ["language"])


def clean_body() -> Column:
    return X.clean_document(F.coalesce("text", F.lit(".")))


def documents_for_modelling(documents: DataFrame, detections: DataFrame, images: DataFrame, keep: int = 8400, popular: int = 100, link_rules=((("pics.example",), "name"),)) -> DataFrame:
    """One row per selected document, with its language and the text that an encoder sees.

    The text is the flair, a note for documents with more than `popular` votes, the words of the first link, the
    cleaned body (long ones by head and tail) and what was read from images. Ranking comes before cleaning, so regular
    expressions run over the survivors only.
    """
    joined = selected_documents(documents, detections, keep).join(image_texts(images), "post_id", "left")
    url = F.nullif(F.regexp_extract("text", r"https?://[^ \n]+", 0), F.lit(""))
    link = X.url_text(X.url_domain(url), X.url_path_words(url), link_rules)
    text = X.assemble(X.clean_flair(F.col("source")), F.col("upvotes") > popular, "Popular.", link, clean_body(), F.col("image_text"))
    return joined.select("doc_id", "post_id", "subreddit_id", "rank_in_community", "language", text.alias("text"))


def communities_for_modelling(vectors: DataFrame, topics: DataFrame, documents: DataFrame, least: int = 3, links: int = 10) -> DataFrame:
    """`subreddit_id`, `is_seed`, `name`, `vectors`, `text`: communities that are seeds or have `least` documents, with the text that describes them.

    The text is the name, the topic unless it says the same, the `links` names its documents link to most, and its most
    voted document as the description, cleaned.
    """
    kept = vectors.where("subreddit_id is not null").where((F.col("posts_for_embeddings_count") >= least) | F.col("is_seed"))
    one = kept.groupBy("subreddit_id").agg(F.max("is_seed").alias("is_seed"), F.min("subreddit_name").alias("name"), F.count(F.lit(1)).alias("vectors"))
    topic = topics.where("subreddit_id is not null").groupBy("subreddit_id").agg(F.min(F.lower(F.trim("primary_topic"))).alias("topic"))
    said = documents.where("subreddit_id is not null and text is not null")
    named = said.select("subreddit_id", F.explode(X.linked_names(F.col("text"))).alias("linked")).groupBy("subreddit_id", "linked").agg(F.count(F.lit(1)).alias("n"))
    best = R.top_n(named, ["subreddit_id"], [F.desc("n"), F.asc("linked")], links)
    linked = best.groupBy("subreddit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "linked"))), lambda r: r["linked"]), ", ").alias("linked"))
    about = R.top_n(said, ["subreddit_id"], [F.desc_nulls_last("upvotes"), F.asc("doc_id")], 1).select("subreddit_id", F.col("text").alias("about"))
    rows = one.join(topic, "subreddit_id", "left").join(linked, "subreddit_id", "left").join(about, "subreddit_id", "left")
    title = F.when(F.lower("name") == F.coalesce("topic", F.lit("")), "").otherwise(F.coalesce(F.concat("topic", F.lit("\n")), F.lit("\n")))
    text = F.concat(F.coalesce("name", F.lit("")), F.lit(". "), title, F.coalesce(F.concat("linked", F.lit("\n")), F.lit("")), X.clean_description(F.col("about")))
    return rows.select("subreddit_id", "is_seed", "name", "vectors", text.alias("text"))


def replies_for_modelling(replies: DataFrame, blocked_users: DataFrame, least_length: int = 11, keep: int = 8) -> DataFrame:
    """Distinct replies by users that are not blocked, cleaned, long enough, the `keep` longest per document."""
    once = R.dedupe_latest(replies.where("comment_id is not null and comment_body_text is not null"), ["comment_id"], [F.asc("dt"), F.asc("comment_body_text")])
    allowed = once.where("coalesce(removed, 0) = 0").join(blocked_users.select("user_id").distinct(), "user_id", "left_anti")
    cleaned = allowed.withColumn("clean", X.clean_reply(F.col("comment_body_text"))).withColumn("length", F.char_length("clean")).where(F.col("length") >= least_length)
    return R.top_n(cleaned, ["post_id"], [F.desc("length"), F.asc("comment_id")], keep).select("post_id", "comment_id", "rank", "length", "clean")


def combined_text(documents: DataFrame, replies: DataFrame, head: int = 200, least: int = 3) -> DataFrame:
    """Document text followed by the heads of its ranked replies. `documents` has post_id, clean; `replies` post_id, rank, clean."""
    heads = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.left("clean", F.lit(head)).alias("s")))), lambda r: r["s"])
    said = replies.groupBy("post_id").agg(F.count(F.lit(1)).alias("replies"), F.array_join(heads, "\n").alias("said"))
    both = documents.join(said, "post_id", "left").withColumn("all", F.when(F.char_length("said") >= 1, F.concat("clean", F.lit("\n\n"), "said")).otherwise(F.col("clean")))
    return both.where(F.char_length("all") >= least).select("post_id", F.coalesce("replies", F.lit(0)).alias("replies"), F.col("all").alias("text"))


def community_rollup(documents: DataFrame, community: DataFrame, key: str, vector: str, least: int = 3) -> DataFrame:
    """`key`, `documents`, `vector`: the mean of a community's documents if it has `least`, else with its own vector as
    one more, else that vector alone. `community` has `key` and `community`."""
    means = V.mean_vector(documents, [key], vector, name="mean")
    counts = documents.where(F.col(vector).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("documents"))
    rows = community.join(means.join(counts, key), key, "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    extra = F.zip_with("mean", "community", lambda m, c: (m * F.col("documents") + c) / (F.col("documents") + 1))
    return rows.select(key, "documents", F.when(F.col("documents") >= least, F.col("mean")).when(F.col("documents") >= 1, extra).otherwise(F.col("community")).alias("vector"))


def nested_neighbours(pairs: DataFrame) -> DataFrame:
    """One row per vector with its neighbours as structs in order of rank."""
    return pairs.groupBy("id_a").agg(F.array_sort(F.collect_list(F.struct("distance_rank", F.col("id_b").alias("id"), "cosine_similarity"))).alias("similar"))


@query(
    "Q7_communities_for_modelling",
    "with one as (select subreddit_id, max(is_seed::int)::boolean as is_seed, min(subreddit_name) as name, count(*) as vectors from embeddings_community where subreddit_id is not null and (posts_for_embeddings_count >= 3 or is_seed) group by 1), topic as (select subreddit_id, min(lower(trim(primary_topic))) as topic from cluster_labels where subreddit_id is not null group by 1),"
    " named as (select subreddit_id, linked, count(*) as n from (select subreddit_id, lower(unnest(regexp_extract_all(text, '(?i)\\br/(\\w{2,21})', 1))) as linked from documents where subreddit_id is not null and text is not null) group by 1, 2), top as (select *, row_number() over (partition by subreddit_id order by n desc, linked) as rank from named), links as (select subreddit_id, string_agg(linked, ', ' order by rank) as linked from top where rank <= 10 group by 1),"
    " about as (select subreddit_id, text as about from documents where subreddit_id is not null and text is not null qualify row_number() over (partition by subreddit_id order by upvotes desc nulls last, doc_id) = 1)"
    f" select one.subreddit_id, is_seed, name, vectors, coalesce(name, '') || '. ' || case when lower(name) = coalesce(topic, '') then '' else coalesce(topic || chr(10), chr(10)) end || coalesce(linked || chr(10), '') || {X.as_sql(chr(99) + 'oalesce(about, ' + repr('') + ')', X.DESCRIPTION)} as text"
    " from one left join topic on topic.subreddit_id = one.subreddit_id left join links on links.subreddit_id = one.subreddit_id left join about on about.subreddit_id = one.subreddit_id",
)
def q7(t: Tables):
    return communities_for_modelling(t.embeddings_community, t.cluster_labels, t.documents)


_CLEAN = X.as_sql("coalesce(text, '.')", X.DOCUMENT)
_DOCS = (
    "with latest as (select * from documents where post_id is not null and subreddit_id is not null qualify row_number() over (partition by post_id order by dt desc nulls last, doc_id) = 1),"
    " top as (select *, row_number() over (partition by subreddit_id order by upvotes desc nulls last, doc_id)::int as rank_in_community from latest qualify rank_in_community <= 8400),"
    " lang as (select post_id, weighted_language_code as language from post_language_detection_cld3_clean where post_id is not null qualify row_number() over (partition by post_id order by dt desc nulls last, weighted_language_code nulls last) = 1),"
    " image as (select post_id, trim(text) as s, row_number() over (partition by post_id order by created_timestamp nulls first, detection_id) as rank from comment_language_v2 where thing_type = 'post' and post_id is not null and text is not null and trim(text) <> ''),"
    f" ocr as (select post_id, {X.as_sql('a', X.OCR)} as image_text from (select post_id, string_agg(s, chr(10) order by rank) as a from image where rank <= 300 group by 1)),"
    f" cleaned as (select *, {_CLEAN} as body, {X.as_sql('source', X.FLAIR)} as flair from top)"
)
_HEAD_TAIL = "case when length(body) >= 1010 then left(body, 720) || '.' || chr(10) || chr(10) || right(body, 290) else body end"


@query(
    "Q8_documents_for_modelling",
    _DOCS + f" select c.doc_id, c.post_id, subreddit_id, rank_in_community, coalesce(language, 'UNPROCESSED') as language, trim(coalesce(flair, '') || case when coalesce(upvotes > 100, false) then chr(10) || 'Popular.' else '' end || coalesce(chr(10) || words, '') || chr(10) || {_HEAD_TAIL} || chr(10) || coalesce(left(image_text, 300), '')) as text"
    f" from cleaned c left join lang on lang.post_id = c.post_id left join ocr on ocr.post_id = c.post_id left join {LINKS} k on k.doc_id = c.doc_id",
)
def q8(t: Tables):
    images = t.comment_language_v2.where("thing_type = 'post'").select("post_id", F.col("created_timestamp").alias("at"), F.col("detection_id").alias("image_id"), "text")
    return documents_for_modelling(t.documents, t.post_language_detection_cld3_clean, images)


@query("Q8b_documents_for_production", _DOCS + " select c.doc_id, c.post_id, subreddit_id, rank_in_community, coalesce(language, 'UNPROCESSED') as language, body as clean from cleaned c left join lang on lang.post_id = c.post_id")
def q8b(t: Tables):
    """The selection with the cleaned body alone."""
    rows = selected_documents(t.documents, t.post_language_detection_cld3_clean)
    return rows.select("doc_id", "post_id", "subreddit_id", "rank_in_community", "language", clean_body().alias("clean"))


_REPLIES = (
    "with once as (select * from comment_language_detection_cld3_clean where comment_id is not null and comment_body_text is not null qualify row_number() over (partition by comment_id order by dt, comment_body_text) = 1),"
    f" cleaned as (select *, {X.as_sql('comment_body_text', X.REPLY)} as clean from once where coalesce(removed, 0) = 0 and (user_id is null or user_id not in (select user_id from documents where upvotes > 500 and user_id is not null)))"
    ", r as (select post_id, comment_id, row_number() over (partition by post_id order by length(clean) desc, comment_id)::int as rank, length(clean)::int as length, clean from cleaned where length(clean) >= 11)"
)


def replies(t: Tables):
    return replies_for_modelling(t.comment_language_detection_cld3_clean, t.documents.where("upvotes > 500 and user_id is not null"))


@query("Q9_replies_for_modelling", _REPLIES + " select * from r where rank <= 8")
def q9(t: Tables):
    return replies(t)


@query(
    "Q10_combined_text",
    _REPLIES + ", s as (select post_id, count(*) as replies, string_agg(left(clean, 200), chr(10) order by rank) as said from r where rank <= 8 group by 1), d as (select post_id, text as clean from documents where post_id is not null qualify row_number() over (partition by post_id order by doc_id) = 1),"
    " b as (select d.post_id, coalesce(replies, 0)::bigint as replies, case when length(said) >= 1 then clean || chr(10) || chr(10) || said else clean end as text from d left join s on s.post_id = d.post_id) select * from b where length(text) >= 3",
)
def q10(t: Tables):
    docs = R.dedupe_latest(t.documents.where("post_id is not null"), ["post_id"], [F.asc("doc_id")]).select("post_id", F.col("text").alias("clean"))
    return combined_text(docs, replies(t))


_KEY = "case when doc < 60 then 1000 + doc when doc < 200 then 2000 + doc // 20 else label end"


@query(
    "Q18_embedding_rollup",
    f"with m as (select doc, {_KEY.replace('else label', 'else b.label')} as g, b.pos, (0.85::double * b.x + 0.15::double * c.x) as x from {_B} b join {_COM} c on c.label = b.label and c.pos = b.pos), own as (select distinct g, label from (select {_KEY} as g, min(label) over (partition by {_KEY}) as label from {_B} b)),"
    " d as (select g, pos, sum(x) as s, count(*) as k from m group by 1, 2) select d.g::bigint as g, d.pos, d.k as documents, round(case when d.k >= 3 then d.s / d.k else (d.s + c.x) / (d.k + 1) end, 5) + 0 as v"
    f" from d join own on own.g = d.g join {_COM} c on c.label = own.label and c.pos = d.pos",
)
def q18(t: Tables):
    """Document with its replies, then with its community, then documents to communities; small ones lean on their own vector."""
    mixed = with_community(t, (0.85, 0.15)).withColumn("g", F.expr(_KEY.replace("//", "div")).cast("bigint"))
    own = mixed.groupBy("g").agg(F.min("label").alias("label")).join(V.mean_vector(t.embeddings, ["label"], "embedding", name="community"), "label").select("g", "community")
    rolled = community_rollup(mixed.select("g", "vector"), own, "g", "vector")
    return rolled.select("g", "documents", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query(
    "Q19_nearest_neighbours",
    "with x as (select vec_id, embedding::double[] as e from embeddings), p as (select a.vec_id as id_a, b.vec_id as id_b, list_cosine_similarity(a.e, b.e) as c from x a, x b where a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by id_a order by c desc, id_b) as k from p qualify k <= 4) select id_a, string_agg(id_b::varchar, ',' order by k) as similar from r group by 1",
)
def q19(t: Tables):
    nested = nested_neighbours(V.cosine_topk(t.embeddings, "vec_id", "embedding", 4))
    return nested.select("id_a", F.array_join(F.transform("similar", lambda s: s["id"].cast("string")), ",").alias("similar"))


_CODES = "case when split(lower(trim(weighted_language_code)), '-')[1] in ('en', 'de', 'es', 'fr') then split(lower(trim(weighted_language_code)), '-')[1] else 'other' end"


@query(
    "Q48_language_document_counts",
    f"with d as (select post_id, {_CODES} as language from post_language_detection_cld3_clean where post_id is not null and coalesce(removed, 0) = 0 qualify row_number() over (partition by post_id order by dt, weighted_language_code nulls first) = 1) select p.subreddit_id, coalesce(d.language, 'other') as language, count(distinct p.post_id) as n from documents p left join d on d.post_id = p.post_id where p.post_id is not null group by 1, 2",
)
def q48(t: Tables):
    bare = F.get(F.split(F.lower(F.trim("weighted_language_code")), "-"), F.lit(0))
    first = R.dedupe_latest(t.post_language_detection_cld3_clean.where("post_id is not null and coalesce(removed, 0) = 0"), ["post_id"], [F.asc("dt"), F.asc_nulls_first("weighted_language_code")])
    language = first.select("post_id", F.when(bare.isin("en", "de", "es", "fr"), bare).otherwise("other").alias("language"))
    rows = t.documents.where("post_id is not null").join(language, "post_id", "left")
    return rows.groupBy("subreddit_id", F.coalesce("language", F.lit("other")).alias("language")).agg(F.count_distinct("post_id").alias("n"))


@query("Q54_dedupe_report", "select subreddit_id, count(*) as rows, count(distinct id) as things, round(count(*) / count(distinct id), 4) as rows_per_thing from comment_language_v2 where id is not null group by 1")
def q54(t: Tables):
    g = t.comment_language_v2.where("id is not null").groupBy("subreddit_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("things"))
    return g.withColumn("rows_per_thing", F.round(F.col("rows") / F.col("things"), 4))


@query("Q55_net_votes", "select l_orderkey, round(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end), 2) as net from lineitem group by 1")
def q55(t: Tables):
    net = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(net), 2).alias("net"))


@query("Q59_manual_topic", "select subreddit_id, model_sort_order, case when lower(subreddit_name) like 'a%' then 'by name' when lower(primary_topic) = 'gaming' then 'Games' else primary_topic end as topic from cluster_labels")
def q59(t: Tables):
    by_label = F.create_map(F.lit("gaming"), F.lit("Games"))
    name = F.when(F.lower("subreddit_name").startswith("a"), "by name")
    return t.cluster_labels.select("subreddit_id", "model_sort_order", F.coalesce(name, F.try_element_at(by_label, F.lower("primary_topic")), "primary_topic").alias("topic"))


@query("Q60_post_type_buckets", "select doc_id, case when post_type in ('image', 'video') then 'media' when post_type is null then 'other' else post_type end as type3, case when post_type = 'text' then 'text' else 'other' end as type2 from documents")
def q60(t: Tables):
    c = F.col("post_type")
    return t.documents.select("doc_id", F.when(c.isin("image", "video"), "media").otherwise(F.coalesce(c, F.lit("other"))).alias("type3"), F.when(c == "text", "text").otherwise("other").alias("type2"))

