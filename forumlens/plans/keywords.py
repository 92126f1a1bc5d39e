"""Keywords of communities and clusters (Q14 to Q17, Q41, Q53, Q56)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions import text as X
from forumlens.operators import relational as R

from .clusters import _LAB, labelled
from .registry import Tables, query


def ngram_counts(documents: DataFrame, least: int = 3, ascii_only: bool = False, sizes: tuple[int, int] = (1, 3)) -> DataFrame:
    """`community`, `gram`, `size`, `n` for n-grams seen at least `least` times. Input has community, text."""
    grams = documents.where("text is not null").select("community", F.explode(X.ngrams(X.normalised_words(F.col("text"), ascii_only), *sizes)).alias("gram"))
    counted = grams.groupBy("community", "gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.withColumn("size", X.ngram_size(F.col("gram")))


def tfidf_bm25(counts: DataFrame, k1: float = 24.0, b: float = 0.5) -> DataFrame:
    """Term weights per community: `tf`, `df`, `idf`, `idf_prob`, `tfidf`, `bm25`. Input has community, gram, n.

    tf is the share of the community's grams; idf = ln(N / df); idf_prob = ln(1 + (N - df + 0.5) / (df + 0.5)); bm25 is
    idf_prob * n / (n + k1 * (1 - b + b * length / average length)), without the usual factor k1 + 1.
    """
    lengths = counts.groupBy("community").agg(F.sum("n").alias("length"))
    found_in = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    totals = lengths.agg(F.avg("length").alias("average"), F.count(F.lit(1)).alias("communities"))  # one row
    rows = counts.join(lengths, "community").join(found_in, "gram").join(F.broadcast(totals), F.lit(True))
    c = F.col
    rows = rows.withColumns({"tf": c("n") / c("length"), "idf": F.log(c("communities") / c("df")), "idf_prob": F.log(1 + (c("communities") - c("df") + 0.5) / (c("df") + 0.5))})
    damped = c("n") / (c("n") + k1 * (1 - b + b * c("length") / c("average")))
    return rows.select("community", "gram", "n", "df", "tf", "idf", "idf_prob", (c("tf") * c("idf")).alias("tfidf"), (c("idf_prob") * damped).alias("bm25"))


#: A gram's average rank may be at most this to count as a keyword.
MOST_RANK = 200


def ranked_keywords(weights: DataFrame, keep: int, most: int = MOST_RANK) -> DataFrame:
    """The `keep` grams of each community with the least average of their ranks by tfidf and by bm25, with `r1`, `r2`, `fused`, `rank`.

    An average of at most `most` needs both ranks below twice that, so each ranking is limited on the map side and no
    task sorts all grams of a community.
    """
    exact = weights.withColumns({"exact1": F.round("tfidf", 9), "exact2": F.round("bm25", 9)})
    first = R.top_n(exact, ["community"], [F.desc("exact1"), F.asc("gram")], 2 * most, "r1").select("community", "gram", "tfidf", "bm25", "r1")
    second = R.top_n(exact, ["community"], [F.desc("exact2"), F.asc("gram")], 2 * most, "r2").select("community", "gram", "r2")
    fused = first.join(second, ["community", "gram"]).withColumn("fused", (F.col("r1") + F.col("r2")) / 2).where(F.col("fused") <= most)
    return R.top_n(fused, ["community"], [F.asc("fused"), F.asc("gram")], keep)


def top_keywords(weights: DataFrame, keep: int = 9, separator: str = ", ") -> DataFrame:
    """`community`, `keywords`: the grams with the best average of the two ranks."""
    top = ranked_keywords(weights, keep)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda s: s["gram"])
    return top.groupBy("community").agg(F.array_join(ordered, separator).alias("keywords"))


def texts_of(t: Tables) -> dict[str, DataFrame]:
    """`community`, `text` of the four kinds of text: documents, titles, replies and names."""
    named = lambda df, text: df.where("subreddit_id is not null").select(F.col("subreddit_id").alias("community"), F.col(text).alias("text"))
    return {
        "documents": named(t.documents, "text"), "titles": named(t.post_language_detection_cld3_clean, "post_title"), "replies": named(t.comment_language_detection_cld3_clean, "comment_body_text"),
        "names": named(t.documents.select("subreddit_id", F.regexp_replace("subreddit_name", "[_-]", " ").alias("name")), "name"),
    }


def clustered_texts(t: Tables) -> DataFrame:
    """Documents under the cluster of their community."""
    return texts_of(t)["documents"].withColumnRenamed("community", "subreddit_id").join(labelled(t).select("subreddit_id", "path1"), "subreddit_id").select(F.col("path1").alias("community"), "text")


def weights_of(texts: DataFrame, least: int, most: int) -> DataFrame:
    return tfidf_bm25(ngram_counts(texts, least, sizes=(1, most)).select("community", "gram", "n"))


_SOURCES = {
    "documents": "(select subreddit_id as community, text from documents where subreddit_id is not null)", "titles": "(select subreddit_id as community, post_title as text from post_language_detection_cld3_clean where subreddit_id is not null)",
    "replies": "(select subreddit_id as community, comment_body_text as text from comment_language_detection_cld3_clean where subreddit_id is not null)",
    "names": "(select subreddit_id as community, regexp_replace(subreddit_name, '[_-]', ' ', 'g') as text from documents where subreddit_id is not null)",
    "clusters": f"(select path1 as community, text from documents d join {_LAB} l on l.subreddit_id = d.subreddit_id)",
}


def _grams_sql(source: str, least: int, top: int) -> str:
    words = "[x for x in split(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' ') if x <> '']"
    sizes = ", ".join(f"({k})" for k in range(1, top + 1))
    return (
        f"(with w as (select community, {words} as w from {_SOURCES[source]} where text is not null), g as (select community, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, (values {sizes}) s(k))"
        f" select community, array_to_string(w[i:i + k - 1], ' ') as gram, k as size, count(*) as n from g group by 1, 2, 3 having count(*) >= {least})"
    )


def _weights_sql(community: str, least: int, top: int) -> str:
    return (
        f"(with c as {_grams_sql(community, least, top)}, t as (select avg(l) as average, count(*) as communities from (select sum(n) as l from c group by community)), r as (select *, sum(n) over (partition by community) as length, count(*) over (partition by gram) as df from c)"
        " select community, gram, n, df, n / length as tf, ln(communities / df) as idf, ln(1 + (communities - df + 0.5::double) / (df + 0.5::double)) as idf_prob, n / length * ln(communities / df) as tfidf,"
        " ln(1 + (communities - df + 0.5::double) / (df + 0.5::double)) * n / (n + 24.0::double * (0.5::double + 0.5::double * length / average)) as bm25 from r, t)"
    )


def _keywords_sql(community: str, least: int, top: int, keep: int) -> str:
    return (
        f"(with w as {_weights_sql(community, least, top)}, r as (select *, row_number() over (partition by community order by round(tfidf, 9) desc, gram) as r1, row_number() over (partition by community order by round(bm25, 9) desc, gram) as r2 from w),"
        f" f as (select *, row_number() over (partition by community order by (r1 + r2) / 2, gram) as rank from r where (r1 + r2) / 2 <= 200) select community, string_agg(gram, ', ' order by rank) as keywords from f where rank <= {keep} group by 1)"
    )


@query("Q14_ngram_counts", f"select community, gram, n, size::int as size from {_grams_sql('documents', 3, 3)}")
def q14(t: Tables):
    return ngram_counts(texts_of(t)["documents"], 3)


@query("Q15_tfidf_bm25", "select community, gram, n, df, " + ", ".join(f"round({c}, 6) as {c}" for c in ("tf", "idf", "idf_prob", "tfidf", "bm25")) + f" from {_weights_sql('documents', 3, 2)}")
def q15(t: Tables):
    return weights_of(texts_of(t)["documents"], 3, 2).withColumns({c: F.round(c, 6) for c in ("tf", "idf", "idf_prob", "tfidf", "bm25")})


@query(
    "Q15b_ranked_keywords",
    f"with w as {_weights_sql('documents', 3, 2)}, r as (select *, row_number() over (partition by community order by round(tfidf, 9) desc, gram)::int as r1, row_number() over (partition by community order by round(bm25, 9) desc, gram)::int as r2 from w) select community, gram, r1, r2, (r1 + r2) / 2 as fused from r where (r1 + r2) / 2 <= 200 qualify row_number() over (partition by community order by (r1 + r2) / 2, gram) <= 200",
)
def q15b(t: Tables):
    return ranked_keywords(weights_of(texts_of(t)["documents"], 3, 2), MOST_RANK).select("community", "gram", "r1", "r2", "fused")


@query("Q16_cluster_keywords", f"select * from {_keywords_sql('clusters', 3, 2, 9)} where community is not null")
def q16(t: Tables):
    return top_keywords(weights_of(clustered_texts(t), 3, 2))


@query(
    "Q17_bm25_keyphrases",
    "with a as (" + " union all ".join(f"select '{kind}' as kind, * from {_weights_sql(kind, 3, 2)}" for kind in ("documents", "titles", "replies", "names"))
    + ") select kind, community, gram, round(bm25, 5) as bm25 from a qualify row_number() over (partition by kind, community order by round(bm25, 9) desc, gram) <= 5",
)
def q17(t: Tables):
    lanes = [weights_of(texts, 3, 2).withColumn("kind", F.lit(kind)) for kind, texts in texts_of(t).items()]
    every = lanes[0].unionByName(lanes[1]).unionByName(lanes[2]).unionByName(lanes[3]).withColumn("exact", F.round("bm25", 9))
    return R.top_n(every, ["kind", "community"], [F.desc("exact"), F.asc("gram")], 5).select("kind", "community", "gram", F.round("bm25", 5).alias("bm25"))


@query(
    "Q41_cluster_topic_profile",
    "with s as (select cluster_label, primary_topic as topic, count(*) as n from cluster_labels where primary_topic is not null group by 1, 2), r as (select *, n / sum(n) over (partition by cluster_label) as share, row_number() over (partition by cluster_label order by n desc, topic) as k from s)"
    " select cluster_label, string_agg(round(100 * share)::int::varchar || '% ' || topic, ' | ' order by k) as profile from r where k <= 5 group by 1",
)
def q41(t: Tables):
    shares = R.share_of_total(t.cluster_labels.where("primary_topic is not null"), ["cluster_label"], ["primary_topic"])
    top = R.top_n(shares, ["cluster_label"], [F.desc("n"), F.asc("primary_topic")], 5)
    text = F.format_string("%d%% %s", F.round(100 * F.col("share")).cast("int"), F.col("primary_topic"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("s")))), lambda x: x["s"])
    return top.groupBy("cluster_label").agg(F.array_join(ordered, " | ").alias("profile"))


@query(
    "Q53_two_market_report",
    "with c as (select subreddit_id, first(cluster_label order by model_sort_order nulls first, cluster_label) as cluster from cluster_labels where subreddit_id is not null and cluster_label is not null group by 1), p as (select c.cluster, geo_country_code as market, c.subreddit_id, count(*) as posts from post_language_detection_cld3_clean d join c on c.subreddit_id = d.subreddit_id where geo_country_code in ('US', 'DE') group by 1, 2, 3),"
    " r as (select *, row_number() over (partition by cluster, market order by posts desc, subreddit_id) as k, sum(posts) over (partition by cluster, market) as total from p) select cluster, market, string_agg(subreddit_id, ', ' order by k) as top, max(total)::bigint as posts from r where k <= 3 group by 1, 2",
)
def q53(t: Tables):
    c = t.cluster_labels.where("subreddit_id is not null and cluster_label is not null").groupBy("subreddit_id").agg(F.min_by("cluster_label", F.struct("model_sort_order", "cluster_label")).alias("cluster"))
    posts = t.post_language_detection_cld3_clean.where(F.col("geo_country_code").isin("US", "DE")).join(c, "subreddit_id")
    n = posts.groupBy("cluster", F.col("geo_country_code").alias("market"), "subreddit_id").agg(F.count(F.lit(1)).alias("posts"))
    n = n.withColumn("total", F.sum("posts").over(Window.partitionBy("cluster", "market")))
    top = R.top_n(n, ["cluster", "market"], [F.desc("posts"), F.asc("subreddit_id")], 3)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "subreddit_id"))), lambda s: s["subreddit_id"])
    return top.groupBy("cluster", "market").agg(F.array_join(names, ", ").alias("top"), F.max("total").alias("posts"))


@query("Q56_labels_with_keywords", f"select d.subreddit_id, d.n, k.keywords from (select subreddit_id, count(*) as n from documents where subreddit_id is not null group by 1) d left join {_keywords_sql('documents', 3, 1, 5)} k on k.community = d.subreddit_id")
def q56(t: Tables):
    keywords = top_keywords(weights_of(texts_of(t)["documents"], 3, 1), 5)
    counts = t.documents.where("subreddit_id is not null").groupBy("subreddit_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(keywords, F.col("subreddit_id") == F.col("community"), "left").select("subreddit_id", "n", "keywords")
