"""String, regular expression and text operators (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import text as X

from .registry import Tables, query

_TEXT = "(select doc_id, text from documents where text is not null)"
_URL = "(select doc_id, post_id, nullif(regexp_extract(text, 'https?://[^ \\n]+'), '') as url from documents)"


def urls(t: Tables):
    return t.documents.select("doc_id", "post_id", F.nullif(F.regexp_extract("text", r"https?://[^ \n]+", 0), F.lit("")).alias("url"))


@query("X1_case_and_trim", "select doc_id, lower(lang) as low, upper(lang) as up, trim(lang) as bare, ltrim(lang) as l, rtrim(lang, 'n ') as r from documents")
def x1(t: Tables):
    return t.documents.select("doc_id", F.lower("lang").alias("low"), F.upper("lang").alias("up"), F.trim("lang").alias("bare"), F.ltrim("lang").alias("l"), F.rtrim("lang", F.lit("n ")).alias("r"))


@query("X2_concat", "select doc_id, lang || '/' || source as path from documents")
def x2(t: Tables):
    return t.documents.select("doc_id", F.concat("lang", F.lit("/"), "source").alias("path"))


@query("X3_left_right", "select doc_id, left(text, 12) as head, right(text, 9) as tail from documents")
def x3(t: Tables):
    return t.documents.select("doc_id", F.left("text", F.lit(12)).alias("head"), F.right("text", F.lit(9)).alias("tail"))


@query("X4_length", "select doc_id, length(text)::int as chars from documents")
def x4(t: Tables):
    return t.documents.select("doc_id", F.char_length("text").alias("chars"))


@query("X5_split_offset", "select subreddit_id, split(cluster_label, '-')[1] as first, split(cluster_label, '-')[2] as second from cluster_labels")
def x5(t: Tables):
    parts = F.split("cluster_label", "-")
    return t.cluster_labels.select("subreddit_id", F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))


@query("X6_regex_replace_groups", r"select o_orderkey, regexp_replace(o_orderpriority, '^(\d)-(\w+)', '\2, \1') as swapped from orders")
def x6(t: Tables):
    return t.orders.select("o_orderkey", F.regexp_replace("o_orderpriority", r"^(\d)-(\w+)", "$2, $1").alias("swapped"))


@query("X7_regex_contains", r"select doc_id from documents where regexp_matches(text, '(?i)\bserver\b|\bcookies?\b')")
def x7(t: Tables):
    return t.documents.where(F.col("text").rlike(r"(?i)\bserver\b|\bcookies?\b")).select("doc_id")


@query("X8_regex_extract", r"select doc_id, nullif(regexp_extract(text, '(\d{3,4})', 1), '') as number from documents")
def x8(t: Tables):
    return t.documents.select("doc_id", F.nullif(F.regexp_extract("text", r"(\d{3,4})", 1), F.lit("")).alias("number"))


@query("X9_word_count", "select doc_id, len(regexp_extract_all(text, '[a-zA-Z]{2,}'))::int as words from documents")
def x9(t: Tables):
    return t.documents.select("doc_id", X.word_count(F.col("text"), "[a-zA-Z]{2,}").alias("words"))


@query("X10_instr", "select doc_id, instr(text, 'the ')::int as at from documents")
def x10(t: Tables):
    return t.documents.select("doc_id", F.instr("text", "the ").alias("at"))


@query("X11_starts_with", "select doc_id from documents where starts_with(text, 'Error') or starts_with(text, 'Has anyone')")
def x11(t: Tables):
    return t.documents.where(F.col("text").startswith("Error") | F.col("text").startswith("Has anyone")).select("doc_id")


@query("X12_format", "select n_nationkey, n_nationkey::varchar || '% of ' || n_name as shown from nation")
def x12(t: Tables):
    return t.nation.select("n_nationkey", F.format_string("%d%% of %s", "n_nationkey", "n_name").alias("shown"))


@query("X13_clean_document", f"select doc_id, {X.as_sql('text', X.DOCUMENT)} as clean from documents")
def x13(t: Tables):
    return t.documents.select("doc_id", X.clean_document(F.col("text")).alias("clean"))


@query("X14_clean_reply", f"select comment_id, dt::varchar as dt, {X.as_sql('comment_body_text', X.REPLY)} as clean from comment_language_detection_cld3_clean")
def x14(t: Tables):
    return t.comment_language_detection_cld3_clean.select("comment_id", F.col("dt").cast("string").alias("dt"), X.clean_reply(F.col("comment_body_text")).alias("clean"))


@query("X15_clean_description", f"select doc_id, {X.as_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', X.DESCRIPTION)} as clean from documents")
def x15(t: Tables):
    return t.documents.select("doc_id", X.clean_description(F.col("text")).alias("clean"))


@query("X16_clean_flair", f"select doc_id, {X.as_sql('source', X.FLAIR)} as clean from documents")
def x16(t: Tables):
    return t.documents.select("doc_id", X.clean_flair(F.col("source")).alias("clean"))


@query("X17_clean_ocr", f"select post_id, {X.as_sql('a', X.OCR)} as clean from (select post_id, string_agg(trim(text), chr(10) order by created_timestamp nulls first, doc_id) as a from documents where text is not null and post_id is not null group by 1)")
def x17(t: Tables):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("created_timestamp").isNotNull().alias("late"), "created_timestamp", "doc_id", F.trim("text").alias("s")))), lambda r: r["s"])
    joined = t.documents.where("text is not null and post_id is not null").groupBy("post_id").agg(F.array_join(ordered, "\n").alias("a"))
    return joined.select("post_id", X.cleaned(F.col("a"), X.OCR).alias("clean"))


_DOMAIN = r"nullif(lower(regexp_extract(url, 'https?://(?:www\.)?([^/?#\s]+)', 1)), '')"
_SKIP = f"(coalesce({_DOMAIN} = 'pics.example', false) or coalesce(split(post_id, '_')[-1] <> '' and contains(url, split(post_id, '_')[-1]), false))"


@query("X18_url_domain", f"select doc_id, case when url is not null and not {_SKIP} then {_DOMAIN} end as domain from {_URL}")
def x18(t: Tables):
    return urls(t).select("doc_id", X.url_domain(F.col("url"), ["pics.example"], F.col("post_id")).alias("domain"))


_PATHTEXT = X.as_sql(r"nullif(regexp_extract(url, 'https?://[^/\s]+/([^\s]*)', 1), '')", X.PATH)


@query("X19_url_path", f"select doc_id, {_PATHTEXT} as path from {_URL}")
def x19(t: Tables):
    return urls(t).select("doc_id", X.url_path_words(F.col("url")).alias("path"))


LINK_WORDS = "case when d is null then null when d = 'pics.example' then d when length(regexp_replace(coalesce(p, ''), '\\w+', '#', 'g')) - length(replace(regexp_replace(coalesce(p, ''), '\\w+', '#', 'g'), '#', '')) >= 3 then d || ' ' || p else d end"
LINKS = f"(select doc_id, {LINK_WORDS} as words from (select doc_id, {_DOMAIN} as d, {_PATHTEXT} as p from {_URL}))"


@query("X20_url_text", f"select doc_id, words from {LINKS}")
def x20(t: Tables):
    rows = urls(t).select("doc_id", X.url_domain(F.col("url")).alias("d"), X.url_path_words(F.col("url")).alias("p"))
    return rows.select("doc_id", X.url_text(F.col("d"), F.col("p"), [(["pics.example"], "name")]).alias("words"))


_BODY = "case when length(coalesce(text, '')) >= 1010 then left(text, 720) || '.' || chr(10) || chr(10) || right(text, 290) else coalesce(text, '') end"


@query(
    "X21_embedding_text",
    f"select doc_id, trim(coalesce(source, '') || case when coalesce(upvotes > 100, false) then chr(10) || 'Popular.' else '' end || coalesce(chr(10) || lang, '') || chr(10) || {_BODY} || chr(10) || coalesce(left(subreddit_name, 300), '')) as assembled from documents",
)
def x21(t: Tables):
    c = F.col
    return t.documents.select("doc_id", X.assemble(c("source"), c("upvotes") > 100, "Popular.", c("lang"), c("text"), c("subreddit_name")).alias("assembled"))


@query(
    "X22_community_text",
    "select subreddit_id, subreddit_name || '. ' || case when lower(subreddit_name) = lower(coalesce(primary_topic, '')) then '' else coalesce(primary_topic || chr(10), chr(10)) end || case when posts_for_modeling_count > 100 then 'Busy. ' else '' end || coalesce(cluster_majority_primary_topic, '') as described from cluster_labels",
)
def x22(t: Tables):
    same = F.lower("subreddit_name") == F.lower(F.coalesce("primary_topic", F.lit("")))
    title = F.when(same, "").otherwise(F.coalesce(F.concat("primary_topic", F.lit("\n")), F.lit("\n")))
    busy = F.when(F.col("posts_for_modeling_count") > 100, "Busy. ").otherwise("")
    return t.cluster_labels.select("subreddit_id", F.concat("subreddit_name", F.lit(". "), title, busy, F.coalesce("cluster_majority_primary_topic", F.lit(""))).alias("described"))


@query("X23_distinct_join", "select n_regionkey, string_agg(distinct left(n_name, 1), ', ' order by left(n_name, 1)) as initials from nation group by 1")
def x23(t: Tables):
    letters = F.array_sort(F.collect_list(F.left("n_name", F.lit(1))))
    return t.nation.groupBy("n_regionkey").agg(X.distinct_join([letters], ", ").alias("initials"))


@query("X24_theme_words", "select p_partkey, array_to_string(list_sort(list_distinct(split(trim(replace(lower(p_type), 'standard', '')), ' '))), ' ') as themes from part")
def x24(t: Tables):
    words = F.split(F.trim(F.replace(F.lower("p_type"), F.lit("standard"), F.lit(""))), " ")
    return t.part.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("themes"))


@query("X25_tokenizers", "select doc_id, " + ", ".join(f"len({X.tokens_sql('text', n)})::int as {n}" for n in X.SQL_TOKENIZERS) + " from documents where text is not null")
def x25(t: Tables):
    return t.documents.where("text is not null").select("doc_id", *(F.size(X.tokens(F.col("text"), n)).alias(n) for n in X.SQL_TOKENIZERS))


@query("X25b_acronym_tokenizers")
def x25b(t: Tables):
    return t.documents.select("doc_id", *(F.size(X.tokens(F.col("text"), n)).alias(n) for n in ("words_acronyms", "words_acronyms_emoji", "split")))


@query("X26_preprocessor", "select doc_id, len([x for x in regexp_split_to_array(regexp_replace(lower(text), '[0-9]', '', 'g'), '[ \\n\\t\\r\\f\\v]+') if x <> ''])::int as words from documents where text is not null")
def x26(t: Tables):
    return t.documents.where("text is not null").select("doc_id", F.size(X.tokens(F.col("text"), "split", drop_digits=True)).alias("words"))


_WORDS = "[x for x in split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') if x <> '']"


@query(
    "X27_ngrams",
    f"with w as (select doc_id, {_WORDS} as w from documents where text is not null), g as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from w, (values (1), (2), (3)) k(n)) select doc_id, array_to_string(w[i:i + n - 1], ' ') as gram, count(*) as n from g group by 1, 2",
)
def x27(t: Tables):
    grams = t.documents.where("text is not null").select("doc_id", F.explode(X.ngrams(X.normalised_words(F.col("text"), ascii_only=True))).alias("gram"))
    return grams.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))


@query("X28_ngram_type", "select n_name, (length(n_name) - length(replace(n_name, ' ', '')) + 1)::int as size from nation")
def x28(t: Tables):
    return t.nation.select("n_name", X.ngram_size(F.col("n_name")).alias("size"))


@query(
    "X29_stop_words",
    f"with w as (select doc_id, unnest({_WORDS}) as word from documents), s as (select word from w group by 1 having count(distinct doc_id) > (select 0.2 * count(*) from documents)) select word, count(*) as n from w where word not in (select word from s) group by 1 having count(*) >= 20",
)
def x29(t: Tables):
    words = t.documents.select("doc_id", F.explode(X.normalised_words(F.col("text"), ascii_only=True)).alias("word"))
    total = t.documents.agg((0.2 * F.count(F.lit(1))).alias("limit"))
    common = words.groupBy("word").agg(F.count_distinct("doc_id").alias("docs")).join(F.broadcast(total), F.lit(True)).where("docs > limit")
    return words.join(common, "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("X30_linked_names", r"select doc_id, lower(unnest(regexp_extract_all(text, '(?i)\br/(\w{2,21})', 1))) as name from documents")
def x30(t: Tables):
    return t.documents.select("doc_id", F.explode(X.linked_names(F.col("text"))).alias("name"))


@query("X31_link_builder", "select distinct subreddit_id, case when length(subreddit_name) <= 12 then 'short/' || subreddit_name else 'long/' || left(subreddit_name, 12) end as link from cluster_labels")
def x31(t: Tables):
    name = F.col("subreddit_name")
    link = F.when(F.char_length(name) <= 12, F.concat(F.lit("short/"), name)).otherwise(F.concat(F.lit("long/"), F.left(name, F.lit(12))))
    return t.cluster_labels.select("subreddit_id", link.alias("link")).distinct()


@query("X32_language_flags", "select d.doc_id, l.language_name, coalesce(l.language_name_top_only, 'Other_language') as top_only, coalesce(l.supported, false) as supported from documents d left join language_lookup l on l.language_code = split(lower(trim(d.lang)), '-')[1]")
def x32(t: Tables):
    names = F.broadcast(t.language_lookup.select(F.col("language_code").alias("code"), "language_name", "language_name_top_only", "supported"))
    rows = t.documents.withColumn("code", F.get(F.split(F.lower(F.trim("lang")), "-"), F.lit(0))).join(names, "code", "left")
    return rows.select("doc_id", "language_name", F.coalesce("language_name_top_only", F.lit("Other_language")).alias("top_only"), F.coalesce("supported", F.lit(False)).alias("supported"))


@query("X33_nested_label", "select subreddit_id, model_sort_order, concat_ws('-', lpad(k_0023_label::int::varchar, 4, '0'), lpad(k_0097_label::int::varchar, 4, '0')) as path from cluster_labels")
def x33(t: Tables):
    from forumlens.operators.clustering import nested_label

    return t.cluster_labels.select("subreddit_id", "model_sort_order", nested_label(["k_0023_label", "k_0097_label"]).alias("path"))


@query("X34_bound_list", "select s_suppkey from supplier where s_nationkey in (1, 2, 3)")
def x34(t: Tables):
    return t.supplier.where(F.col("s_nationkey").isin([1, 2, 3])).select("s_suppkey")
