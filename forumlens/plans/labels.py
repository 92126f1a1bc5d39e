"""Labels from several sources and their quality (Q26, Q27, Q39, Q40, Q44, Q47, Q49)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions import scalars as S
from forumlens.operators import metrics
from forumlens.operators import relational as R

from .registry import Tables, query


def resolve(sources: Sequence[tuple[str, Column]], score: Column, sure: Column | None = None) -> dict[str, Column]:
    """The first source with a label wins: `label`, `source`, `confidence` (1 for all but the last source), `agreement`.

    `agreement` is 'one' with a single known label, 'agree' if all known are equal, else 'disagree'; null without any.
    """
    label = F.coalesce(*(c for _, c in sources))
    source = F.coalesce(*(F.when(c.isNotNull(), name) for name, c in sources))
    known = F.array_compact(F.array(*(c for _, c in sources)))
    agreement = F.when(F.size(known) == 0, None).when(F.size(known) == 1, "one").when(F.size(F.array_distinct(known)) == 1, "agree").otherwise("disagree")
    return {"label": label, "source": source, "confidence": F.when(label.isNull(), None).when(source == sources[-1][0], score).otherwise(1.0), "agreement": agreement}


def decision(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The action of the first rule that holds; a rule whose condition is null does not hold."""
    out = None
    for condition, action in rules:
        out = F.when(condition, action) if out is None else out.when(condition, action)
    return out.otherwise(otherwise)


def quantile_profile(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact discrete quantiles per group, one column per point (`p25` for 0.25); nulls do not count."""
    q = ", ".join(f"percentile_disc({p}) within group (order by `{value}`) as p{round(100 * p):02d}" for p in points)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*(F.expr(x) for x in q.split(", ")))


def lift(df: DataFrame, keys: Sequence[str], arm: str, value: str, control: str, low: float, high: float) -> DataFrame:
    """Winsorised effect of the other arm against `control` per group: `effect` (relative), `z`, `significant`.

    Values are clamped to [low, high]; groups that lack an arm, or have a control mean of zero, have a null effect.
    """
    v = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    side = lambda c: {n: f(F.when(c, v)) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))}
    is_control = F.col(arm) == control
    both = df.groupBy(*keys).agg(*(c.alias(f"{p}_{n}") for p, cond in (("c", is_control), ("t", ~is_control)) for n, c in side(cond).items()))
    error = F.sqrt(F.try_divide("c_s", "c_n") + F.try_divide("t_s", "t_n"))
    z = S.safe_divide(F.col("t_m") - F.col("c_m"), error)
    return both.select(*keys, S.safe_divide(F.col("t_m") - F.col("c_m"), F.col("c_m")).alias("effect"), z.alias("z"), S.is_significant(z).alias("significant"))


def sources_of(t: Tables) -> DataFrame:
    """One row per community: topics of the curators, the earlier run and its clusters."""
    bare = lambda c: F.lower(F.trim(c))
    curator = t.df_tsne.groupBy("subreddit_id").agg(F.max(bare("curator_topic")).alias("curator"))
    earlier = t.cluster_labels.where("subreddit_id is not null").groupBy("subreddit_id").agg(
        F.max(bare("primary_topic")).alias("crowd"), F.max(bare("cluster_majority_primary_topic")).alias("model"), F.max("posts_for_modeling_count").alias("posts")
    )
    return R.full_outer(curator, earlier, ["subreddit_id"])


_SRC = (
    "(select coalesce(a.subreddit_id, b.subreddit_id) as subreddit_id, curator, crowd, model, posts from (select subreddit_id, max(lower(trim(curator_topic))) as curator from df_tsne group by 1) a full join"
    " (select subreddit_id, max(lower(trim(primary_topic))) as crowd, max(lower(trim(cluster_majority_primary_topic))) as model, max(posts_for_modeling_count) as posts from cluster_labels where subreddit_id is not null group by 1) b on a.subreddit_id = b.subreddit_id)"
)


@query(
    "Q26_decision_flags",
    f"select subreddit_id, case when curator is not null and crowd is not null and curator <> crowd then 'review' when coalesce(curator, crowd, model) is null then 'missing' when coalesce(posts, 0) < 3 then 'too small' else 'keep' end as action from {_SRC}",
)
def q26(t: Tables):
    c = F.col
    rules = [(c("curator") != c("crowd"), "review"), (F.coalesce("curator", "crowd", "model").isNull(), "missing"), (F.coalesce("posts", F.lit(0)) < 3, "too small")]
    return sources_of(t).select("subreddit_id", decision(rules, "keep").alias("action"))


@query(
    "Q27_label_resolution",
    f"select subreddit_id, coalesce(curator, crowd, model) as label, case when curator is not null then 'curator' when crowd is not null then 'crowd' when model is not null then 'model' end as source,"
    f" case when coalesce(curator, crowd) is not null then 1.0::double when model is not null then 0.5::double end as confidence, case k when 0 then null when 1 then 'one' else case when d = 1 then 'agree' else 'disagree' end end as agreement from (select *, (curator is not null)::int + (crowd is not null)::int + (model is not null)::int as k, len(list_distinct([curator, crowd, model])) as d from {_SRC})",
)
def q27(t: Tables):
    c = F.col
    rows = sources_of(t)
    return rows.select("subreddit_id", *(v.alias(k) for k, v in resolve([("curator", c("curator")), ("crowd", c("crowd")), ("model", c("model"))], F.lit(0.5)).items()))


@query("Q39_quantile_profile", "select post_type, " + ", ".join(f"quantile_disc(comment_text_length, {p}) as p{round(100 * p):02d}" for p in (0.05, 0.5, 0.95)) + " from comment_language_detection_cld3_clean where comment_text_length is not null group by 1")
def q39(t: Tables):
    out = quantile_profile(t.comment_language_detection_cld3_clean, ["post_type"], "comment_text_length", (0.05, 0.5, 0.95))
    return out.select("post_type", *(F.col(c).cast("bigint").alias(c) for c in ("p05", "p50", "p95")))


_PRED = f"(select crowd as truth, model as found from {_SRC} where crowd is not null and model is not null)"


@query(
    "Q40_prediction_quality",
    f"with a as (select truth as label, count(*) as support, count(case when truth = found then 1 end) as hits from {_PRED} group by 1), b as (select found as label, count(*) as predicted from {_PRED} group by 1) select coalesce(a.label, b.label) as label, coalesce(support, 0)::bigint as support, coalesce(predicted, 0)::bigint as predicted,"
    " round(coalesce(hits / nullif(predicted, 0), 0), 6) as precision, round(coalesce(hits / nullif(support, 0), 0), 6) as recall from a full join b on a.label = b.label",
)
def q40(t: Tables):
    report = metrics.class_report(sources_of(t), "crowd", "model")
    return report.select("label", "support", "predicted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "Q44_experiment_lift",
    "with e as (select event_type, user_id % 2 = 0 as control, least(greatest(value, 1), 90) as v from events), g as (select event_type, avg(case when control then v end) as cm, var_samp(case when control then v end) as cs, count(case when control then v end) as cn, avg(case when not control then v end) as tm, var_samp(case when not control then v end) as ts, count(case when not control then v end) as tn from e group by 1)"
    " select event_type, round((tm - cm) / nullif(cm, 0), 6) as effect, round((tm - cm) / nullif(sqrt(cs / cn + ts / tn), 0), 5) as z, abs((tm - cm) / nullif(sqrt(cs / cn + ts / tn), 0)) > 1.96 as significant from g",
)
def q44(t: Tables):
    arms = t.events.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "control").otherwise("test"))
    out = lift(arms, ["event_type"], "arm", "value", "control", 1.0, 90.0)
    return out.select("event_type", F.round("effect", 6).alias("effect"), F.round("z", 5).alias("z"), "significant")


@query(
    "Q47_programme_union",
    "select coalesce(a.id, b.id) as id, coalesce(a.country, b.country, 'US') as country, case when a.id is not null and b.id is not null then 'both' when a.id is not null then 'new' else 'old' end as programme from (select subreddit_id as id, min(geo_country_code) as country from post_language_detection_cld3_clean where subreddit_id is not null group by 1) a full join (select subreddit_id as id, min(geo_country_code) as country from comment_language_detection_cld3_clean where subreddit_id is not null group by 1) b on a.id = b.id",
)
def q47(t: Tables):
    side = lambda df, name: df.where("subreddit_id is not null").groupBy(F.col("subreddit_id").alias("id")).agg(F.min("geo_country_code").alias(f"country_{name}")).withColumn(name, F.lit(True))
    both = R.full_outer(side(t.post_language_detection_cld3_clean, "new"), side(t.comment_language_detection_cld3_clean, "old"), ["id"])
    programme = F.when(F.col("new") & F.col("old"), "both").when(F.col("new"), "new").otherwise("old")
    return both.select("id", F.coalesce("country_new", "country_old", F.lit("US")).alias("country"), programme.alias("programme"))


@query(
    "Q49_target_labels",
    "select distinct c.subreddit_id, c.k_0023_label::int as label from cluster_labels c join (select distinct subreddit_id from post_language_detection_cld3_clean where geo_country_code = 'DE') g on g.subreddit_id = c.subreddit_id where c.model_sort_order is not null and c.k_0023_label is not null",
)
def q49(t: Tables):
    geo = t.post_language_detection_cld3_clean.where("geo_country_code = 'DE'").select("subreddit_id")
    kept = t.cluster_labels.where("model_sort_order is not null and k_0023_label is not null").join(geo, "subreddit_id", "left_semi")
    return kept.select("subreddit_id", F.col("k_0023_label").cast("int").alias("label")).distinct()
