"""Features and audiences for targeting (Q33 to Q38).

`events` plays the log: a view is a send, a click a receipt, a purchase the answer; a signup marks subscription.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.functions import scalars as S
from forumlens.operators import relational as R

from .registry import Tables, query

AS_OF = "2024-01-30"


def community_features(activity: DataFrame, keys: Sequence[str], counts: Sequence[str], total: str) -> DataFrame:
    """Log features of every count, and each count's share of `total`."""
    logs = [F.round(S.log_feature(F.col(c)), 6).alias(f"log_{c}") for c in counts]
    shares = [F.round(S.safe_divide(F.col(c), F.col(total)), 6).alias(f"share_{c}") for c in counts if c != total]
    return activity.select(*keys, *logs, *shares)


def user_features(events: DataFrame, as_of: str, kinds: Sequence[str], windows: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Per user: events of each kind in each trailing window, all in one pass over the log."""
    d, end = F.to_date("ts"), F.lit(as_of).cast("date")
    cells = [F.count(F.when((F.col("event_type") == k) & S.within_days(d, end, n), 1)).alias(f"{k}_t{n}") for k in kinds for n in windows]
    return events.where(S.within_days(d, end, max(windows))).groupBy("user_id").agg(*cells)


def pair_features(subscriptions: DataFrame, activity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of both sides with zeros for what is missing and a flag for subscription."""
    both = R.full_outer(subscriptions, activity, keys)
    numbers = [c for c, kind in both.dtypes if kind in ("bigint", "int", "double") and c not in keys]
    return both.na.fill(0, numbers).withColumn("is_subscribed", F.coalesce("is_subscribed", F.lit(False)))


def training_labels(events: DataFrame) -> DataFrame:
    """Per user and day: sends, receipts, answers, and the label: answered on the day or the next."""
    n = lambda k, name: F.count(F.when(F.col("event_type") == k, 1)).alias(name)
    daily = events.groupBy("user_id", F.to_date("ts").alias("d")).agg(n("view", "sends"), n("click", "receipts"), n("purchase", "answers"))
    later = daily.select("user_id", F.date_sub("d", 1).alias("d"), F.col("answers").alias("next_day"))
    joined = daily.join(later, ["user_id", "d"], "left").where("sends > 0")
    return joined.select("user_id", "d", "sends", "receipts", ((F.col("answers") > 0) | (F.coalesce("next_day", F.lit(0)) > 0)).alias("label"))


def point_in_time(labels: DataFrame, daily: DataFrame, days: int = 30) -> DataFrame:
    """Each label row (user_id, d) with what its user did in the `days` days before: the day of the label itself is never seen.

    `daily` has user_id, day, n: pre-aggregated, so a user with millions of events is at most one row a day in the join.
    """
    seen = labels.select("user_id", "d").join(daily, "user_id").where((F.col("day") < F.col("d")) & (F.col("day") >= F.date_sub("d", days)))
    sums = seen.groupBy("user_id", "d").agg(F.sum("n").alias("events_before"), F.count(F.lit(1)).alias("days_before"))
    return labels.join(sums, ["user_id", "d"], "left").na.fill(0, ["events_before", "days_before"])


def audience(scores: DataFrame, groups: Sequence[str], keep: int) -> DataFrame:
    """The best `keep` users per group, nested in order of rank; input has the groups, user_id, score."""
    ranked = R.top_n(scores, groups, [F.desc("score"), F.asc("user_id")], keep)
    return ranked.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("rank", "user_id", "score"))).alias("top_users"))


def best_group_per_user(nested: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each user once, in the group where they rank best."""
    flat = nested.select(*groups, F.explode("top_users").alias("u")).select(*groups, "u.*")
    return R.dedupe_latest(flat, ["user_id"], [F.asc("rank"), F.desc("score"), *(F.asc(g) for g in groups)])


_ACT = "(select event_type, count(*) as events, count(distinct user_id) as users, count(case when value > 50 then 1 end) as high from events group by 1)"


@query("Q33_community_features", f"select event_type, round(ln(1 + events), 6) as log_events, round(ln(1 + users), 6) as log_users, round(ln(1 + high), 6) as log_high, round(users / nullif(events, 0), 6) as share_users, round(high / nullif(events, 0), 6) as share_high from {_ACT}")
def q33(t: Tables):
    g = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count(F.when(F.col("value") > 50, 1)).alias("high"))
    return community_features(g, ["event_type"], ["events", "users", "high"], "events")


_UF = ", ".join(f"count(case when event_type = '{k}' and cast(ts as date) > date '{AS_OF}' - {n} then 1 end) as {k}_t{n}" for k in ("view", "click", "purchase") for n in (7, 14, 30))


@query("Q34_user_features", f"select user_id, {_UF} from events where cast(ts as date) > date '{AS_OF}' - 30 and cast(ts as date) <= date '{AS_OF}' group by 1")
def q34(t: Tables):
    return user_features(t.events, AS_OF, ("view", "click", "purchase"))


@query(
    "Q35_pair_features",
    "with s as (select user_id, event_id % 5 as item, true as is_subscribed, min(cast(ts as date))::varchar as since from events where event_type = 'signup' group by 1, 2), a as (select user_id, event_id % 5 as item, count(*) as n, count(distinct cast(ts as date)) as days from events where event_type <> 'signup' and ts >= timestamp '2024-01-16' group by 1, 2)"
    " select coalesce(s.user_id, a.user_id) as user_id, coalesce(s.item, a.item)::bigint as item, coalesce(is_subscribed, false) as is_subscribed, since, coalesce(n, 0)::bigint as n, coalesce(days, 0)::bigint as days from s full join a on s.user_id = a.user_id and s.item = a.item",
)
def q35(t: Tables):
    e = t.events.withColumn("item", F.col("event_id") % 5)
    s = e.where("event_type = 'signup'").groupBy("user_id", "item").agg(F.lit(True).alias("is_subscribed"), F.min(F.to_date("ts")).cast("string").alias("since"))
    a = e.where("event_type <> 'signup' and ts >= '2024-01-16'").groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))
    return pair_features(s, a, ["user_id", "item"])


@query(
    "Q36_feature_join",
    f"with u as (select user_id, count(*) as events_t30 from events where cast(ts as date) > date '{AS_OF}' - 30 and cast(ts as date) <= date '{AS_OF}' group by 1), p as (select user_id, event_type, count(*) as n from events group by 1, 2), c as (select event_type, count(distinct user_id) as users from events group by 1) select p.user_id, p.event_type, p.n, coalesce(u.events_t30, 0)::bigint as events_t30, c.users from p left join u on u.user_id = p.user_id left join c on c.event_type = p.event_type",
)
def q36(t: Tables):
    u = t.events.where(S.within_days(F.to_date("ts"), F.lit(AS_OF).cast("date"), 30)).groupBy("user_id").agg(F.count(F.lit(1)).alias("events_t30"))
    p = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    c = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return p.join(u, "user_id", "left").join(c, "event_type", "left").select("user_id", "event_type", "n", F.coalesce("events_t30", F.lit(0)).alias("events_t30"), "users")


@query(
    "Q36b_training_join",
    "with d as (select user_id, cast(ts as date) as d, count(case when event_type = 'view' then 1 end) as sends, count(case when event_type = 'click' then 1 end) as receipts, count(case when event_type = 'purchase' then 1 end) as answers, count(*) as n from events group by 1, 2), l as (select a.user_id, a.d, a.sends, a.receipts, a.answers > 0 or coalesce(b.answers, 0) > 0 as label from d a left join d b on b.user_id = a.user_id and b.d = a.d + 1 where a.sends > 0)"
    " select l.user_id, l.d::varchar as d, l.sends, l.receipts, l.label, coalesce(sum(x.n), 0)::bigint as events_before, count(x.n) as days_before from l left join d x on x.user_id = l.user_id and x.d < l.d and x.d >= l.d - 30 group by 1, 2, 3, 4, 5",
)
def q36b(t: Tables):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return point_in_time(training_labels(t.events), daily).withColumn("d", F.col("d").cast("string"))


_APPS = ("ios", "android", "mweb", "desktop2x", "old_web")


@query(
    "Q33b_platforms_and_places",
    "with r as (select subreddit_id, lower(trim(app_name)) as app, upper(trim(geolocation_country_code)) as country, user_id from comment_language_v2 where subreddit_id is not null), g as (select subreddit_id, count(*) as n, count(distinct user_id) as users, " + ", ".join(f"count(case when app = '{a}' then 1 end) as {a}" for a in _APPS) + " from r group by 1),"
    " c as (select subreddit_id, country, count(*) as n, sum(count(*)) over (partition by subreddit_id) as total from r where country is not null group by 1, 2), k as (select subreddit_id, string_agg(country, ', ' order by country) as countries from c where n >= 0.05 * total group by 1)"
    " select g.subreddit_id, round(ln(1 + n), 6) as log_n, round(ln(1 + users), 6) as log_users, " + ", ".join(f"round({a} / n, 6) as share_{a}" for a in _APPS) + ", coalesce(countries, '') as countries from g left join k on k.subreddit_id = g.subreddit_id",
)
def q33b(t: Tables):
    rows = t.comment_language_v2.where("subreddit_id is not null").select("subreddit_id", F.lower(F.trim("app_name")).alias("app"), F.upper(F.trim("geolocation_country_code")).alias("country"), "user_id")
    apps = [F.count(F.when(F.col("app") == a, 1)).alias(a) for a in _APPS]
    g = rows.groupBy("subreddit_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), *apps)
    wide = community_features(g, ["subreddit_id"], ["n", "users", *_APPS], "n").drop("share_users", *(f"log_{a}" for a in _APPS))
    places = R.share_of_total(rows.where("country is not null"), ["subreddit_id"], ["country"]).where("share >= 0.05")
    lists = places.groupBy("subreddit_id").agg(F.array_join(F.array_sort(F.collect_list("country")), ", ").alias("countries"))
    return wide.join(lists, "subreddit_id", "left").na.fill("", ["countries"])


@query(
    "Q37_training_labels",
    "with d as (select user_id, cast(ts as date) as d, count(case when event_type = 'view' then 1 end) as sends, count(case when event_type = 'click' then 1 end) as receipts, count(case when event_type = 'purchase' then 1 end) as answers from events group by 1, 2) select a.user_id, a.d::varchar as d, a.sends, a.receipts, a.answers > 0 or coalesce(b.answers, 0) > 0 as label from d a left join d b on b.user_id = a.user_id and b.d = a.d + 1 where a.sends > 0",
)
def q37(t: Tables):
    return training_labels(t.events).withColumn("d", F.col("d").cast("string"))


_SCORES = "(select event_type, user_id, round(avg(value), 4) as score from events group by 1, 2)"


def scores(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 4).alias("score"))


@query("Q38_audience", f"with r as (select *, row_number() over (partition by event_type order by score desc, user_id) as k from {_SCORES}) select event_type, string_agg(user_id::varchar, ',' order by k) as users from r where k <= 25 group by 1")
def q38(t: Tables):
    nested = audience(scores(t), ["event_type"], 25)
    return nested.select("event_type", F.array_join(F.transform("top_users", lambda u: u["user_id"].cast("string")), ",").alias("users"))


@query(
    "Q38_best_group_per_user",
    f"with r as (select *, row_number() over (partition by event_type order by score desc, user_id) as k from {_SCORES}) select user_id, event_type, k::int as rank from r where k <= 25 qualify row_number() over (partition by user_id order by k, score desc, event_type) = 1",
)
def q38b(t: Tables):
    return best_group_per_user(audience(scores(t), ["event_type"], 25), ["event_type"]).select("user_id", "event_type", "rank")

