import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from forumlens.plans import labels, registry, targeting
from forumlens.sources import store
from forumlens.streaming import windows


def test_partitions_are_replaced_and_others_stay(spark):
    path = store.scratch(spark, "upsert")
    rows = lambda *x: spark.createDataFrame(list(x), "v int, pt int")
    store.overwrite_partitions(rows((1, 1), (2, 2)), path, ["pt"])
    store.overwrite_partitions(rows((9, 1)), path, ["pt"])
    store.overwrite_partitions(rows((9, 1)), path, ["pt"])
    assert sorted((r["pt"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 2)]
    assert {r["v"] for r in store.latest_partition(spark.read.parquet(path), "pt").collect()} == {2}


def test_files_and_artifacts(spark):
    path = store.scratch(spark, "files")
    spark.range(40).repartition(4).write.parquet(f"{path}/run/out.parquet")
    files = store.list_files(spark, f"{path}/run/out.parquet")
    assert len(files) == 4 and store.file_slice(spark, f"{path}/run", "out.parquet", 0, 2).count() < 40
    assert sum(df.count() for _, df in store.files_one_by_one(spark, f"{path}/run", "out.parquet")) == 40
    assert store.read_artifact(spark, path, "run", "out.parquet").count() == 40
    with pytest.raises(FileNotFoundError):
        store.read_artifact(spark, path, "run", "missing.parquet")
    with pytest.raises(FileNotFoundError):
        store.file_slice(spark, path, "nothing.parquet")


def test_headers_are_cleaned(spark):
    assert store.clean_header(spark.createDataFrame([(1, 2, 3)], ["A b", "a  B ", "%"])).columns == ["a_b", "a_b_2", "column"]


def test_label_resolution(spark):
    df = spark.createDataFrame([(None, "M", "E"), ("E", "E", None), (None, None, "X"), (None, None, None)], "c string, w string, m string")
    cols = labels.resolve([("curator", F.col("c")), ("crowd", F.col("w")), ("model", F.col("m"))], F.lit(0.9))
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in cols.items())).collect()]
    assert got == [("M", "crowd", 1.0, "disagree"), ("E", "curator", 1.0, "agree"), ("X", "model", 0.9, "one"), (None, None, None, None)]


def test_audience_read_back(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 2, 0.8), ("h", 1, 0.95), ("h", 3, 0.1)], "g string, user_id int, score double")
    nested = targeting.audience(df, ["g"], 1)
    assert {(r["g"], r["user_id"]) for r in targeting.best_group_per_user(nested, ["g"]).collect()} == {("h", 1)}  # first in both, with the higher score


def test_streams_count_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    counted = windows.run_to_end(events, lambda s: windows.windowed_counts(s, "ts", "1 day"), "ts")
    assert counted.agg(F.sum("n")).first()[0] == events.count()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _comparable(df):
    """Rows as sorted tuples; numbers to nine digits, every kind of missing value alike."""

    def plain(x):
        x = x.tolist() if hasattr(x, "tolist") else x
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return str(x)
        return repr(round(float(x), 9) + 0.0)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_agree_with_sql_on_the_smallest_tables(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    got = df.toPandas()
    if not sql:
        assert len(got.columns)
        return
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("region nation customer supplier part orders lineitem events documents embeddings comment_language_v2 post_language_detection_cld3_clean "
              "comment_language_detection_cld3_clean df_tsne embeddings_community cluster_labels similar_communities language_lookup eval_items token_budgets").split():  # fmt: skip
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert _comparable(got) == _comparable(want)


def test_published_tables_conform(spark):
    from forumlens import schemas

    df = spark.createDataFrame([("c", 3, "extra")], "cluster string, members int, other string")
    got = schemas.conform(df, schemas.CLUSTER_SUMMARY)
    assert got.schema == schemas.CLUSTER_SUMMARY and got.first()["members"] == 3
    assert all(schemas.conform(df, s).count() == 1 for s in schemas.PUBLISHED.values())


def test_labels_never_see_their_own_day(spark):
    labels = spark.sql("select 1 user_id, date '2024-01-10' d, true label union all select 2, date '2024-01-10', false")
    daily = spark.sql("select 1 user_id, date '2024-01-10' day, 5 n union all select 1, date '2024-01-09', 2 union all select 1, date '2023-12-11', 3 union all select 1, date '2023-12-10', 100")
    got = {r["user_id"]: (r["events_before"], r["days_before"], r["label"]) for r in targeting.point_in_time(labels, daily).collect()}
    assert got == {1: (5, 2, True), 2: (0, 0, False)}
    assert targeting.point_in_time(labels.limit(0), daily).count() == 0 and targeting.point_in_time(labels, daily.limit(0)).count() == 2


def test_keywords_need_both_ranks(spark):
    from forumlens.plans import keywords

    rows = [("c", f"g{k:02d}", float(k), float(k if k < 8 else -k)) for k in range(12)] + [("d", "x", None, 1.0)]
    df = spark.createDataFrame(rows, "community string, gram string, tfidf double, bm25 double")
    got = [(r["gram"], r["r1"], r["r2"]) for r in keywords.ranked_keywords(df, 50, 6).where("community = 'c'").orderBy("rank").collect()]
    by = lambda at: {r[1]: n for n, r in enumerate(sorted((r for r in rows if r[0] == "c"), key=lambda r: (-r[at], r[1])), 1)}
    first, second = by(2), by(3)
    want = sorted(((first[g] + second[g]) / 2, g) for g in first if (first[g] + second[g]) / 2 <= 6)
    assert [g for g, _, _ in got] == [g for _, g in want] and all(a == first[g] and b == second[g] for g, a, b in got)


def test_image_texts_in_order(spark):
    from forumlens.plans import content

    df = spark.createDataFrame([("p", 2, 1, "b"), ("p", 1, 2, " a "), ("p", None, 3, "z"), (None, 1, 4, "n"), ("q", 1, 5, None), ("q", 1, 6, "  ")], "post_id string, at int, image_id int, text string")
    assert [tuple(r) for r in content.image_texts(df).collect()] == [("p", "z\na\nb")]
    assert content.image_texts(df.limit(0)).count() == 0
