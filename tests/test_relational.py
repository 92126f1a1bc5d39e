import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlens.operators import relational as R
from forumlens.operators import sampling


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedupe_keeps_the_latest(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 2, 7), (None, 1, 1), (None, 2, 1)], "id string, at int, removed int")
    got = R.dedupe_latest(df, ["id"], [F.desc("at"), F.desc_nulls_last("removed")])
    assert rows(got) == [("a", 2, 7), (None, 2, 1)]


def test_shares_add_up_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", None)], "k string, p string")
    got = R.share_of_total(df, ["k"], ["p"])
    assert {(r["k"], r["p"]): r["share"] for r in got.collect()} == {("a", "x"): 2 / 3, ("a", "y"): 1 / 3, ("b", None): 1.0}
    assert R.share_of_total(df.limit(0), ["k"], ["p"]).count() == 0


def test_full_outer_fills_and_refuses_clashes(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2), (None, "n", 3)], "k int, name string, a int")
    b = spark.createDataFrame([(2, "y", 7), (3, "z", 8), (None, "m", 9)], "k int, name string, b int")
    got = rows(R.full_outer(a, b, ["k"], ["name"]))
    assert (2, "y", 2, 7) in got and (1, "x", 1, None) in got and (3, "z", None, 8) in got and len(got) == 5
    with pytest.raises(ValueError):
        R.full_outer(a, b, ["k"])


def test_assert_unique(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError):
        R.assert_unique(df, ["k"])
    assert R.assert_unique(df.distinct(), ["k"]).count() == 2


def test_profile_and_value_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, None)], "x string, y int")
    assert rows(R.profile(df)) == [("x", 2, 1, 1, 1 / 3), ("y", 1, 1, 2, 2 / 3)]
    counts = R.value_counts(df, "x").orderBy("cumulative_percent").collect()
    assert [(r["value"], r["n"]) for r in counts] == [("a", 2), (None, 1)] and counts[-1]["cumulative_percent"] == 1.0


def test_majority_ties_go_to_the_first_label(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "k string, l string")
    assert rows(R.majority(df, ["k"], "l")) == [("a", "x")]


def test_stack_and_unstack_are_inverse(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "k string, x int, y int")
    long = R.stack(df, ["k"], ["x", "y"])
    assert long.count() == 3
    assert rows(R.unstack(long, ["k"], "name", F.first("value"), ["x", "y"])) == [("a", 1, 2), ("b", 3, 0)]


def test_missing_compares_as_different(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "c string")
    assert rows(df.where(R.not_equal_or_null(F.col("c"), "x"))) == [("y",), (None,)]


def test_set_overlap(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    got = {(r["a"], r["b"]): r["n"] for r in R.set_overlap(a=ids(1, 2, 2, None), b=ids(2, 3)).collect()}
    assert got == {(True, False): 1, (True, True): 1, (False, True): 1}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5)), max_size=25), st.integers(1, 4))
def test_top_n_equals_sorting(spark, data, n):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k string, v int, i int")
    got = {(r["k"], r["i"]) for r in R.top_n(df, ["k"], [F.desc("v"), F.asc("i")], n).collect()}
    want = set()
    for key in {k for k, _ in data}:
        mine = sorted(((k, v, i) for i, (k, v) in enumerate(data) if k == key), key=lambda r: (-r[1], r[2]))[:n]
        want |= {(k, i) for k, _, i in mine}
    assert got == want


def test_samples_are_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (rows(sampling.hash_sample(d, "k", 3, 10)) for d in (df, df.repartition(7)))
    assert a == b and 200 < len(a) < 400
    assert sampling.seeded_sample(df, 10, 1, "k").collect() == sampling.seeded_sample(df.repartition(3), 10, 1, "k").collect()
    parts = {r["part"]: r["count"] for r in sampling.hash_split(df, "k", {"train": 80, "test": 20}).groupBy("part").count().collect()}
    assert sum(parts.values()) == 1000 and parts["train"] > 700
    assert sampling.stratified_sample(df.withColumn("s", F.col("k") % 3), "s", "k", 5).count() == 15
