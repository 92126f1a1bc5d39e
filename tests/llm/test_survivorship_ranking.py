from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forumlens.llm import ranking, survivorship
from forumlens.sources.catalog import table

DETECTIONS = (
    "detection_id long, created_timestamp timestamp, post_id string, id string, user_id string, thing_type string, app_name string, "
    "geolocation_country_code string, language string, probability double, text string, trust string, n string"
)
POSTS = "post_id string, user_id string, id string"


def detection(no, id_, user, at, prob, language="en", text="a b", kind="post", app="ios", geo="DE"):
    return (no, datetime(2023, 1, at) if at else None, id_, id_, user, kind, app, geo, language, prob, text, "clash", "clash")


def run(spark, rows, posts=()):
    got = survivorship.surviving_fields(spark.createDataFrame(rows, DETECTIONS), spark.createDataFrame(list(posts), POSTS))
    return {(r["id"], r["field_name"]): r["detection_id"] for r in got.collect()}


def test_author_first_then_latest_and_spellings_are_one_thing(spark):
    rows = [
        detection(1, "t3_aa", "u1", 1, 0.4, "de"),
        detection(2, " T3_AA ", "u2", 9, 0.9, "en"),
        detection(3, "aa", "u2", 9, 0.9, "fr"),
        detection(4, "aa", "u1", None, 0.9, "es", kind="comment"),
    ]
    got = run(spark, rows, [("aa", "u1", "x"), ("T3_AA", None, "x")])
    assert got[("t3_aa", "language")] == 1
    assert not any(k[0] == "t1_aa" for k in got)  # a single row is no group


def test_unusable_values_fall_through_field_by_field(spark):
    rows = [
        detection(1, "t3_a", "u", 5, 1.5, "en", text="[deleted]", app=" UNKNOWN "),
        detection(2, "t3_a", "u", 4, None, "de", text="kept", app=None, geo="null"),
        detection(3, "t3_a", "u", None, 0.5, "fr", text="  ", app="", geo=None),
    ]
    got = run(spark, rows)
    assert got == {("t3_a", "language"): 3, ("t3_a", "text"): 2, ("t3_a", "geolocation_country_code"): 1}


def test_ties_take_the_smallest_detection_and_null_times_come_last(spark):
    rows = [detection(7, "t3_a", None, 3, 0.5, "de"), detection(5, "t3_a", None, 3, 0.5, "en"), detection(1, "t3_a", None, None, 0.9, "fr")]
    assert run(spark, rows)[("t3_a", "language")] == 5


def test_a_thing_with_many_versions(spark):
    rows = [detection(k, "t3_hot", "u", 1 + k % 20, 0.5, "en", text=f"version {k} of it") for k in range(1, 400)]
    assert run(spark, rows)[("t3_hot", "text")] == 19


def test_no_stage_stands_between_the_trust_order_and_the_survivor(spark, sf):
    detections, posts = table(spark, sf, "comment_language_v2"), table(spark, sf, "post_language_detection_cld3_clean")
    for with_value in (False, True):
        plan = survivorship.surviving_fields(detections, posts, with_value)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "collect_list" not in plan and "row_number()" in plan
    rng = __import__("random").Random(5)
    rows = [detection(k, f"t3_{rng.randrange(9)}", rng.choice("uvw"), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.2, 0.9]), rng.choice([None, "de", "en"]), text=rng.choice([" ", "a b", "a c b", "c"])) for k in range(700)]
    order = sorted(rows, key=lambda r: (r[4] != "u", r[1] is None, -(r[1].timestamp() if r[1] else 0), r[9] is None, -(r[9] or 0), r[0]))
    want: dict = {}
    for r in order:
        for field, value, ok in (("text", r[10], True), ("language", r[8], r[9] is not None), ("app_name", r[6], True), ("geolocation_country_code", r[7], True)):
            if ok and value and value.strip():
                want.setdefault((r[3], field), r[0])
    assert run(spark, rows, [(str(k), "u", "x") for k in range(9)]) == want


def test_empty_and_null_ids(spark):
    assert run(spark, []) == {}
    assert run(spark, [detection(1, None, None, 1, 0.5), detection(2, None, None, 1, 0.5)]) == {}


def test_consensus_votes_by_column():
    values = [v.split() for v in ("the cat sat down", "the cat sat", "the dog sat down", "a cat sat down")]
    assert survivorship.consensus(values, [1, 1, 1, 1]) == "the cat sat down".split()
    assert survivorship.closest_to_consensus(["x y z", "x q z", "x q z"]) == 0  # the first outweighs the rest together
    assert survivorship.closest_to_consensus(["", "a"]) == 0
    long = " ".join(str(k) for k in range(3000))
    assert survivorship.closest_to_consensus([long, long.replace("7", "x"), "y"]) == 0


def test_agreement_decides_where_evidence_is_weighed(spark):
    rows = [
        detection(1, "t3_a", "u", 9, 0.9, "de", text="the cat sat on teh mat"),  # latest, so first in trust order
        detection(2, "t3_a", "v", 5, 0.8, "en", text="the cat sat on the mat"),
        detection(3, "t3_a", "w", 4, 0.8, "en", text="the cat sat on the mat"),
        detection(4, "t3_a", "x", 3, None, "en", text="a cat sat on the mat today"),
        detection(5, "t3_b", "w", 4, 0.6, "en"), detection(6, "t3_b", "a", 1, 0.6, "fr"),
    ]
    tables = spark.createDataFrame(rows, DETECTIONS), spark.createDataFrame([("b", "a", "x")], POSTS)
    trusted = {(r["id"], r["field_name"]): r["detection_id"] for r in survivorship.surviving_fields(*tables).collect()}
    for chunk in (256, 2):
        got = {(r["id"], r["field_name"]): r for r in survivorship.consensus_fields(*tables, chunk=chunk).collect()}
        assert got[("t3_a", "text")]["detection_id"] == 2 and trusted[("t3_a", "text")] == 1
        assert got[("t3_a", "language")]["value"] == "en" and got[("t3_a", "language")]["detection_id"] == 2 and trusted[("t3_a", "language")] == 1
        assert (got[("t3_a", "text")]["votes"], got[("t3_a", "text")]["values"]) == (4, 3) and 0.5 < got[("t3_a", "text")]["support"] < 0.7
        assert got[("t3_b", "language")]["value"] == "fr" and got[("t3_b", "language")]["support"] == pytest.approx(2 / 3)  # by the author


def test_a_consensus_that_no_value_equals():
    values = ["x b c d", "a y c d", "a b z d"]
    assert survivorship.consensus([v.split() for v in values], [1.0, 1.0, 1.0]) == "a b c d".split()
    assert survivorship.closest_to_consensus(values, [1.0, 1.0, 1.0]) == 0 and survivorship.closest_to_consensus(["x y c d", "a b z d", "a b c e"], [1.0, 1.0, 1.0]) == 1


def test_consensus_over_a_real_table_and_empty_ones(spark, sf):
    detections, posts = table(spark, sf, "comment_language_v2"), table(spark, sf, "post_language_detection_cld3_clean")
    by_evidence, by_trust = survivorship.consensus_fields(detections, posts).toPandas(), survivorship.surviving_fields(detections, posts, with_value=True).toPandas()
    both = by_evidence.merge(by_trust, on=["id", "field_name"], suffixes=("", "_trusted"))
    assert len(both) == len(by_evidence) == len(by_trust) and (both["support"] > 0).all() and (both["support"] <= 1 + 1e-9).all()
    single = both[both["values"] == 1]
    assert (single["value"] == single["value_trusted"]).all() and (single["detection_id"] == single["detection_id_trusted"]).all() and (both["value"] != both["value_trusted"]).any()
    assert survivorship.consensus_fields(detections.limit(0), posts).count() == 0


def test_alignments_beyond_the_table_are_exact(monkeypatch):
    rng = __import__("random").Random(3)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(1, 40))], [rng.choice("abc") for _ in range(rng.randrange(1, 40))]) for _ in range(60)]
    whole = [survivorship.distance(a, b) for a, b in pairs]
    monkeypatch.setattr(survivorship, "CELLS", 6)
    assert [survivorship.distance(a, b) for a, b in pairs] == whole
    for a, b in pairs:
        found = survivorship.align(a, b)
        assert [i for i, _ in found if i >= 0] == list(range(len(a))) and [j for _, j in found if j >= 0] == list(range(len(b)))


def test_alignment_covers_both_sides():
    pairs = survivorship.align(list("kitten"), list("sitting"))
    assert [i for i, _ in pairs if i >= 0] == list(range(6)) and [j for _, j in pairs if j >= 0] == list(range(7))
    assert survivorship.distance(list("kitten"), list("sitting")) == 3


def test_top_n_equals_brute_force_with_a_hot_group_and_ties(spark):
    rows = [("hot" if k % 3 else f"g{k % 7}", k % 11, f"id{k:04d}") for k in range(600)] + [("null", None, "a"), (None, 1, "b"), ("hot", 10, "id0010")]
    df = spark.createDataFrame(rows, "g string, score long, id string")
    got = ranking.top_n_per_group(df, ["g"], [F.desc_nulls_last("score")], 4, ["id"], "rank", salts=8)
    want = set()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[:4]
        want |= {(g, r[2], k + 1) for k, r in enumerate(mine)}
    assert {(r["g"], r["id"], r["rank"]) for r in got.collect()} == want
    assert ranking.top_n_per_group(df.limit(0), ["g"], [F.desc("score")], 2, ["id"]).count() == 0
    with pytest.raises(ValueError):
        ranking.top_n_per_group(df, ["g"], [F.desc("score")], 0, ["id"])


def test_topic_ranking_rules(spark):
    schema = "pt date, subreddit_id string, subreddit_name string, curator_topic_v2 string, users_l7 long, posts_l7 long, rank_by_topic_v2 long, loaded_at timestamp, topic string, name string"
    d, t = datetime(2019, 1, 7).date(), datetime
    rows = [
        (d, "a", "Zed", " Pets", 9, 1, 1, t(2019, 1, 8), "x", "y"),
        (d, "a", "Zed", "pets", 5, 1, 1, t(2019, 1, 9), "x", "y"),
        (d, "b", "abe", "PETS ", 5, None, 1, t(2019, 1, 8), "x", "y"),
        (d, "c", "Abc", "pets", 5, 1, 1, t(2019, 1, 8), "x", "y"),
        (d, "e", "e", None, 50, 1, 1, None, "x", "y"),
        (d, "f", "f", "pets", None, 1, 1, None, "x", "y"),
    ]
    got = ranking.topic_ranking(spark.createDataFrame(rows, schema)).collect()
    assert [(r["subreddit_id"], r["rank_by_topic_v2"]) for r in sorted(got, key=lambda r: r["rank_by_topic_v2"])] == [("c", 1), ("a", 2), ("b", 3)]
