import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.operators import alignment, metrics
from forumlens.operators import clustering as C
from forumlens.operators import graph
from forumlens.operators import vectors as V
from forumlens.plans import clusters, content, keywords, registry
from forumlens.sources.catalog import table


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(f) for f in v], *e) for i, (v, e) in enumerate(zip(x, extra or [()] * len(x)))], "id long, v array<double>" + (", g string, w double" if extra else ""))


def test_weighted_mean(spark):
    df = frame(spark, [[1, 0], [0, 1], [5, 5]], [("a", 3.0), ("a", 1.0), ("b", 0.0)])
    got = {r["g"]: r["vector"] for r in V.mean_vector(df, ["g"], "v", F.col("w")).collect()}
    assert got["a"] == pytest.approx([0.75, 0.25]) and got["b"] is None
    alone = V.mean_vector(df.where("id = 2"), ["g"], "v").collect()
    assert alone[0]["vector"] == [5, 5] and V.mean_vector(df.limit(0), ["g"], "v").count() == 0


def test_mixes(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], None), (None, None)], "d array<double>, r array<double>")
    got = [r[0] for r in df.select(V.mix([(F.col("d"), 70), (F.col("r"), 20)])).collect()]
    assert got[0] == pytest.approx([7 / 9, 2 / 9]) and got[1] == pytest.approx([1, 0]) and got[2] is None


def test_rollup_limits(spark):
    docs = spark.createDataFrame([("a", [1.0]), ("a", [3.0]), ("b", [1.0]), ("b", [2.0]), ("b", [6.0])], "g string, v array<double>")
    own = spark.createDataFrame([("a", [5.0]), ("b", [9.0]), ("c", [4.0])], "g string, community array<double>")
    got = {r["g"]: (r["documents"], r["vector"][0]) for r in content.community_rollup(docs, own, "g", "v", 3).collect()}
    assert got == {"a": (2, 3.0), "b": (3, 3.0), "c": (0, 4.0)}


def test_a_large_community_keeps_its_documents(spark):
    docs = spark.createDataFrame([(i, f"p{i}", "c", "2024-01-01", i % 7, "some text") for i in range(45)], "doc_id long, post_id string, subreddit_id string, dt string, upvotes long, text string")
    found = spark.createDataFrame([("p3", "2024-01-01", "de")], "post_id string, dt string, weighted_language_code string")
    got = content.q8b(SimpleNamespace(documents=docs, post_language_detection_cld3_clean=found)).collect()
    want = sorted(range(45), key=lambda i: (-(i % 7), i))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank_in_community"])] == want
    assert {r["doc_id"] for r in got if r["language"] == "de"} == {3}


def test_angles_and_cosines(spark):
    df = spark.createDataFrame([(0.0,), (2**0.5,), (2.0,)], "d double")
    assert [r[0] for r in df.select(V.angular_to_cosine(F.col("d"))).collect()] == pytest.approx([1, 0, -1])
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert zero.select(V.l2_normalise(F.col("a"))).first()[0] == [0.0, 0.0]


@pytest.mark.parametrize("block", [1000, 13])
def test_topk_equals_brute_force(spark, block):
    x = np.random.default_rng(1).standard_normal((60, 8))
    x[7] = x[3]
    got = {(r["id_a"], r["distance_rank"]): r["id_b"] for r in V.cosine_topk(frame(spark, x), "id", "v", 4, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    assert got == {(i, k + 1): j for i in range(60) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:4])}
    assert got[(3, 1)] == 7 and V.cosine_topk(frame(spark, x).limit(0), "id", "v", 2).count() == 0


def naive_ward(x):
    groups, out = {i: [i] for i in range(len(x))}, []
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    ma, mb = x[groups[a]].mean(0), x[groups[b]].mean(0)
                    d = np.sqrt(2 * len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b]))) * np.linalg.norm(ma - mb)
                    if best is None or d < best[0]:
                        best = (d, a, b)
        d, a, b = best
        groups[len(x) + len(out)] = groups.pop(a) + groups.pop(b)
        out.append(d)
    return np.array(out)


def test_ward_tree_equals_the_definition():
    x = np.random.default_rng(2).standard_normal((25, 3))
    tree = C.ward_tree(x)
    assert np.allclose(tree[:, 2], naive_ward(x)) and tree[-1, 3] == 25
    flat = C.cut(tree, 25, (1, 2, 5, 25))
    assert {k: len(set(v)) for k, v in flat.items()} == {1: 1, 2: 2, 5: 5, 25: 25}
    assert all(len({flat[2][i] for i in np.nonzero(flat[5] == c)[0]}) == 1 for c in set(flat[5]))
    assert sorted(C.leaf_order(tree, 25)) == list(range(25))
    assert len(C.ward_tree(x[:1])) == 0


def test_ward_queries_cover_every_vector(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").toPandas().sort_values("vec_id", ignore_index=True)
    x = np.stack(rows["embedding"]).astype(float)
    tree = C.ward_tree(x / np.linalg.norm(x, axis=1, keepdims=True))
    run = lambda name: registry.queries()[name](spark, sf).toPandas()
    labels = run("V11_ward_clusters")
    for k, flat in C.cut(tree, len(x), (2, 5, 10, 23)).items():
        mine = labels[labels["k"] == k].sort_values("vec_id")
        assert mine["vec_id"].tolist() == rows["vec_id"].tolist() and mine["label"].tolist() == flat.tolist()
    assert {(r.k, r.clusters, r.rows) for r in run("V14_flat_cuts").itertuples()} == {(k, k, len(x)) for k in (2, 5, 10, 23)}
    assert run("V15_leaf_order").sort_values("vec_id")["model_sort_order"].tolist() == C.leaf_order(tree, len(x)).tolist()
    nested = run("Q20_hierarchical_clusters").sort_values("vec_id")
    assert nested["vec_id"].tolist() == rows["vec_id"].tolist() and nested["16"].tolist() == C.cut(tree, len(x), (16,))[16].tolist()


def test_large_tables_are_reduced_first(spark):
    x = np.concatenate([np.random.default_rng(3).normal(c, 0.1, (40, 4)) for c in (0, 5, 10)])
    got = C.labels_long(frame(spark, x), "id", "v", (3,), normalise=False, limit=20).toPandas()
    assert len(got) == 120 and all(got[got["id"] // 40 == c]["label"].nunique() == 1 for c in range(3))
    with pytest.raises(ValueError):
        C.collect_points(frame(spark, x), "id", "v", 20)


@pytest.mark.parametrize("limit", [20, 200])
def test_linkage_says_what_its_leaves_stand_for(spark, limit):
    x = np.concatenate([np.random.default_rng(3).normal(c, 0.1, (40, 4)) for c in (0, 5, 10)])
    got = C.linkage(frame(spark, x), "id", "v", limit).toPandas()
    tree, leaves = got[got["merge"].notna()].sort_values("merge"), got[got["id"].notna()]
    n = len(tree) + 1
    assert sorted(leaves["id"]) == list(range(120)) and set(leaves["leaf"]) == set(range(n)) and n == min(limit, 120)
    below = {int(k): set(g["id"].astype(int)) for k, g in leaves.groupby("leaf")}
    for m in tree.itertuples():
        below[n + int(m.merge)] = below[int(m.first)] | below[int(m.second)]
        assert len(below[n + int(m.merge)]) == m.count
    assert {frozenset(below[int(k)]) for k in tree.iloc[-2:][["first", "second"]].to_numpy().ravel()} >= {frozenset(range(80, 120))}


def test_unit_length_comes_before_centres(spark):
    x = np.random.default_rng(4).standard_normal((60, 3)) * np.random.default_rng(5).uniform(0.1, 9, (60, 1))
    leaves, points, sizes = C.tree_leaves(frame(spark, x), "id", "v", 10, normalise=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k, g in leaves.toPandas().groupby("leaf"):
        assert len(g) == sizes[k] and np.allclose(points[k], unit[g["id"]].mean(0), atol=0.2)


def test_dynamic_rollup(spark):
    df = spark.createDataFrame([(i, "1", "1-1" if i < 6 else "1-2") for i in range(8)] + [(9, "2", None)], "id int, p1 string, p2 string")
    got = {r["id"]: r["cluster"] for r in C.dynamic_clusters(df, "id", ["p1", "p2"], 5).collect()}
    assert got == {**{i: "1-1" for i in range(6)}, 6: "1", 7: "1", 9: "2"}


def test_topic_mix(spark):
    df = spark.createDataFrame([(1, "Sports", "Sports", "Gaming"), (2, None, None, None)], "id int, a string, b string, c string")
    assert [r["topic_mix"] for r in C.topic_mix(df, "id", ["a", "b", "c"]).orderBy("id").collect()] == ["Sports | Gaming", ""]


def test_seed_lists(spark):
    rows = [("k", "a", True, True), ("k", "b", True, True), ("k", "c", True, False), ("solo", "d", True, True), ("none", "e", False, True)]
    df = spark.createDataFrame(rows, "cluster string, id string, is_seed boolean, can_recommend boolean")
    assert {r["seed"]: r["ids"] for r in clusters.seed_recommendations(df).collect()} == {"a": ["b"], "b": ["a"], "c": ["a", "b"]}
    assert {r["cluster"]: r["is_orphan"] for r in clusters.cluster_summary(df).collect()} == {"k": False, "solo": True, "none": True}


def test_seed_objects_hold_every_list_at_any_size(spark):
    rows = [("big", f"m{k:03d}", k % 3 == 0, k % 2 == 0) for k in range(301)] + [("k", "a", True, True), ("k", "b", True, True), ("k", "c", True, False), ("solo", "d", True, True)]
    rows += [("mute", "e", True, None), ("one", "f", True, True), ("one", "g\"\\", True, False), ("seedless", "h", False, True), ("seedless", "i", None, True), ("big", "m000", True, True)]
    df = spark.createDataFrame(rows, "cluster string, id string, is_seed boolean, can_recommend boolean")
    want = {(r["cluster"], r["seed"]): r["ids"] for r in clusters.seed_recommendations(df).collect()}
    assert ("one", "f") not in want and want[("one", "g\"\\")] == ["f"] and len([k for k in want if k[0] == "big"]) == 101
    for most, parts in ((clusters.OBJECT_IDS, 1), (151 * 20, 6), (151, 101), (1, 101)):
        objects = sorted((r["cluster"], r["part"], r["json"]) for r in clusters.seed_objects(df, most).collect())
        read = [(c, seed, ids) for c, _, text in objects for seed, ids in json.loads(text).items()]
        assert {(c, seed): ids for c, seed, ids in read} == want and len(read) == len(want) and read == sorted(read)
        assert [p for c, p, _ in objects if c == "big"] == list(range(parts))
        assert all(len(x) == 1 or sum(map(len, x.values())) <= most for x in (json.loads(text) for *_, text in objects))


def test_seed_json_never_gathers_the_lists_of_a_cluster(spark, sf):
    plan = registry.queries()["Q25_seed_json"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("RepartitionByExpression")]  # what works on lists of seeds
    assert "collect_" not in top and "Join" not in top and "StructsToJson" in top and "from_json" in top


def test_agreement_of_equal_and_of_single_clusters(spark):
    same = metrics.cluster_agreement(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "t string, f int"), "t", "f").first()
    assert same["v_measure"] == pytest.approx(1) and same["adjusted_rand"] == pytest.approx(1)
    single = metrics.cluster_agreement(spark.createDataFrame([("a", 1), ("b", 1)], "t string, f int"), "t", "f").first()
    assert single["homogeneity"] == pytest.approx(0) and single["completeness"] == 1


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(7, 7), (5, 6), (6, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a int, b int")
    got = {r["node"]: r["root"] for r in graph.connected_components(df).collect()}
    parent = {k: k for e in edges for k in e}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {k: find(k) for k in parent}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_alignment_recovers_a_rotation(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 6))
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    b = frame(spark, x @ q).withColumnRenamed("v", "o").where("id < 40")
    got = alignment.procrustes(frame(spark, x), b, "id", "v", "o").orderBy("id").toPandas()
    assert np.allclose(np.stack(got["aligned"]), x @ q, atol=1e-8)


def test_bm25_weights(spark):
    df = spark.createDataFrame([("a", "x", 24), ("a", "y", 0), ("b", "y", 24)], "community string, gram string, n long")
    got = {(r["community"], r["gram"]): r for r in keywords.tfidf_bm25(df).collect()}
    row = got[("a", "x")]
    assert row["idf"] == pytest.approx(np.log(2)) and row["bm25"] == pytest.approx(0.5 * np.log(1 + 1.5 / 1.5))


def test_encoder_batches(spark):
    def picky(texts):
        if len(texts) > 1 or len(texts[0]) > 4:
            raise MemoryError
        return np.ones((len(texts), 2))

    df = spark.createDataFrame([(1, "abcdefgh"), (2, None), (3, "ab")], "id int, t string")
    got = {r["id"]: r["vector"] for r in V.batches_of(df, picky, "t", "id", 2).collect()}
    assert got == {1: [1.0, 1.0], 2: None, 3: [1.0, 1.0]}


def test_classifier_grid_covers_every_kind(spark, sf):
    got = registry.queries()["V23_classifier_grid"](spark, sf).toPandas()
    assert got.groupby("kind")["n"].sum().to_dict() == dict.fromkeys(("logistic", "forest", "boosted"), table(spark, sf, "embeddings").count())
