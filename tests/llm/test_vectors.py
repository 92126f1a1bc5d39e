import numpy as np
import pytest

from forumlens.llm import mixture, neighbours, queries, vectors

SCHEMA = "pt string, model_version string, subreddit_id string, subreddit_name string, is_seed boolean, embeddings array<float>, v string, id string"


def rows_of(x, seeds=None, pt="1"):
    return [(pt, "m", f"t{k:05d}", f"n{k}", bool(seeds is None or seeds[k]), [float(f) for f in v], "clash", "clash") for k, v in enumerate(x)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 128))
    hot = centres[0] + 0.25 * rng.standard_normal((140, 128))
    others = np.concatenate([c + 0.3 * rng.standard_normal((k, 128)) for c, k in zip(centres[1:], (3, 9, 17, 2, 30))])
    alone = rng.standard_normal((160, 128))
    x = np.concatenate([hot, others, alone])
    x = x * rng.uniform(0.1, 9, (len(x), 1))
    return x[rng.permutation(len(x))]


def test_usable_vectors(spark):
    good = np.ones(128)
    bad = [good[:64], np.zeros(128), np.where(np.arange(128) == 3, np.nan, 1.0), np.where(np.arange(128) == 3, np.inf, 1.0)]
    rows = rows_of(bad) + rows_of([good * 5], pt="2") + rows_of([good], pt="2") + [("9", "m", None, "x", True, [1.0] * 128, "", ""), ("9", "m", "z", "x", None, None, "", "")]
    got = vectors.usable_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["id"], r["is_seed"]) for r in got] == [("t00000", True)]
    assert np.allclose(np.frombuffer(got[0]["v"], np.float32), 1 / np.sqrt(128))
    assert vectors.usable_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("task_rows", [4096, 32])
def test_threshold_clusters_equal_brute_force(spark, cloud, task_rows):
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(cloud), SCHEMA))
    x = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    i, j = np.nonzero(s >= 0.7)
    root = mixture._roots(len(x), i, j)
    want = {(f"t{k:05d}", f"t{root[k]:05d}") for k in np.unique(i)}
    got = {(r["node"], r["root"]) for r in mixture.threshold_clusters(df, task_rows=task_rows).collect()}
    assert got == want


def test_clusters_of_nothing(spark):
    empty = vectors.usable_vectors(spark.createDataFrame([], SCHEMA))
    assert mixture.threshold_clusters(empty).count() == 0
    one = vectors.usable_vectors(spark.createDataFrame(rows_of(np.ones((1, 128))), SCHEMA))
    assert mixture.threshold_clusters(one).count() == 0
    two = vectors.usable_vectors(spark.createDataFrame(rows_of(np.ones((2, 128))), SCHEMA))
    assert {(r["node"], r["root"]) for r in mixture.threshold_clusters(two).collect()} == {("t00000", "t00000"), ("t00001", "t00000")}


def test_em_does_not_lower_the_likelihood(cloud):
    m = mixture.start(cloud, 5, 16)
    f = m.features(cloud)
    logs = []
    for _ in range(6):
        mass, first, second, loglik = m.stats(f)
        assert abs(mass.sum() - len(cloud)) < 1e-6
        logs.append(loglik)
        m = m.updated(mass, first, second)
    assert logs[-1] >= logs[0]


def test_the_fit_that_ships_has_settled_inside_its_range(spark, cloud, monkeypatch):
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(cloud), SCHEMA)).cache()
    tried = {}
    passes = mixture._passes
    monkeypatch.setattr(mixture, "_passes", lambda v, models, *rest: tried.update(got := passes(v, models, *rest)) or got)
    model = mixture.fit_mixture(df, len(cloud))
    k = len(model.weights)
    assert k == min(tried, key=lambda n: tried[n][1]) and (k == 1 or k > min(tried)) and k < max(tried)
    x = vectors.unpack(df.toPandas()["v"]).astype(float)
    f = model.features(x)
    mass, first, second, now = model.stats(f)
    further = model.updated(mass, first, second).stats(f)[3]
    assert further - now <= 1e-3 * abs(now)


def test_mixture_components_are_described_by_density(spark, cloud):
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(cloud), SCHEMA))
    topics = df.selectExpr("id", "if(id < 't00200', 'pets', null) topic")
    got = mixture.describe_mixture(df, topics).collect()
    assert sum(r["size"] for r in got) == len(cloud) and len({r["cluster_label_k"] for r in got}) == 1 and len(got) <= got[0]["cluster_label_k"]
    assert all(len(r["typical_members"].split(" | ")) == min(3, r["size"]) for r in got)
    assert mixture.describe_mixture(df.limit(0), topics).count() == 0


def test_components_are_described(spark, cloud):
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(cloud), SCHEMA))
    topics = df.selectExpr("id", "if(id < 't00200', 'pets', null) topic")
    got = mixture.describe_components(df, topics).collect()
    assert sum(r["size"] for r in got) == len(cloud) and all(r["typical_members"] for r in got)


def test_every_cluster_is_described_on_its_own(spark, cloud):
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(cloud), SCHEMA))
    x = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    root = mixture._roots(len(x), *np.nonzero(x @ x.T >= 0.7))
    topics = df.selectExpr("id", "if(id < 't00200', 'pets', null) topic")
    got = {r["cluster_label"]: r for r in mixture.describe_components(df, topics).collect()}
    assert {k: r["size"] for k, r in got.items()} == {f"t{k:05d}": n for k, n in enumerate(np.bincount(root)) if n}
    for k, r in got.items():
        mine = np.nonzero(root == int(k[1:]))[0]
        near = np.round(x[mine] @ x[mine].mean(0), 4)
        named = [int(n[1:]) for n in r["typical_members"].split(" | ")]
        assert len(named) == min(3, len(mine)) and set(named) <= set(mine) and near[list(mine).index(named[0])] == near.max()
        assert r["majority_topic"] == ("pets" if mine.min() < 200 else None)


@pytest.mark.parametrize("block_rows", [None, 40])
def test_neighbours_reach_the_recall(spark, cloud, block_rows):
    seeds = np.arange(len(cloud)) % 4 == 0
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(cloud, seeds), SCHEMA))
    x = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(f"t{q:05d}", f"t{k:05d}") for q in np.nonzero(seeds)[0] for k in np.argsort(-s[q], kind="stable")[:5]}
    found = neighbours.nearest(df, 5, block_rows=block_rows).collect()
    got = {(r["q"], r["id"]) for r in found}
    assert len(found) == len(want) and len(got & want) >= 0.98 * len(want)
    assert all(abs(r["cosine"] - s[int(r["q"][1:]), int(r["id"][1:])]) < 1e-5 for r in found)


def test_pairs_cover_every_usable_vector(spark, sf):
    rows = vectors.usable_vectors(queries.table(spark, sf, "embeddings_community")).toPandas()
    x = vectors.unpack(rows["v"]).astype(float)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = queries.p5_pairs(spark, sf).toPandas()
    assert set(got["subreddit_id"]) == set(rows["id"]) and not rows["is_seed"].all()
    assert (got.groupby("subreddit_id")["distance_rank"].apply(sorted).map(tuple) == (1, 2, 3, 4, 5)).all()
    at = {k: n for n, k in enumerate(rows["id"])}
    want = {(rows["id"][q], rows["id"][k]) for q in range(len(x)) for k in np.argsort(-s[q], kind="stable")[:5]}
    assert len(set(zip(got["subreddit_id"], got["similar_subreddit_id"])) & want) >= 0.98 * len(want)
    assert all(abs(r.cosine_similarity - s[at[r.subreddit_id], at[r.similar_subreddit_id]]) < 1e-5 for r in got.itertuples())


def test_equal_vectors_and_tiny_tables(spark):
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(np.ones((4, 128))), SCHEMA))
    got = {(r["q"], r["id"], r["rank"]) for r in neighbours.nearest(df, 2).collect()}
    assert ("t00000", "t00001", 1) in got and ("t00003", "t00001", 2) in got and len(got) == 8
    for n in (0, 1):
        df = vectors.usable_vectors(spark.createDataFrame(rows_of(np.ones((n, 128))), SCHEMA))
        assert neighbours.nearest(df, 5).count() == 0


def test_many_equal_vectors_over_several_blocks_take_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    other = rng.standard_normal((90, 128))
    x = np.concatenate([np.ones((60, 128)), other])
    order = rng.permutation(len(x))
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(x[order]), SCHEMA))
    got = neighbours.nearest(df, 2, block_rows=15).toPandas()
    equal = sorted(f"t{k:05d}" for k in np.nonzero(order < 60)[0])
    assert len(got) == 2 * len(x)
    for q in equal:
        mine = got[got["q"] == q].sort_values("rank")
        assert list(mine["id"]) == [i for i in equal if i != q][:2] and (mine["cosine"] == 1).all()


def test_nearly_equal_vectors_rank_by_id_in_every_list(spark):
    rows = np.repeat(neighbours.rotation(128)[:1], 40, axis=0)
    q, r, s = neighbours.scan(rows[:5], np.full(5, 1.0), rows, 3)
    assert sorted(zip(q.tolist(), r.tolist())) == [(a, b) for a in range(5) for b in range(3)] and (s == 1).all()


def test_few_lists_are_visited_where_neighbours_are_near(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((200, 128)), 12, axis=0) + 0.2 * rng.standard_normal((2400, 128))
    df = vectors.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    seen = neighbours.probe_report(df, 5).toPandas()
    assert len(seen) == 2400 and seen["lists"].mean() <= 0.35 * seen["of_lists"].iloc[0] and seen["rows_compared"].mean() < 900


def test_scan_agrees_with_a_full_scan():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((50, 128))
    rows = np.repeat(base, 40, axis=0) + 0.2 * rng.standard_normal((2000, 128))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows = (rows.astype(np.float32)) @ neighbours.rotation(128)
    queries = rows[:200]
    s = queries @ rows.T
    beat = np.sort(s, axis=1)[:, -12] - 1e-6
    qi, ri, _ = neighbours.scan(queries, beat, rows, 10)
    want = {(q, k) for q in range(200) for k in np.argsort(-s[q])[:10]}
    assert len(want & set(zip(qi.tolist(), ri.tolist()))) >= 0.98 * len(want)
