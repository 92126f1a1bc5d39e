"""Grouping records into similarity clusters (problem 2).

A Gaussian mixture is fitted by expectation-maximisation on standardised, reduced features: principal components of
the standardised vectors, diagonal covariances pulled towards the pooled one. Several numbers of components are fitted
side by side until EM settles, and the Bayesian information criterion chooses; the range is widened until its minimum lies inside. The
start comes from a bounded sample; EM then runs over all rows and sends only sums per component to the driver.

For clusters by a similarity threshold, an exact check follows: rows go to their `PROBES` most responsible components,
and inside each component links at or above the threshold are found by blocks. A component too large for one task is
split, and its largest cluster is found first, so that a hot cluster is not compared with itself pair by pair.
The mixture only says which rows are compared: the clusters that come out and are described are those of the check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.operators.graph import connected_components
from forumlens.operators.vectors import cosine, mean_vector
from forumlens.session import cut_lineage

from .neighbours import spherical_means
from .ranking import top_n_per_group
from .vectors import bounded_sample, no_rows, unpack

#: Rows of the sample that gives the start, at least, and per square root of all rows; features kept; pull towards the pooled covariance.
SAMPLE, SAMPLE_ROOTS, FEATURES, SHRINK = 16_384, 8, 32, 0.2
#: Gain of the log-likelihood under which EM has settled, a guard against steps without end, and the numbers of components tried
#: first, in square roots of the rows.
GAIN, MAX_STEPS, FIRST_TRIED = 1e-3, 200, (0.25, 0.5, 1.0)
#: Components a row is looked up in; rows that one task compares with each other.
PROBES, TASK_ROWS = 6, 8192
#: Local clusters that speak for a component that is larger than a task.
SPEAKERS = 20
_DIAGONAL_FLOOR = 1e-3


class Mixture:
    """Weights, means and diagonal variances, with the projection in front of them."""

    def __init__(self, centre, scale, axes, weights, means, variances):
        self.centre, self.scale, self.axes = centre, scale, axes
        self.weights, self.means, self.variances = weights, means, variances

    def features(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.axes

    def log_joint(self, f: np.ndarray) -> np.ndarray:
        """log(weight * density) per row and component."""
        inv = 1 / self.variances
        quad = (f**2) @ inv.T - 2 * f @ (self.means * inv).T + (self.means**2 * inv).sum(1)
        return np.log(self.weights) - 0.5 * (quad + np.log(self.variances).sum(1) + f.shape[1] * np.log(2 * np.pi))

    def parameters(self) -> int:
        k, d = self.means.shape
        return k * 2 * d + k - 1

    def stats(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        j = self.log_joint(f)
        top = j.max(1, keepdims=True)
        r = np.exp(j - top)
        total = r.sum(1, keepdims=True)
        r /= total
        return r.sum(0), r.T @ f, r.T @ f**2, float((top + np.log(total)).sum())

    def updated(self, mass: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
        m = np.maximum(mass, 1e-9)[:, None]
        means = np.where(m > 1e-6, first / m, self.means)
        own = np.maximum(second / m - means**2, 0)
        pooled = np.maximum(second.sum(0) / mass.sum() - (mass[:, None] * means**2).sum(0) / mass.sum(), _DIAGONAL_FLOOR)
        variances = np.maximum((1 - SHRINK) * own + SHRINK * pooled, _DIAGONAL_FLOOR)
        return Mixture(self.centre, self.scale, self.axes, np.maximum(mass, 1e-3) / np.maximum(mass, 1e-3).sum(), means, variances)


def start(x: np.ndarray, k: int, features: int) -> Mixture:
    """A mixture from a sample: its standardisation and principal axes, centroids as means, pooled variances."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    _, _, vt = np.linalg.svd(z.T @ z)
    axes = vt[: min(features, x.shape[1])].T
    f = z @ axes
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    at = (x @ spherical_means((x / np.maximum(norm, 1e-12)).astype(np.float32), k).T).argmax(1)
    mass = np.bincount(at, minlength=k).astype(float)
    first, second = np.zeros((k, f.shape[1])), np.zeros((k, f.shape[1]))
    np.add.at(first, at, f)
    np.add.at(second, at, f**2)
    blank = Mixture(centre, scale, axes, np.full(k, 1 / k), np.zeros_like(first), np.ones_like(first))
    return blank.updated(mass, first, second)


def _settled(before: float, now: float) -> bool:
    return now - before <= GAIN * abs(before)


def _passes(vectors: DataFrame, models: dict[int, Mixture], total: int, dims: int) -> dict[int, tuple[Mixture, float]]:
    """EM steps over all rows, several mixtures side by side, each until a step gains less than `GAIN` of its log-likelihood.

    Returns each mixture with its information criterion, measured on the parameters that are returned.
    """
    spark, done, last = vectors.sparkSession, {}, {}
    for step in range(MAX_STEPS):
        shared = spark.sparkContext.broadcast(models)
        rows_at_once = _rows_at_once(max(models))

        def sums(batches: Iterator[pd.DataFrame], shared=shared, rows_at_once=rows_at_once) -> Iterator[pd.DataFrame]:
            totals: dict[int, list] = {}
            for b in batches:
                for lo in range(0, len(b), rows_at_once):
                    x = unpack(b["v"].iloc[lo : lo + rows_at_once], dims).astype(np.float64)
                    for k, m in shared.value.items():
                        new = m.stats(m.features(x))
                        totals[k] = [p + q for p, q in zip(totals[k], new)] if k in totals else list(new)
            for k, (mass, first, second, loglik) in totals.items():
                yield pd.DataFrame({"model": k, "component": np.arange(len(mass)), "mass": mass, "first": list(first), "second": list(second), "loglik": [loglik] + [0.0] * (len(mass) - 1)})

        schema = "model int, component int, mass double, first array<double>, second array<double>, loglik double"
        partial = vectors.select("v").mapInPandas(sums, schema)
        # Per task one row for each component; added up over tasks in the cluster.
        width = next(iter(models.values())).axes.shape[1]
        add = [F.sum(F.col(c)[j]).alias(f"{c}_{j}") for c in ("first", "second") for j in range(width)]
        got = partial.groupBy("model", "component").agg(F.sum("mass").alias("mass"), F.sum("loglik").alias("loglik"), *add).toPandas()
        shared.unpersist()
        going = {}
        for k, m in models.items():
            g = got[got["model"] == k].sort_values("component")
            loglik = float(g["loglik"].sum())
            if k in last and _settled(last[k], loglik) or step == MAX_STEPS - 1:
                done[k] = (m, -2 * loglik + m.parameters() * np.log(max(total, 2)))
            else:
                last[k] = loglik
                first, second = (g[[f"{c}_{j}" for j in range(width)]].to_numpy() for c in ("first", "second"))
                going[k] = m.updated(g["mass"].to_numpy(), first, second)
        models = going
        if not models:
            break
    return done


def _on_sample(x: np.ndarray, k: int) -> Mixture:
    """A start that has settled on the sample."""
    m, before = start(x, k, FEATURES), None
    f = m.features(x)
    for _ in range(MAX_STEPS):
        parts = [m.stats(f[lo : lo + _rows_at_once(k)]) for lo in range(0, len(f), _rows_at_once(k))]
        mass, first, second, loglik = (sum(c) for c in zip(*parts))
        if before is not None and _settled(before, loglik):
            break
        before = loglik
        m = m.updated(mass, first, second)
    return m


def fit_mixture(vectors: DataFrame, total: int, dims: int = 128, candidates: tuple[int, ...] | None = None) -> Mixture:
    """The mixture over all `vectors` whose number of components has the least information criterion.

    Without `candidates`, numbers in proportion to the square root of the rows are tried first; while the least one is
    at an end of those tried, the next half or double joins them, so the number chosen lies inside the range.
    """
    root = np.sqrt(total)
    sample = unpack(bounded_sample(vectors.select("id", "v"), max(SAMPLE, int(SAMPLE_ROOTS * root)), total)["v"], dims).astype(np.float64)
    limit = max(1, len(sample) // 2)
    wave = {max(1, min(int(k), limit)) for k in candidates or (root * x for x in FIRST_TRIED)}
    tried: dict[int, tuple[Mixture, float]] = {}
    while wave:
        tried |= _passes(vectors, {k: _on_sample(sample, k) for k in sorted(wave)}, total, dims)
        ks = sorted(tried)
        best = min(ks, key=lambda k: tried[k][1])
        wave = set()
        if not candidates and best == ks[-1] and best < limit:
            wave = {min(limit, 2 * best)}
        elif not candidates and best == ks[0] and best > 1:
            wave = {best // 2}
    return tried[best][0]


def _rows_at_once(components: int) -> int:
    """Rows whose table of densities is about 32 MB."""
    return int(max(64, min(4096, 4_000_000 // max(1, components))))


def memberships(vectors: DataFrame, model: Mixture, probes: int, dims: int = 128) -> DataFrame:
    """`id`, `v`, `component`, `nth` (0 is the most responsible), `responsibility`, `density` (log, over all components)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        size = _rows_at_once(len(m.weights))
        for b in (whole.iloc[lo : lo + size] for whole in batches for lo in range(0, len(whole), size)):
            j = m.log_joint(m.features(unpack(b["v"], dims).astype(np.float64)))
            top = j.max(1, keepdims=True)
            density = top[:, 0] + np.log(np.exp(j - top).sum(1))
            order = np.argsort(-j, axis=1, kind="stable")[:, :probes]
            for nth in range(order.shape[1]):
                at = order[:, nth]
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "component": at, "nth": nth, "responsibility": np.exp(j[np.arange(len(b)), at] - density), "density": density})

    return vectors.select("id", "v").mapInPandas(run, "id string, v binary, component int, nth int, responsibility double, density double")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component number of n nodes under links (i, j), by repeated minimum."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _joined(root: np.ndarray, near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """`root` after linking rows[i] with columns[j] wherever near[i, j].

    Few links are folded as pairs. Where there are many (a hot cluster), every row takes the least root among its
    partners and itself and hands it to them, until nothing changes: no list of pairs is made.
    """
    n = len(root)
    if near.sum() < 32 * len(near):
        i, j = np.nonzero(near)
        return _roots(n, np.concatenate([rows[i], np.arange(n)]), np.concatenate([columns[j], root])).astype(np.int32)
    while True:
        own = np.where(near.any(1), root[rows], n)
        least = np.minimum(np.where(near, root[columns][None, :], n).min(1), own)
        low = root.copy()
        np.minimum.at(low, columns, np.where(near, least[:, None], n).min(0).astype(np.int32))
        np.minimum.at(low, rows, least.astype(np.int32))
        if (low == root).all():
            return root
        new = low.copy()
        np.minimum.at(new, root, low)
        while (new[new] != new).any():
            new = new[new]
        root = new


def _local_components(x: np.ndarray, threshold: float) -> np.ndarray:
    """Components among the rows of one task, by blocks of 256 rows."""
    every, root = np.arange(len(x)), np.arange(len(x), dtype=np.int32)
    for lo in range(0, len(x), 256):
        root = _joined(root, x[lo : lo + 256] @ x.T >= threshold, every[lo : lo + 256], every)
    return root


def _links_to_root(ids: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    moved = np.nonzero(root != np.arange(len(root)))[0]
    return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def threshold_clusters(vectors: DataFrame, threshold: float = 0.70, dims: int = 128, task_rows: int = TASK_ROWS, model: Mixture | None = None) -> DataFrame:
    """`node`, `root`: every vector that has a partner at or above `threshold`, with its cluster's smallest id.

    Vectors belong together when a chain of partners connects them. Two partners are compared when they share one of
    their `PROBES` components; the tests measure the recall of that against brute force. An empty table, or vectors
    without partners, give no rows.
    """
    vectors = cut_lineage(vectors.select("id", "v"))
    total = vectors.count()
    if total < 2:
        return vectors.select(F.col("id").alias("node"), F.col("id").alias("root")).limit(0)
    model = model or fit_mixture(vectors, total, dims)
    placed = cut_lineage(memberships(vectors, model, PROBES, dims).select("id", "v", "component"))
    sizes = {r["component"]: r["n"] for r in placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {c: -(-n // task_rows) for c, n in sizes.items() if n > task_rows}
    parts = vectors.sparkSession.createDataFrame([(int(c), large.get(c, 1)) for c in sizes], "component int, parts int")
    split = placed.join(F.broadcast(parts), "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def local(_key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", ignore_index=True)
        ids = b["id"].to_numpy()
        return _links_to_root(ids, _local_components(unpack(b["v"], dims), threshold))

    links = split.where("parts = 1").groupBy("component", "part").applyInPandas(local, "a string, b string")
    if large:
        links = links.unionByName(_large_components(split.where("parts > 1"), threshold, dims, task_rows))
    return connected_components(links)


def _large_components(split: DataFrame, threshold: float, dims: int, task_rows: int) -> DataFrame:
    """Links inside components that are larger than a task, without comparing a hot cluster with itself.

    Every part finds its local clusters. Of those that hold a twentieth of their part, the `SPEAKERS` heaviest of a component
    speak for it: the cluster that they form is the component's hot one, and local clusters whose first member is near a
    speaker join it. Hot rows need no comparison with each other any more. All other rows of the component are compared with all
    its rows, block by block: that part is square in the rows of one component that are not hot.
    """

    def local(_key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", ignore_index=True)
        root = _local_components(unpack(b["v"], dims), threshold)
        size = np.bincount(root, minlength=len(b))
        first = root == np.arange(len(b))
        return pd.DataFrame({"component": b["component"], "part": b["part"], "id": b["id"], "v": b["v"], "root": b["id"].to_numpy()[root], "size": np.where(first, size, 0), "is_large": first & (size * 20 >= len(b))})

    schema = "component int, part int, id string, v binary, root string, size long, is_large boolean"
    rows = cut_lineage(split.groupBy("component", "part").applyInPandas(local, schema))

    # The first members of a component's heaviest local clusters speak for it: a fixed number of rows, however many parts.
    heads = rows.where("is_large").select("component", "part", "id", "v", "size")
    speakers = top_n_per_group(heads, ["component"], [F.desc("size")], SPEAKERS, ["id"], "nth").drop("nth")

    def together(_key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", ignore_index=True)
        root = _local_components(unpack(b["v"], dims), threshold)
        weight = np.bincount(root, weights=b["size"], minlength=len(b))
        return pd.DataFrame({"component": b["component"], "id": b["id"], "v": b["v"], "merged": b["id"].to_numpy()[root], "is_hot": root == weight.argmax()})

    spoken = cut_lineage(speakers.groupBy("component").applyInPandas(together, "component int, id string, v binary, merged string, is_hot boolean"))
    n_parts = rows.groupBy("component").agg((F.max("part") + 1).alias("parts"))
    offered = spoken.join(n_parts, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", "merged", "is_hot")

    def joined(_key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return no_rows("component", "part", "root", "merged", "is_hot")
        i, j = np.nonzero(unpack(mine["v"], dims) @ unpack(theirs["v"], dims).T >= threshold)
        out = pd.DataFrame({"component": mine["component"].to_numpy()[i], "part": mine["part"].to_numpy()[i], "root": mine["id"].to_numpy()[i], "merged": theirs["merged"].to_numpy()[j], "is_hot": theirs["is_hot"].to_numpy()[j]})
        return out.drop_duplicates()

    keys = ["component", "part"]
    merged = cut_lineage(heads.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(joined, "component int, part int, root string, merged string, is_hot boolean"))
    flagged = rows.join(merged.where("is_hot").select("component", "part", "root", "is_hot").distinct(), ["component", "part", "root"], "left")
    flagged = cut_lineage(flagged.select("component", "part", "id", "v", F.coalesce("is_hot", F.lit(False)).alias("is_hot")))
    counts = flagged.groupBy("component").agg(F.count(F.when(~F.col("is_hot"), 1)).alias("others"), (F.max("part") + 1).alias("parts")).collect()
    table = split.sparkSession.createDataFrame([(int(r["component"]), max(1, -(-r["others"] // task_rows)), int(r["parts"])) for r in counts], "component int, chunks int, parts int")
    sized = flagged.join(F.broadcast(table), "component")
    everyone = sized.select("component", "part", "id", "v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("in_part")
    others = sized.where("not is_hot").select(
        F.col("component").alias("in_component"), spread, F.col("id").alias("few_id"), F.col("v").alias("few_v"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int").alias("in_chunk")
    )

    def across(_key: tuple, few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if not len(few) or not len(many):
            return no_rows("a", "b")
        ids, number = np.unique(np.concatenate([few["few_id"].to_numpy(), many["id"].to_numpy()]), return_inverse=True)
        left, right = number[: len(few)], number[len(few) :]
        x, y, root = unpack(few["few_v"], dims), unpack(many["v"], dims), np.arange(len(ids), dtype=np.int32)
        for lo in range(0, len(x), 256):
            root = _joined(root, x[lo : lo + 256] @ y.T >= threshold, left[lo : lo + 256], right)
        return _links_to_root(ids, root)

    crossed = others.groupBy("in_component", "in_part", "in_chunk").cogroup(everyone.groupBy("component", "part", "chunk")).applyInPandas(across, "a string, b string")
    own = rows.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    return own.unionByName(merged.where("root <> merged").select(F.col("root").alias("a"), F.col("merged").alias("b"))).unionByName(crossed)


def cluster_rows(vectors: DataFrame) -> DataFrame:
    """`cluster_key`, `subreddit_id`: the members of every cluster of two or more."""
    return threshold_clusters(vectors).select(F.col("root").alias("cluster_key"), F.col("node").alias("subreddit_id"))


def describe_components(vectors: DataFrame, topics: DataFrame, typical: int = 3, dims: int = 128) -> DataFrame:
    """One row per cluster of `threshold_clusters`: label, size, majority topic and the `typical` members nearest its mean.

    The label is the cluster's smallest id, the key of `cluster_rows`. A vector without partners is a cluster of one, so
    the sizes add up to the vectors. `topics` has `id`, `topic`; ids without a topic do not vote, and a cluster without
    votes has a null topic.
    """
    vectors = cut_lineage(vectors)
    roots = threshold_clusters(vectors, dims=dims).select(F.col("node").alias("id"), "root")
    home = cut_lineage(vectors.join(roots, "id", "left").select("id", "name", "v", F.coalesce("root", "id").alias("cluster_label")))

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "name": b["name"], "cluster_label": b["cluster_label"], "x": list(unpack(b["v"], dims).astype(np.float64))})

    rows = home.mapInPandas(unpacked, "id string, name string, cluster_label string, x array<double>")
    means = mean_vector(rows, ["cluster_label"], "x", name="mean")
    near = rows.join(means, "cluster_label").select("id", "name", "cluster_label", F.round(cosine(F.col("x"), F.col("mean")), 9).alias("near"))
    best = top_n_per_group(near, ["cluster_label"], [F.desc("near")], typical, ["id"], "nth")
    names = best.groupBy("cluster_label").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda s: s["name"])).alias("typical_members"))
    votes = home.join(topics, "id").where("topic is not null").groupBy("cluster_label", "topic").agg(F.count(F.lit(1)).alias("n"))
    major = votes.groupBy("cluster_label").agg(F.max_by("topic", F.struct(F.col("n"), F.col("topic"))).alias("majority_topic"))
    sizes = home.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(names, "cluster_label").join(major, "cluster_label", "left").select("cluster_label", "size", "majority_topic", "typical_members")


def describe_mixture(vectors: DataFrame, topics: DataFrame, typical: int = 3, dims: int = 128) -> DataFrame:
    """One row per component of the mixture: `cluster_label`, `cluster_label_k`, `size`, `cluster_majority_primary_topic`, `typical_members`.

    Every vector belongs to its most responsible component; `cluster_label_k` is their chosen number. The typical members are those
    of the highest density, equals by id. Components that are nobody's first choice give no row, nor does an empty table. A
    component without a topic among its members has a null topic.
    """
    vectors = cut_lineage(vectors)
    total = vectors.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "cluster_label int, cluster_label_k int, size long, cluster_majority_primary_topic string, typical_members string")
    model = fit_mixture(vectors, total, dims)
    home = cut_lineage(memberships(vectors, model, 1, dims).select("id", F.col("component").alias("cluster_label"), F.round("density", 6).alias("density")).join(vectors.select("id", "name"), "id"))
    best = top_n_per_group(home, ["cluster_label"], [F.desc("density")], typical, ["id"], "nth")
    names = best.groupBy("cluster_label").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda s: s["name"])).alias("typical_members"))
    votes = home.join(topics, "id").where("topic is not null").groupBy("cluster_label", "topic").agg(F.count(F.lit(1)).alias("n"))
    major = votes.groupBy("cluster_label").agg(F.max_by("topic", F.struct(F.col("n"), F.col("topic"))).alias("cluster_majority_primary_topic"))
    sizes = home.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(names, "cluster_label").join(major, "cluster_label", "left").select("cluster_label", F.lit(len(model.weights)).alias("cluster_label_k"), "size", "cluster_majority_primary_topic", "typical_members")
