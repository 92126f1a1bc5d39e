"""Hierarchical clusters: Ward trees, cuts, order, the best number, and roll-ups along nested labels.

The tree is built on the driver from a bounded number of points (`MAX_POINTS`); beyond that, rows are first reduced to
as many centres by k-means in the cluster and the tree is built over the centres, weighted by their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import cut_lineage

#: Points that a tree is built from on the driver: its matrix of distances is square in them.
MAX_POINTS = 5000


def second_difference(value: Column, window) -> Column:
    """value - 2 * previous + the one before; null for the first two rows."""
    return value - 2 * F.lag(value).over(window) + F.lag(value, 2).over(window)


def ward_tree(x: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """n-1 merges as (first, second, distance, count), ascending: points are 0..n-1, the m-th merge is n+m.

    Nearest-neighbour chains over Ward's distance, which never shrinks along a chain; equal distances take the lower
    number. `sizes` weigh the points.
    """
    n = len(x)
    if n < 2:
        return np.zeros((0, 4))
    size = np.ones(n) if sizes is None else np.asarray(sizes, dtype=float).copy()
    centre = np.asarray(x, dtype=float).copy()
    d = np.square(centre).sum(1)[:, None] + np.square(centre).sum(1)[None, :] - 2 * centre @ centre.T
    d = np.maximum(d, 0) * (2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, dtype=bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.nonzero(alive)[0][0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        keep, gone = min(a, b), max(a, b)
        merges.append((a, b, float(np.sqrt(d[a, b])), size[a] + size[b]))
        total = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / np.maximum(total, 1e-12)
        size[keep] = size[a] + size[b]
        alive[gone] = False
        new[~alive] = np.inf
        new[keep] = np.inf
        d[keep], d[:, keep] = new, new
        d[gone], d[:, gone] = np.inf, np.inf
    # Merges of a chain come out of order: sort by distance and number the clusters anew.
    order = np.argsort([m[2] for m in merges], kind="stable")
    root, name, out = np.arange(n), np.arange(n), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at, k in enumerate(order):
        a, b, distance, _ = merges[k]
        ra, rb = find(a), find(b)
        first, second = sorted((int(name[ra]), int(name[rb])))
        root[rb] = ra
        name[ra] = n + at
        out.append((first, second, distance, merges[k][3]))
    return np.array(out)


def cut(tree: np.ndarray, n: int, counts: Sequence[int]) -> dict[int, np.ndarray]:
    """Flat labels (1..k, by leaf order of first appearance) for every k of `counts`, in one sweep over the merges."""
    wanted = {max(1, min(int(k), n)): int(k) for k in counts}
    out: dict[int, np.ndarray] = {}
    root = np.arange(2 * n)
    member = np.arange(n)
    if n in wanted:
        out[wanted[n]] = np.arange(1, n + 1)
    for m, (a, b, *_rest) in enumerate(tree):
        root[int(a)] = root[int(b)] = n + m
        left = n - m - 1
        if left in wanted:
            while True:
                above = root[member]
                if (above == member).all():
                    break
                member = above
            _, first, inverse = np.unique(member, return_index=True, return_inverse=True)
            rank = np.empty(len(first), dtype=int)
            rank[np.argsort(first)] = np.arange(1, len(first) + 1)
            out[wanted[left]] = rank[inverse]
    return out


def leaf_order(tree: np.ndarray, n: int) -> np.ndarray:
    """Position of each point in the dendrogram, first children first, without recursion."""
    position, stack, at = np.zeros(n, dtype=int), [n + len(tree) - 1] if len(tree) else list(range(n)), 0
    while stack:
        k = stack.pop()
        if k < n:
            position[k] = at
            at += 1
        else:
            a, b = int(tree[k - n, 0]), int(tree[k - n, 1])
            stack += [b, a]
    return position


def best_counts(tree: np.ndarray, intervals: Sequence[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
    """(low, high, k, acceleration) per interval of k: where the merge distances accelerate most; first k on ties."""
    distances = tree[:, 2][::-1]
    acceleration = np.diff(distances, 2)  # entry j belongs to k = j + 2
    out = []
    for low, high in intervals:
        ks = [k for k in range(max(2, low), high + 1) if k - 2 < len(acceleration)]
        if ks:
            best = max(ks, key=lambda k: (acceleration[k - 2], -k))
            out.append((low, high, best, float(acceleration[best - 2])))
    return out


def collect_points(df: DataFrame, key: str, vector: str, limit: int = MAX_POINTS):
    """(keys, matrix) of a table that must not exceed `limit` rows; more is an error, not a cut."""
    rows = df.where(F.col(vector).isNotNull()).select(key, vector).limit(limit + 1).toPandas().sort_values(key, ignore_index=True)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} points; reduce them first (see reduce_points)")
    return rows[key].to_numpy(), np.stack(rows[vector].to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))


def reduce_points(df: DataFrame, key: str, vector: str, centres: int, seed: int = 7, normalise: bool = False):
    """(`key`, `centre`) per row, and the centres with their sizes: the first level where rows are too many for a tree."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    if normalise:
        rows = Normalizer(inputCol="features", outputCol="unit").transform(rows).select(key, F.col("unit").alias("features"))
    model = KMeans(k=centres, seed=seed, maxIter=10, predictionCol="centre").fit(rows)
    placed = model.transform(rows).select(key, "centre")
    sizes = dict(placed.groupBy("centre").count().collect())
    return placed, np.array(model.clusterCenters()), np.array([sizes.get(k, 0) or 1 for k in range(len(model.clusterCenters()))])


def tree_leaves(df: DataFrame, key: str, vector: str, limit: int = MAX_POINTS, normalise: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(`key`, `leaf`) of every row with a vector, and the points and sizes of a tree over them.

    Leaves are the rows in order of `key`, or as many centres where they are too many. Rows get unit length before they
    are averaged, so both trees are built in the same space.
    """
    if df.where(F.col(vector).isNotNull()).limit(limit + 1).count() <= limit:
        keys, x = collect_points(df, key, vector, limit)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalise else x
        named = [(k.item() if hasattr(k, "item") else k, i) for i, k in enumerate(keys)]
        return df.sparkSession.createDataFrame(named, f"{key} {df.schema[key].dataType.simpleString()}, leaf int"), x, np.ones(len(x))
    placed, centres, sizes = reduce_points(df, key, vector, limit, normalise=normalise)
    return placed.select(key, F.col("centre").alias("leaf")), centres, sizes


def tree_points(df: DataFrame, key: str, vector: str, limit: int = MAX_POINTS, normalise: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(points, sizes) for a tree over all rows: see `tree_leaves`."""
    return tree_leaves(df, key, vector, limit, normalise)[1:]


def linkage(df: DataFrame, key: str, vector: str, limit: int = MAX_POINTS) -> DataFrame:
    """The tree and what its leaves stand for: rows with `merge`, `first`, `second`, `distance`, `count`, and rows with `key`, `leaf`.

    Leaves are 0..n-1 and the m-th merge makes n+m, so a row with a vector is found in the tree by its `leaf`.
    """
    leaves, x, sizes = tree_leaves(df, key, vector, limit)
    merges = [(k, int(a), int(b), float(d), int(n)) for k, (a, b, d, n) in enumerate(ward_tree(x, sizes).tolist())]
    tree = df.sparkSession.createDataFrame(merges, "merge int, first int, second int, distance double, count int")
    return tree.unionByName(leaves, allowMissingColumns=True)


def labels_long(df: DataFrame, key: str, vector: str, counts: Sequence[int], normalise: bool = True, limit: int = MAX_POINTS) -> DataFrame:
    """`key`, `k`, `label`, `model_sort_order`: Ward labels of every row for each k."""
    leaves, x, sizes = tree_leaves(df, key, vector, limit, normalise)
    tree = ward_tree(x, sizes)
    flat, order = cut(tree, len(x), counts), leaf_order(tree, len(x))
    rows = [(i, int(k), int(lab[i]), int(order[i])) for k, lab in sorted(flat.items()) for i in range(len(x))]
    return leaves.join(F.broadcast(df.sparkSession.createDataFrame(rows, "leaf int, k int, label int, model_sort_order int")), "leaf").drop("leaf")


def nested_label(columns: Sequence[str], width: int = 4) -> Column:
    """Labels of several levels as one zero-padded path, `"0012-0014"`; null levels are left out."""
    return F.concat_ws("-", *(F.lpad(F.col(c).cast("int").cast("string"), width, "0") for c in columns))


def topic_mix(df: DataFrame, key: str, topics: Sequence[str], separator: str = " | ") -> DataFrame:
    """`key`, `topic_mix`: the topics along the path, each once, in order of first appearance; no topics give an empty string."""
    return df.select(key, F.array_join(F.array_distinct(F.array_compact(F.array(*topics))), separator).alias("topic_mix"))


def dynamic_clusters(df: DataFrame, key: str, levels: Sequence[str], n: int) -> DataFrame:
    """`key`, `level`, `cluster`: each row in the deepest cluster of its path with more than `n` members.

    From the deepest level upwards, rows of clusters of at most `n` move to the level above, where the sizes are counted
    again with those that came; at the first level they stay. `levels` are columns of paths, shallow to deep; a null
    path counts as no cluster of that level.
    """
    current = df.select(key, *levels)
    deepest = F.lit(None).cast("int")
    for i in range(len(levels)):
        deepest = F.when(F.col(levels[i]).isNotNull(), i).otherwise(deepest)
    current = current.withColumn("level", deepest).where("level is not null")
    for i in range(len(levels) - 1, 0, -1):
        here = F.col("level") == i
        size = F.sum(F.when(here, 1).otherwise(0)).over(Window.partitionBy(levels[i]))
        current = current.withColumn("level", F.when(here & (size <= n), i - 1).otherwise(F.col("level")))
        if i % 8 == 0:
            current = cut_lineage(current)
    paths = F.array(*levels)
    return current.select(key, "level", F.get(paths, F.col("level")).alias("cluster"))


def orphan_clusters(clusters: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """`cluster`, `seeds`, `members`, `is_orphan`: a cluster with fewer than two members or without a seed is an orphan."""
    marked = clusters.join(seeds.select(key).distinct().withColumn("is_seed", F.lit(1)), key, "left")
    counts = marked.groupBy("cluster").agg(F.sum(F.coalesce("is_seed", F.lit(0))).alias("seeds"), F.count(F.lit(1)).alias("members"))
    return counts.withColumn("is_orphan", (F.col("members") < 2) | (F.col("seeds") == 0))


def best_minimum(df: DataFrame, key: str, levels: Sequence[str], seeds: DataFrame, grid: Sequence[int]) -> DataFrame:
    """`n`, `orphans`, `is_best`: orphans for every minimum of the grid; the first with the fewest is best.

    The paths are read once: every minimum is a lane of its own inside one plan.
    """
    lanes = None
    for n in grid:
        counted = orphan_clusters(dynamic_clusters(df, key, levels, n), seeds, key)
        lane = counted.agg(F.sum(F.col("is_orphan").cast("bigint")).alias("orphans")).select(F.lit(int(n)).alias("n"), F.coalesce("orphans", F.lit(0)).alias("orphans"))
        lanes = lane if lanes is None else lanes.unionByName(lane)
    first = F.row_number().over(Window.orderBy("orphans", "n")) == 1
    return lanes.withColumn("is_best", first)
