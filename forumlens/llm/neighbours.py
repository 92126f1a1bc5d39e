"""Most similar vectors for every vector (problem 5): adaptive dimension scan over probed lists.

Vectors are rotated once by a random orthogonal matrix and cut into column blocks. They are assigned to the nearest of
about sqrt(n) centroids: their list. A query probes lists nearest first, in two rounds. The first round scans its
`FIRST_LISTS` nearest lists and gives the cosine to beat. For every other list the cosines of its members to the query
are then taken as normal, with the mean and spread that follow from the query's and the members' angles to the
centroid; the expected number of members above the cosine to beat is the list's worth. The second round probes the
lists of most worth until all that stay closed are worth no more than `MISSES` neighbours together.

Within a probed list, a candidate is dropped after a column block when its partial distance, scaled up to all
dimensions, exceeds the distance to beat by more than the test allows (`EPSILON`): a random rotation spreads a
difference evenly, so the chance of a wrong drop falls exponentially with the columns seen.

Equal vectors are folded before the search and unfolded after it, so a group of copies costs one vector. Lists are packed
into blocks of bounded size; a list beyond that is split by hash. What is shuffled is a query once for each block that
holds one of its lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import cut_lineage

from .ranking import top_n_per_group
from .vectors import bounded_sample, no_rows, unpack

#: Vectors that the centroids are fitted on (at least four for each list); rows of a block; queries of a block in one task.
SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8192, 32_768
#: Lists of the first round; neighbours that the lists left closed may hold together, by expectation.
FIRST_LISTS, MISSES = 16, 0.15
#: The test's slack, the columns of the blocks, and the part of candidates above which dense columns are cheaper.
EPSILON, COLUMNS, DENSE = 2.5, (32, 32, 64), 0.15
#: Cosines that differ by less are equal, and rank by id; what single precision may be wrong by.
SAME_DIGITS, NOISE = 7, 2e-6
_PAIR = "q string, id string, cosine double"


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def spherical_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors; empty ones restart at the worst served vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        at = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-6
        if empty.any():
            sums[empty] = x[np.argsort(s.max(1))[: empty.sum()]]
            norm = np.linalg.norm(sums, axis=1)
        c = sums / np.maximum(norm, 1e-12)[:, None]
    return c.astype(np.float32)


def scan(queries: np.ndarray, beat: np.ndarray, rows: np.ndarray, k: int, columns=COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, cosine) of at most `k` rows per query whose cosine is not below `beat`.

    Both sides are rotated unit vectors. Equal cosines prefer the earlier row. Queries are taken in order of the distance
    to beat, so that those with many hopeless candidates are together: there survivors are gathered; elsewhere the next
    columns are computed densely.
    """
    dims = rows.shape[1]
    parts = np.split(np.arange(dims), np.cumsum(columns)[:-1])
    order = np.argsort(-beat, kind="stable")
    step = max(16, int(6_000_000 // max(1, len(rows))))
    row_norms = [np.square(rows[:, p]).sum(1) for p in parts]
    out_q, out_r, out_s = [], [], []

    def emit(chunk: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> None:
        if not len(qi):
            return
        s = np.empty(len(qi))
        for a in range(0, len(qi), 100_000):
            s[a : a + 100_000] = np.einsum("ij,ij->i", queries[chunk[qi[a : a + 100_000]]].astype(np.float64), rows[ri[a : a + 100_000]].astype(np.float64))
        s = np.round(s, SAME_DIGITS)
        best = np.lexsort((ri, -s, qi))
        qi, ri, s = qi[best], ri[best], s[best]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
        out_q.append(chunk[qi[keep]])
        out_r.append(ri[keep])
        out_s.append(s[keep])

    for lo in range(0, len(order), step):
        chunk = order[lo : lo + step]
        q, target = queries[chunk], beat[chunk] - NOISE
        worst = 2 - 2 * target  # squared distance to beat
        dots = np.zeros((len(chunk), len(rows)), dtype=np.float32)
        qn, rn, seen = np.zeros(len(chunk), np.float32), np.zeros(len(rows), np.float32), 0
        gathered = False
        for part, norms in zip(parts[:-1], row_norms):
            dots += q[:, part] @ rows[:, part].T
            qn += np.square(q[:, part]).sum(1)
            rn += norms
            seen += len(part)
            limit = worst * (seen / dims) * (1 + epsilon / np.sqrt(seen)) ** 2
            if (limit.min() > 4 * seen / dims) or (limit > 1.6 * 2 * seen / dims).mean() > 0.5:
                continue  # nothing would be dropped
            alive = (qn - limit)[:, None] + rn[None, :] <= 2 * dots
            if alive.mean() <= DENSE:
                qi, ri = np.nonzero(alive)
                s, rest = dots[qi, ri].astype(np.float64), np.arange(seen, dims)
                for a in range(0, len(qi), 200_000):
                    s[a : a + 200_000] += np.einsum("ij,ij->i", q[qi[a : a + 200_000]][:, rest], rows[ri[a : a + 200_000]][:, rest])
                ok = s >= target[qi]
                emit(chunk, qi[ok], ri[ok])
                gathered = True
                break
        if not gathered:
            dots = q @ rows.T
            if len(rows) > k:
                kth = -np.partition(-dots, k - 1, axis=1)[:, k - 1]
                target = np.maximum(target, kth - NOISE)
            qi, ri = np.nonzero(dots >= target[:, None])
            emit(chunk, qi, ri)
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


@dataclass
class Lists:
    """The lists: centroids, sizes, mean and spread of the members' cosines to the centroid, and their blocks."""

    means: np.ndarray
    sizes: np.ndarray
    along: np.ndarray
    spread: np.ndarray
    block: np.ndarray
    parts: np.ndarray
    first: int
    misses: float

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines to the centroids, and which lists the first round visits."""
        near = x @ self.means.T
        known = np.where(self.sizes > 0, near, -9)
        take = min(self.first, near.shape[1])
        visit = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(visit, np.argpartition(-known, take - 1, axis=1)[:, :take], True, axis=1)
        return near, visit & (self.sizes > 0)

    def further(self, near: np.ndarray, visited: np.ndarray, beat: np.ndarray, dims: int) -> np.ndarray:
        """Which lists the second round visits: those of most worth, until the rest is worth at most `misses`."""
        mean = near * self.along
        spread = np.sqrt((1 - near**2).clip(0) * (1 - self.along**2).clip(0) / max(1, dims - 1) + (near * self.spread) ** 2 + 1e-9)
        z = np.clip((beat[:, None] - mean) / spread, -8, 8)
        worth = self.sizes / (1 + np.exp(1.5976 * z + 0.07056 * z**3))  # upper tail of the normal distribution
        worth[visited] = 0
        order = np.argsort(worth, axis=1)
        left = np.cumsum(np.take_along_axis(worth, order, 1), axis=1)
        open_ = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(open_, order, left > self.misses, axis=1)
        return open_ & ~visited & (self.sizes > 0)

    def to_blocks(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(query number, block, lists asked there) for each block that holds an open list."""
        qi, li = np.nonzero(open_)
        wide = np.repeat(np.arange(len(qi)), self.parts[li])
        offset = np.arange(len(wide)) - np.repeat(np.cumsum(self.parts[li]) - self.parts[li], self.parts[li])
        qi, li, to = qi[wide], li[wide].astype(np.int32), self.block[li[wide]] + offset
        order = np.lexsort((to, qi))
        qi, li, to = qi[order], li[order], to[order]
        cut = np.nonzero(np.concatenate([[True], (qi[1:] != qi[:-1]) | (to[1:] != to[:-1])]))[0] if len(qi) else np.zeros(0, int)
        return qi[cut], to[cut], [a.tobytes() for a in np.split(li, cut[1:])] if len(cut) else []


def _layout(means: np.ndarray, sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list: neighbouring lists together, lists beyond `block_rows` split."""
    block_of, parts = np.zeros(len(means), int), np.maximum(1, -(-sizes // block_rows))
    block, used = -1, block_rows + 1
    for j in np.argsort(-(means @ means[0]), kind="stable"):
        if parts[j] > 1 or used + sizes[j] > block_rows:
            block, used = block + 1, 0
        block_of[j] = block
        if parts[j] > 1:
            block, used = block + int(parts[j]) - 1, block_rows + 1
        else:
            used += sizes[j]
    return block_of, parts


def _scan_block(k: int, dims: int):
    """The search of the queries of one block in those of its lists that they ask for."""

    def run(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return no_rows("q", "id", "cosine")
        right = right.sort_values(["list", "id"], ignore_index=True)
        lists, ids, rows = right["list"].to_numpy(), right["id"].to_numpy(), unpack(right["v"], dims)
        asked = np.frombuffer(b"".join(left["lists"]), dtype=np.int32)
        who = np.repeat(np.arange(len(left)), left["lists"].map(len).to_numpy() // 4)
        names, x, best = left["q"].to_numpy(), unpack(left["qv"], dims), left["beat"].to_numpy().astype(float).copy()
        out = []
        for j in np.unique(asked):
            lo, hi = np.searchsorted(lists, j, side="left"), np.searchsorted(lists, j, side="right")
            mine = who[asked == j]
            qi, ri, s = scan(x[mine], best[mine], rows[lo:hi], k + 1)
            at, ri = mine[qi], ri + lo
            other = names[at] != ids[ri]
            at, ri, s = at[other], ri[other], s[other]
            if not len(at):
                continue
            out.append((at, ri, s))
            # A list with k better ones raises what the block's next lists have to beat.
            order = np.lexsort((-s, at))
            first = np.searchsorted(at[order], at[order], side="left")
            kth = order[np.arange(len(order)) - first == k - 1]
            best[at[kth]] = np.maximum(best[at[kth]], s[kth])
        if not out:
            return no_rows("q", "id", "cosine")
        at, ri, s = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((ids[ri], -s, at))
        at, ri, s = at[order], ri[order], s[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
        return pd.DataFrame({"q": names[at[keep]], "id": ids[ri[keep]], "cosine": s[keep]})

    return run


def _fold(vectors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(distinct vectors under their smallest id, (`rep`, `id`, `is_query`) of all vectors that have copies, if any)."""
    distinct = vectors.groupBy("v").agg(F.min("id").alias("id"), F.max("is_query").alias("is_query"), F.count(F.lit(1)).alias("copies"))
    distinct = cut_lineage(distinct.select("id", "is_query", "v", "copies"))
    many = distinct.where("copies > 1").select("v", F.col("id").alias("rep"))
    if many.isEmpty():
        return distinct.drop("copies"), None
    members = vectors.select("id", "is_query", "v").join(many, "v").select("rep", "id", "is_query")
    return distinct.drop("copies"), cut_lineage(members)


def _unfold(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours between distinct vectors to neighbours between all: every copy answers, and asks, under its own id."""
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    ids = members.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    wide = found.join(ids, F.col("id") == F.col("rep"), "left").select("q", "cosine", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    asked = members.groupBy("rep").agg(F.max("is_query").alias("asks")).where("asks").join(ids, "rep")
    own = asked.select(F.col("rep").alias("q"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("id"))
    best = top_n_per_group(wide.unionByName(own), ["q"], [F.desc("cosine")], k + 1, ["id"], "rank", salts=1)
    single = best.join(members.select(F.col("rep").alias("q")).distinct(), "q", "left_anti").select("q", "id", "cosine")
    shared = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cosine"))).alias("best")).withColumnRenamed("q", "rep")
    copies = members.where("is_query").join(shared, "rep").select(F.col("id").alias("q"), F.filter("best", lambda b: b["id"] != F.col("id")).alias("best"))
    copies = copies.select("q", F.explode(F.slice("best", 1, k)).alias("b")).select("q", "b.id", "b.cosine")
    return single.unionByName(copies)


def _search(vectors: DataFrame, k: int, dims: int, block_rows: int, first_lists: int, misses: float) -> tuple[DataFrame, DataFrame]:
    """(`q`, `id`, `cosine` of at least the k best probed per query, `q`, `lists`, `of_lists`, `rows_compared`) for distinct vectors."""
    spark = vectors.sparkSession
    total, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    n_lists = int(max(1, min(total // 4, np.sqrt(total))))
    sample = unpack(bounded_sample(vectors.select("id", "v"), max(SAMPLE, 4 * n_lists), total)["v"], dims)
    turn = rotation(dims)
    n_lists = max(1, min(n_lists, len(sample)))
    means = spherical_means(sample @ turn, n_lists)
    shared = spark.sparkContext.broadcast((turn, means))  # sqrt(n) centroids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, c = shared.value
        for b in batches:
            x = unpack(b["v"], dims) @ r
            s = x @ c.T
            at = s.argmax(1)
            yield pd.DataFrame({"id": b["id"], "is_query": b["is_query"], "list": at, "along": s[np.arange(len(x)), at].astype(float), "v": [row.tobytes() for row in x]})

    listed = cut_lineage(vectors.select("id", "is_query", "v").mapInPandas(assign, "id string, is_query boolean, list int, along double, v binary"))
    stats = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("along").alias("m"), F.stddev_pop("along").alias("s")).collect()
    sizes, along, spread = np.zeros(n_lists, int), np.zeros(n_lists), np.zeros(n_lists)
    for r in stats:
        sizes[r["list"]], along[r["list"]], spread[r["list"]] = r["n"], r["m"], r["s"]
    block_of, parts = _layout(means, sizes, block_rows)
    lists = Lists(means, sizes, along, spread, block_of, parts, first_lists, misses)
    layout = spark.sparkContext.broadcast(lists)
    table = spark.createDataFrame([(j, int(block_of[j]), int(parts[j])) for j in range(n_lists)], "list int, first int, parts int")
    placed = listed.join(F.broadcast(table), "list").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"), "id", "list", "v")
    asking = listed.where("is_query").select(F.col("id").alias("q"), F.col("v").alias("qv"))

    def opened(b: pd.DataFrame) -> np.ndarray:
        x = unpack(b["qv"], dims)
        near, visit = layout.value.nearest(x)
        return layout.value.further(near, visit, b["beat"].to_numpy(), dims) if "beat" in b else visit

    def visits(queries: DataFrame) -> DataFrame:
        """The queries at the blocks they have to visit. Only blocks that more queries meet than a task takes are sent twice or more."""
        salts = {}
        if n_queries > BLOCK_QUERIES:

            def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    to, n = np.unique(layout.value.to_blocks(opened(b))[1], return_counts=True)
                    yield pd.DataFrame({"block": to, "n": n})

            loads = queries.mapInPandas(counted, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_QUERIES).collect()
            salts = {r["block"]: -(-r["n"] // BLOCK_QUERIES) for r in loads}

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                qi, to, asked = layout.value.to_blocks(opened(b))
                if len(qi):
                    beat = b["beat"].to_numpy() if "beat" in b else np.full(len(b), -2.0)
                    yield pd.DataFrame({"block": to, "q": b["q"].to_numpy()[qi], "qv": b["qv"].to_numpy()[qi], "beat": beat[qi], "lists": asked})

        routed = queries.mapInPandas(route, "block int, q string, qv binary, beat double, lists binary")
        held = placed.withColumn("salt", F.lit(0))
        if salts:
            split = spark.createDataFrame([(int(b), int(n)) for b, n in salts.items()], "block int, salts int")
            every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
            held = placed.join(F.broadcast(split), "block", "left").select("block", "id", "list", "v", every)
            routed = routed.join(F.broadcast(split), "block", "left").withColumn("salt", F.pmod(F.xxhash64("q"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        else:
            routed = routed.withColumn("salt", F.lit(0))
        return routed.groupBy("block", "salt").cogroup(held.groupBy("block", "salt")).applyInPandas(_scan_block(k, dims), _PAIR)

    near = cut_lineage(top_n_per_group(visits(asking), ["q"], [F.desc("cosine")], k, ["id"], "rank", salts=1).select("q", "id", "cosine"))
    kth = near.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c"))
    beaten = cut_lineage(asking.join(kth, "q", "left").select("q", "qv", F.when(F.col("n") >= k, F.col("c")).otherwise(-2.0).alias("beat")))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = layout.value
        for b in batches:
            close, visit = held.nearest(unpack(b["qv"], dims))
            open_ = visit | held.further(close, visit, b["beat"].to_numpy(), dims)
            yield pd.DataFrame({"q": b["q"], "lists": open_.sum(1), "of_lists": int((held.sizes > 0).sum()), "rows_compared": open_ @ held.sizes})

    seen = beaten.mapInPandas(report, "q string, lists int, of_lists int, rows_compared long")
    return near.unionByName(visits(beaten)), seen


def nearest(vectors: DataFrame, k: int = 5, queries: str = "is_seed", dims: int = 128, block_rows: int | None = None, first_lists: int = FIRST_LISTS, misses: float = MISSES) -> DataFrame:
    """`q`, `id`, `cosine`, `rank`: the `k` most similar other vectors of every row of `vectors` where `queries` holds.

    `vectors` comes from `usable_vectors`. Cosines equal to seven digits rank by id. A query with fewer than `k` others
    gets all that were probed; a single vector, or none, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", F.coalesce(F.expr(queries), F.lit(False)).alias("is_query"), "v")
    distinct, members = _fold(cut_lineage(rows))
    if distinct.isEmpty():
        return spark.createDataFrame([], _PAIR + ", rank int")
    found, _ = _search(distinct, k, dims, block_rows or BLOCK_ROWS, first_lists, misses)
    found = found if members is None else _unfold(found, members, k)
    return top_n_per_group(found, ["q"], [F.desc("cosine")], k, ["id"], "rank", salts=1)


def probe_report(vectors: DataFrame, k: int = 5, queries: str = "is_seed", dims: int = 128) -> DataFrame:
    """`q`, `lists`, `of_lists`, `rows_compared`: the lists that each query (once for equal vectors) visits, of how many, and their rows."""
    rows = vectors.select("id", F.coalesce(F.expr(queries), F.lit(False)).alias("is_query"), "v")
    distinct, _ = _fold(cut_lineage(rows))
    if distinct.isEmpty():
        return vectors.sparkSession.createDataFrame([], "q string, lists int, of_lists int, rows_compared long")
    return _search(distinct, k, dims, BLOCK_ROWS, FIRST_LISTS, MISSES)[1]


def neighbour_pairs(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The unordered pairs made by every seed and its `k` nearest others, each once: `subreddit_id_a` < `subreddit_id_b`."""
    found = nearest(vectors, k)
    pairs = found.select(F.least("q", "id").alias("subreddit_id_a"), F.greatest("q", "id").alias("subreddit_id_b"), "cosine")
    return pairs.groupBy("subreddit_id_a", "subreddit_id_b").agg(F.max("cosine").alias("cosine_similarity"))


def similar_rows(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Every vector with its `k` nearest others by rank: `subreddit_id`, `similar_subreddit_id`, `similar_subreddit_name`, `cosine_similarity`, `distance_rank`."""
    vectors = cut_lineage(vectors)
    names = vectors.select("id", F.col("name").alias("similar_subreddit_name"))
    found = nearest(vectors.select("id", "is_seed", "v"), k, "true").join(names, "id")
    return found.select(F.col("q").alias("subreddit_id"), F.col("id").alias("similar_subreddit_id"), "similar_subreddit_name", F.col("cosine").alias("cosine_similarity"), F.col("rank").alias("distance_rank"))
