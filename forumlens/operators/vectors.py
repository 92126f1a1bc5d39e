"""Vectors as arrays: means, mixes, products and exact neighbours.

Sums run in double precision. Means are native aggregates with map-side partial sums, so a group with millions of vectors
costs its dimensions after the first stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import cut_lineage

#: Vectors of a block in the exact search; a pair of blocks is one task.
BLOCK = 8192


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None, name: str = "vector", count: str | None = None) -> DataFrame:
    """The (weighted) mean per group: sum(w * x) / sum(w), with the number of vectors in `count` if asked for.

    A native vector aggregate with map-side partial sums: no row per position is made. Vectors that are null or hold a
    null, and rows with a null weight, do not count. A group whose weights are all zero gets a null vector. Negative
    weights, and vectors of different lengths in one group, are errors.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vector).isNotNull()).where(F.forall(vector, lambda x: x.isNotNull()))
    n = F.count(F.lit(1)).alias("__n")
    wide = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    if weight is None:
        out = rows.groupBy(*keys).agg(Summarizer.mean(wide).alias("__m"), n)
    else:
        weighted = rows.withColumn("__w", weight.cast("double")).where("__w is not null")
        some = weighted.where("__w <> 0").groupBy(*keys).agg(Summarizer.mean(wide, F.col("__w")).alias("__m"), n)
        none = weighted.groupBy(*keys).agg(n, F.max(F.abs("__w")).alias("__top")).where("__top = 0").drop("__top")
        out = some.unionByName(none, allowMissingColumns=True)
    out = out.select(*keys, F.when(F.col("__m").isNotNull(), vector_to_array("__m")).alias(name), F.col("__n").alias("__count"))
    return out.withColumnRenamed("__count", count) if count else out.drop("__count")


def _times(w: float):
    return lambda x: x.cast("double") * w


def mix(parts: Sequence[tuple[Column, float]]) -> Column:
    """The weighted mean of several vectors of a row over those that are present; null if none is."""
    total, weights = None, None
    for vector, w in parts:
        scaled = F.when(vector.isNotNull(), F.transform(vector, _times(w)))
        share = F.when(vector.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0))
        total = scaled if total is None else F.when(total.isNull(), scaled).when(scaled.isNull(), total).otherwise(F.zip_with(total, scaled, lambda a, b: a + b))
        weights = share if weights is None else weights + share
    return F.transform(total, lambda x: x / weights)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0))), F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def angular_to_cosine(d: Column) -> Column:
    return 1 - d * d / 2


def cosine_topk(df: DataFrame, key: str, vector: str, k: int, queries: Column | None = None, block: int = BLOCK) -> DataFrame:
    """`id_a`, `id_b`, `cosine_similarity`, `distance_rank`: the `k` most similar others of every row (or every row of `queries`).

    Exact. Queries that fit one block are sent to all rows, which are scanned once where they lie. Otherwise rows are cut into blocks by hash; a task multiplies one block of queries with one block of rows and keeps k
    per query, so what is shuffled is rows times blocks and never the square matrix. Ties rank by id. Null vectors
    neither ask nor answer; an all-zero vector has similarity 0 to everything.
    """
    base = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("v"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asks")
    )
    base = cut_lineage(base)
    key_type = base.schema["id"].dataType.simpleString()
    schema = f"id_a {key_type}, id_b {key_type}, cosine_similarity double"
    order = Window.partitionBy("id_a").orderBy(F.desc("cosine_similarity"), F.asc("id_b"))
    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def compare(_key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("id_a", "id_b", "cosine_similarity")})
        r = r.sort_values("id", ignore_index=True)
        x, y, out = unit(q["v"]), unit(r["v"]), []
        qi, ri = q["id"].to_numpy(), r["id"].to_numpy()
        for lo in range(0, len(x), 512):
            s = x[lo : lo + 512] @ y.T
            s[qi[lo : lo + 512][:, None] == ri[None, :]] = -np.inf
            kept = min(k, s.shape[1])
            kth = -np.partition(-s, kept - 1, axis=1)[:, kept - 1]
            i, j = np.nonzero(s >= np.maximum(kth, -2)[:, None])
            out.append(pd.DataFrame({"id_a": qi[lo + i], "id_b": ri[j], "cosine_similarity": s[i, j]}))
        return pd.concat(out)

    few = base.where("asks").limit(block + 1).select("id", "v").toPandas() if queries is not None else None
    if few is not None and len(few) <= block:
        sent = base.sparkSession.sparkContext.broadcast(few)  # at most one block

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield compare((), sent.value, b)

        found = base.select("id", "v").mapInPandas(meet, schema)
        return found.withColumn("distance_rank", F.row_number().over(order)).where(F.col("distance_rank") <= k)
    blocks = max(1, -(-base.count() // block))
    placed = base.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = placed.where("asks").select(F.col("b").alias("qb"), every.alias("rb"), "id", "v")
    offered = placed.select(every.alias("qb"), F.col("b").alias("rb"), "id", "v")

    found = asking.groupBy("qb", "rb").cogroup(offered.groupBy("qb", "rb")).applyInPandas(compare, schema)
    return found.withColumn("distance_rank", F.row_number().over(order)).where(F.col("distance_rank") <= k)


def batches_of(df: DataFrame, encode, text: str, key: str, dims: int, batch: int = 256) -> DataFrame:
    """`key`, `vector`, `chars`: runs an encoder (a function from texts to a matrix) over batches; a batch that fails is halved.

    A single text that fails even alone is tried with half its length, down to nothing; then its vector is null. `chars`
    says how many of the text's characters the vector stands for, so a shortened text is told from a whole one. Null texts
    get null vectors and null `chars`.
    """

    def safe(texts: list[str]) -> list:
        try:
            return [(v, len(t)) for v, t in zip(np.asarray(encode(texts), dtype=np.float32), texts)]
        except (MemoryError, ValueError):
            if len(texts) > 1:
                half = len(texts) // 2
                return safe(texts[:half]) + safe(texts[half:])
            return safe([texts[0][: len(texts[0]) // 2]]) if texts[0] else [(None, 0)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo in range(0, len(p), batch):
                b = p.iloc[lo : lo + batch]
                there = b[text].notna().to_numpy()
                vectors: list = [None] * len(b)
                chars: list = [None] * len(b)
                for at, v in zip(np.nonzero(there)[0], safe([t for t in b[text] if t is not None]) if there.any() else []):
                    vectors[at], chars[at] = v
                yield pd.DataFrame({key: b[key], "vector": vectors, "chars": pd.Series(chars, dtype="Int32").to_numpy(dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>, chars int")


def hashed_encoder(dims: int = 64):
    """A deterministic encoder without a model: signed hashing of words, unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[k, h % dims] += 1 if (h >> 16) & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return encode
