"""Usable vectors of a table with repeats, earlier runs and broken rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, dims: int = 128) -> DataFrame:
    """One row per community: `id`, `name`, `is_seed`, `v` (unit length, float32 bytes).

    Usable is a vector of `dims` finite numbers, not all zero, with a non-null id. Of a community's usable rows the
    latest `pt` counts, once; equal `pt` are decided by the vector itself, so the choice is the same on every run.
    Null flags count as false. An empty table gives an empty result.
    """
    fit = (F.size("embeddings") == dims) & F.forall(
        "embeddings", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("embeddings", lambda x: x != 0)
    rows = df.where(F.col("subreddit_id").isNotNull() & F.col("embeddings").isNotNull()).where(fit)
    best = rows.groupBy("subreddit_id").agg(
        F.max(F.struct("pt", "embeddings", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), "subreddit_name")).alias("b")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["e"].to_numpy()).astype(np.float64)
                # Two steps, so that the squares of very large or small numbers stay finite.
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"id": b["id"], "name": b["name"], "is_seed": b["is_seed"], "v": [r.tobytes() for r in x.astype(np.float32)]})

    flat = best.select(F.col("subreddit_id").alias("id"), F.col("b.subreddit_name").alias("name"), F.col("b.is_seed").alias("is_seed"), F.col("b.embeddings").alias("e"))
    return flat.mapInPandas(pack, "id string, name string, is_seed boolean, v binary")


def unpack(column: pd.Series, dims: int = 128) -> np.ndarray:
    """The matrix of a column of float32 bytes."""
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), dims) if len(column) else np.zeros((0, dims), np.float32)


def bounded_sample(df: DataFrame, rows: int, total: int) -> pd.DataFrame:
    """About `rows` rows, the same on every run: those with the smallest hashed ids."""
    part = 1 << 30
    picked = df if total <= rows else df.where(F.pmod(F.xxhash64("id"), F.lit(part)) < F.lit(part * rows // total))
    return picked.toPandas().sort_values("id", ignore_index=True)


def no_rows(*columns: str) -> pd.DataFrame:
    """An empty frame that converts to any column type."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
