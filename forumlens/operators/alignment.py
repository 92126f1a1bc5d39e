"""Rotating one vector space onto another over shared keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def procrustes(source: DataFrame, target: DataFrame, key: str, vector: str, other: str) -> DataFrame:
    """`key`, `aligned`: the vectors of `source` under the rotation that brings shared keys closest to `target`.

    The cross product of the shared vectors is summed per task and added up in the cluster; only that square matrix of
    the dimensions reaches the driver. Keys that are not shared are rotated too. No shared key is an error.
    """
    shared = source.select(key, vector).join(target.select(key, other), key).where(F.col(vector).isNotNull() & F.col(other).isNotNull())

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x, y = (np.stack(b[c].to_numpy()).astype(float) for c in (vector, other))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    cells = shared.mapInPandas(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(got):
        raise ValueError("the two spaces share no key")
    m = np.zeros((got["i"].max() + 1, got["j"].max() + 1))
    m[got["i"], got["j"]] = got["v"]
    u, _, vt = np.linalg.svd(m)
    turn = source.sparkSession.sparkContext.broadcast(u @ vt)

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "aligned": list(np.stack(b[vector].to_numpy()).astype(float) @ turn.value)})

    kind = source.schema[key].dataType.simpleString()
    return source.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(rotate, f"{key} {kind}, aligned array<double>")
