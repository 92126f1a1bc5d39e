"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.session import cut_lineage

#: Alternating stars halve the paths each time; far more rounds than a graph of any realistic depth needs.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root`: every node of `edges` with the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Both are aggregates over neighbours: the
    smallest neighbour is a partial aggregate and no list of neighbours is ever built, so a node with millions of
    edges is handled by a join that AQE can split. Each round is written to the shared checkpoint folder.
    Loops and repeats do no harm, edges with a null end are dropped, no edges give no rows.
    """
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = current.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = cut_lineage(current.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour is tied to the smallest one around its centre.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: every smaller neighbour, and the centre, likewise.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        current = cut_lineage(small.where("u <> v").distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))
