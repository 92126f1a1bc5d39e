"""Classification and clustering quality from contingency counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, truth: str, found: str) -> DataFrame:
    """`truth`, `found`, `n` over rows where both are known; the only pass over the data that the metrics need."""
    return df.where(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Per class: `support`, `predicted`, `hits`, `precision`, `recall`, `f1`. An empty denominator gives 0."""
    table = contingency(df, truth, found)
    by_truth = table.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("found"), F.col("n")).otherwise(0)).alias("hits"))
    by_found = table.groupBy(F.col("found").alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_truth.join(by_found, "label", "full").na.fill(0, ["support", "predicted", "hits"])
    zero = F.lit(0.0)
    out = both.withColumn("precision", F.coalesce(F.try_divide("hits", F.nullif("predicted", F.lit(0))), zero))
    out = out.withColumn("recall", F.coalesce(F.try_divide("hits", F.nullif("support", F.lit(0))), zero))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), zero))
    return out.withColumn("f1", F.coalesce(f1, zero))


def averages(report: DataFrame) -> DataFrame:
    """`average` (macro, weighted), `precision`, `recall`, `f1` over the classes of a report."""
    names = ("precision", "recall", "f1")
    macro = [F.avg(c).alias(f"m_{c}") for c in names]
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in names]
    one = report.agg(*macro, *weighted)
    rows = [F.struct(F.lit(a).alias("average"), *(F.col(f"{p}_{c}").alias(c) for c in names)) for a, p in (("macro", "m"), ("weighted", "w"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cluster_agreement(df: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: `n`, `homogeneity`, `completeness`, `v_measure`, `adjusted_rand` from the contingency table.

    No rows give nulls; a single class or cluster has entropy 0, and then homogeneity (completeness) is 1.
    """
    table = contingency(df, truth, found)
    w = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    cells = table.select("n", w("truth").alias("a"), w("found").alias("b"), w().alias("t"), "truth", "found")
    p = lambda c: F.col(c) / F.col("t")
    sums = cells.agg(
        F.max("t").alias("n"),
        F.sum(-p("n") * F.log(F.col("n") / F.col("b"))).alias("h_truth_found"),
        F.sum(-p("n") * F.log(F.col("n") / F.col("a"))).alias("h_found_truth"),
        F.sum(-p("n") * F.log(p("a"))).alias("h_truth"),
        F.sum(-p("n") * F.log(p("b"))).alias("h_found"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        F.sum(F.col("n") * (F.col("a") - 1) / 2).alias("pairs_truth"),
        F.sum(F.col("n") * (F.col("b") - 1) / 2).alias("pairs_found"),
    )
    one = sums.withColumns(
        {
            "homogeneity": F.when(F.abs("h_truth") < 1e-15, 1.0).otherwise(1 - F.try_divide("h_truth_found", "h_truth")),
            "completeness": F.when(F.abs("h_found") < 1e-15, 1.0).otherwise(1 - F.try_divide("h_found_truth", "h_found")),
            "expected": F.try_divide(F.col("pairs_truth") * F.col("pairs_found"), F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))),
        }
    )
    most = (F.col("pairs_truth") + F.col("pairs_found")) / 2
    return one.select(
        "n", "homogeneity", "completeness",
        F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.nullif(F.col("homogeneity") + F.col("completeness"), F.lit(0.0))), F.lit(0.0)).alias("v_measure"),
        F.coalesce(F.try_divide(F.col("pairs") - F.col("expected"), F.nullif(most - F.col("expected"), F.lit(0.0))), F.lit(1.0)).alias("adjusted_rand"),
    )


def confusion(df: DataFrame, truth: str, found: str, labels: Sequence) -> DataFrame:
    """One row per true label of `labels`, one column of counts per found label."""
    return contingency(df, truth, found).groupBy("truth").pivot("found", list(labels)).agg(F.sum("n")).na.fill(0)
