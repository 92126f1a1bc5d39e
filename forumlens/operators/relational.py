"""Relational operators that recur in every job: dedupe, shares, outer joins, profiles, reshaping.

All are plans of built-in expressions. Nulls in grouping keys form groups of their own unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per `keys` under `order`. End `order` in a unique column, or ties are decided arbitrarily.

    The window is limited on the map side (`row_number() = 1`), so a hot key costs its own rows once.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first `n` rows per group with their number."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def share_of_total(df: DataFrame, keys: Sequence[str], parts: Sequence[str], value: Column | None = None, count: str = "n", share: str = "share") -> DataFrame:
    """Rows (or `value`) per `keys` + `parts`, and their share of the total of `keys`; a total of zero gives null."""
    measure = F.count(F.lit(1)) if value is None else F.sum(value)
    counted = df.groupBy(*keys, *parts).agg(measure.alias(count))
    total = F.sum(count).over(Window.partitionBy(*keys))
    return counted.withColumn(share, F.try_divide(F.col(count), total))


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """Full outer join whose keys, and the columns in `fill` that both sides have, take the side that is present.

    Other columns with the same name on both sides are an error, as one of them would hide the other. Null keys do not
    match, as in SQL.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys) - set(fill)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in keys]
    both = [F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`")).alias(c) for c in (*keys, *fill)]
    rest = [F.col(f"l.`{c}`") for c in left.columns if c not in keys and c not in fill] + [F.col(f"r.`{c}`") for c in right.columns if c not in keys and c not in fill]
    return l.join(r, on, "full").select(*both, *rest)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` itself, or an error that shows repeated keys. One aggregate; only a few examples reach the driver."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"{list(keys)} are not unique: {[tuple(r) for r in repeated]}")
    return df


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`row_count` and `unique_count` of the keys; a row with a null key does not count as unique."""
    one = F.col(keys[0]) if len(keys) == 1 else F.when(F.concat(*(F.col(k).cast("string") for k in keys)).isNotNull(), F.struct(*keys))
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(one).alias("unique_count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """`value`, `n`, `percent`, `cumulative_percent`, most frequent first, ties by value (null first).

    The running total is over distinct values in one task: meant for columns of categories.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    running = Window.orderBy(F.desc("n"), F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(everything)
    return counted.select("value", "n", (F.col("n") / total).alias("percent"), (F.sum("n").over(running) / total).alias("cumulative_percent"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: `column`, `n`, `uniques`, `nulls`, `null_percent`, in a single pass over the table."""
    names = list(columns or df.columns)
    measures = []
    for k, c in enumerate(names):
        measures += [F.count(c).alias(f"n{k}"), F.count_distinct(F.col(c)).alias(f"u{k}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), F.col(f"u{k}").alias("uniques"),
            (F.col("rows") - F.col(f"n{k}")).alias("nulls"), F.try_divide(F.col("rows") - F.col(f"n{k}"), F.col("rows")).alias("null_percent"),
        )
        for k, c in enumerate(names)
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def majority(df: DataFrame, keys: Sequence[str], label: str, name: str = "majority") -> DataFrame:
    """The most frequent non-null `label` per group; ties go to the first in order."""
    counted = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(name))


def counts_wide(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, percent: bool = True) -> DataFrame:
    """One column of counts (and of percents) per given value. Values are given, so no pass is spent on finding them."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"{v}_count") for v in values]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumns({f"{v}_percent": F.col(f"{v}_count") / F.col("total") for v in values}) if percent else out


def stack(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", keep_nulls: bool = False) -> DataFrame:
    """Wide to long; null cells are dropped unless `keep_nulls`."""
    long = df.unpivot(list(keys), list(columns), name, value)
    return long if keep_nulls else long.where(F.col(value).isNotNull())


def unstack(df: DataFrame, keys: Sequence[str], name: str, value: Column, values: Sequence, fill=0) -> DataFrame:
    """Long to wide over given values; missing cells get `fill`."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(value).na.fill(fill, [str(v) for v in values])


def column_order(df: DataFrame, front: Sequence[str]) -> DataFrame:
    """`front` first, the other columns behind in their order."""
    return df.select(*front, *(c for c in df.columns if c not in front))


def not_equal_or_null(column: Column, value) -> Column:
    """True where the column is null or differs: the meaning of `!=` where missing values compare as different."""
    return ~column.eqNullSafe(F.lit(value))


def set_overlap(**sets: DataFrame) -> DataFrame:
    """Sizes of all parts of a Venn diagram: one boolean column per set, and `n`. Each set has one column `id`; nulls do not count."""
    flagged = None
    for name, df in sets.items():
        part = df.select("id").where("id is not null").withColumns({s: F.lit(int(s == name)) for s in sets})
        flagged = part if flagged is None else flagged.unionByName(part)
    each = flagged.groupBy("id").agg(*(F.max(s).cast("boolean").alias(s) for s in sets))
    return each.groupBy(*sets).agg(F.count(F.lit(1)).alias("n"))
