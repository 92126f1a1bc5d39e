"""Reading and writing tables: partitions, artifacts, chunked and nested files.

Scratch tables lie in the session's checkpoint folder, which every executor of a cluster can reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.session import checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that this session writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def latest_partition(df: DataFrame, column: str) -> DataFrame:
    """The rows of the greatest non-null partition value: a scalar subquery, so partitions are pruned when it runs."""
    newest = df.agg(F.max(column).alias("__newest"))
    return df.join(F.broadcast(newest), F.col(column) == F.col("__newest"), "left_semi")


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Files below `folder` with the suffix, sorted; a file itself is listed as one."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        path = it.next().getPath().toString()
        if path.endswith(suffix):
            found.append(path)
    return sorted(found)


def file_slice(spark: SparkSession, folder: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A table of some of the files of `name`, in the order of their paths. No file in the slice is an error."""
    files = list_files(spark, f"{folder}/{name}")[start:end]
    if not files:
        raise FileNotFoundError(f"{folder}/{name} has no files in [{start}:{end}]")
    return spark.read.parquet(*files)


def files_one_by_one(spark: SparkSession, folder: str, name: str) -> Iterator[tuple[str, DataFrame]]:
    """(path, table) of each file: for jobs that must treat files apart; the tables are as lazy as any other."""
    for path in list_files(spark, f"{folder}/{name}"):
        yield path, spark.read.parquet(path)


def templated(spark: SparkSession, template: str, args: dict | None = None, columns: Sequence[str] = ("*",), **tables: DataFrame) -> DataFrame:
    """SQL with `{columns}` and tables by name in braces; values are bound as `:name`, never pasted."""
    return spark.sql(template.replace("{columns}", ", ".join(columns)), args=args or {}, **tables)


def read_artifact(spark: SparkSession, root: str, run: str, artifact: str, kind: str = "parquet", columns: Sequence[str] | None = None) -> DataFrame:
    """A file or folder that a run left under its own path; `kind` is a reader name. A missing one is an error."""
    path = "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate((root, run, artifact)) if x)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def concat_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of several runs' tables by column name; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def external_view(spark: SparkSession, name: str, location: str, fmt: str = "parquet") -> str:
    """A session view over files that stay where they are."""
    spark.read.format(fmt).load(location).createOrReplaceTempView(name)
    return name


def clean_header(df: DataFrame) -> DataFrame:
    """Column names in lower case with single underscores; repeats get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = "_".join("".join(ch if ch.isalnum() else " " for ch in c.lower()).split()) or "column"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def reference_seeds(df: DataFrame, key: str, columns: Sequence[str], number: str = "seed_no", value: str = "seed") -> DataFrame:
    """Wide reference data to long: names lower-cased and trimmed, one row per non-null seed."""
    bare = df.select(F.lower(F.trim(key)).alias(key), *(F.lower(F.trim(c)).alias(c) for c in columns))
    return bare.unpivot([key], list(columns), number, value).where(F.col(value).isNotNull())


def write_and_read(df: DataFrame, name: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> DataFrame:
    """Writes a table and returns it as stored: partitioned into folders, and clustered by sorted hash partitions."""
    spark = df.sparkSession
    path = scratch(spark, name)
    out = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path).select(*df.columns)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replaces exactly the partitions that `df` has rows for; others stay, a missing table is created. Repeatable."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def copy_partition(spark: SparkSession, source: str, target: str, column: str, value) -> None:
    """Copies one partition from staging over the same one in production."""
    overwrite_partitions(spark.read.parquet(source).where(F.col(column) == value), target, [column])


@contextmanager
def temp_view(df: DataFrame, name: str) -> Iterator[str]:
    """A view for the length of a block; plans made inside keep working afterwards."""
    unique = f"{name}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(unique)
    try:
        yield unique
    finally:
        df.sparkSession.catalog.dropTempView(unique)


def write_chunks(df: DataFrame, path: str, target_mb: int = 256, bytes_per_row: int = 500) -> None:
    """Files of about `target_mb`: rows per file are bounded, so no pass counts the table and nothing is shuffled."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max(1, (target_mb << 20) // bytes_per_row)).parquet(path)


def write_ndjson(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """One JSON document per row, the run's metadata in front; null fields are kept."""
    front = [F.lit(v).alias(k) for k, v in metadata.items()]
    df.select(*front, "*").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def nest_top(df: DataFrame, group: str, order: Sequence[Column], fields: Sequence[str], n: int, name: str = "records") -> DataFrame:
    """One row per group with the first `n` rows as an array of structs in rank order."""
    ranked = df.withColumn("rnk", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rnk") <= n)
    return ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col("rnk").cast("bigint").alias("rnk"), *fields))).alias(name))


def write_nested_ndjson(df: DataFrame, path: str, group: str, order: Sequence[Column], fields: Sequence[str], n: int) -> None:
    nest_top(df, group, order, fields, n).write.mode("overwrite").json(path)


def nested_json(df: DataFrame, group: str, key: str, values: str) -> DataFrame:
    """`group`, `json`: a JSON object from each key of the group to its list. Keys must be unique in a group."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(values).alias("value"))))
    return df.groupBy(group).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def load_partitions(df: DataFrame, path: str, column: str, keep_from=None) -> None:
    """Appends a day-partitioned load; partitions below `keep_from` expire."""
    df.write.mode("append").partitionBy(column).parquet(path)
    if keep_from is None:
        return
    fs, p = _fs(df.sparkSession, path)
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and type(keep_from)(name.split("=", 1)[1]) < keep_from:
            fs.delete(status.getPath(), True)
