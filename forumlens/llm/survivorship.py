"""Best representative of each duplicate group (problem 1).

Two rules:

* `surviving_fields` serves a rule that names the trust order (author, time, probability, identifier) as the only criterion: the
  first usable value in that order survives. Votes have no say in it, so none are held.
* `consensus_fields` is a token-level consensus. The values of a group are aligned progressively, most trusted first; every
  alignment column takes a weighted vote over its tokens (or the gap), and the existing value closest to the consensus is emitted. A vote
  counts its probability, twice if it is by the post's author, and equal values add up. Agreement decides; the trust order only breaks ties.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from forumlens.session import cut_lineage

#: Cells of an alignment's table held at once; different values of a group whose consensus is found in one step.
CELLS, CHUNK = 4_000_000, 256
#: What an author's vote counts, against 1, and the probability of a vote whose own is unusable.
AUTHOR, DOUBT = 2.0, 0.5
#: Values that say nothing, compared without case and outer spaces.
PLACEHOLDERS = ("unprocessed", "unknown", "null", "n/a", "[deleted]", "[removed]")
FIELDS = ("language", "geolocation_country_code", "app_name", "text")


def _costs(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the table of edit distances between the heads of a and of b."""
    if len(b) <= 24:  # plain lists are faster than short arrays
        row, other = list(range(len(b) + 1)), b.tolist()
        yield row
        for i, token in enumerate(a.tolist(), start=1):
            above, row = row, [i]
            for j, t in enumerate(other):
                row.append(min(above[j] + (token != t), above[j + 1] + 1, row[j] + 1))
            yield row
        return
    place = np.arange(len(b) + 1)
    row = place.copy()
    yield row
    for i, token in enumerate(a, start=1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (b != token), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
        yield row


def _middle_alignment(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a global alignment of two arrays of token numbers; -1 is a gap. Unit costs.

    A table of more than `CELLS` cells is never held: a is halved, and b where the costs of both halves add up to least
    (Hirschberg's scheme), so the alignment stays exact at any length.
    """
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        head, tail = (np.array(deque(rows, maxlen=1).pop()) for rows in (_costs(a[:half], b), _costs(a[half:][::-1], b[::-1])))
        at = int(np.argmin(head + tail[::-1]))
        right = _middle_alignment(a[half:], b[at:])
        return _middle_alignment(a[:half], b[:at]) + [(i + half if i >= 0 else -1, j + at if j >= 0 else -1) for i, j in right]
    cost, pairs, i, j = list(_costs(a, b)), [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            pairs.append((i, -1))
        else:
            j -= 1
            pairs.append((-1, j))
    return pairs[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """A global alignment: the common head and tail are matched directly, only the differing middle is searched."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ma, mb = a[head : len(a) - tail], b[head : len(b) - tail]
    if ma and mb:
        number: dict = {}
        na, nb = (np.array([number.setdefault(t, len(number)) for t in x]) for x in (ma, mb))
        middle = _middle_alignment(na, nb)
    else:
        middle = [(i, -1) for i in range(len(ma))] + [(-1, j) for j in range(len(mb))]
    shifted = [(i + head if i >= 0 else -1, j + head if j >= 0 else -1) for i, j in middle]
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [*((k, k) for k in range(head)), *shifted, *ends]


def consensus(values: list[list], weights: list[float]) -> list:
    """Progressive alignment of token lists, then the weighted vote per column. Equal votes keep the earlier token."""
    columns: list[dict] = [{t: weights[0]} for t in values[0]]
    seen = weights[0]
    for tokens, weight in zip(values[1:], weights[1:]):
        leading = [max(c, key=c.get) for c in columns]
        merged = []
        for i, j in align(leading, tokens):
            column = columns[i] if i >= 0 else {None: seen}
            token = tokens[j] if j >= 0 else None
            column[token] = column.get(token, 0.0) + weight
            merged.append(column)
        columns, seen = merged, seen + weight
    voted = (max(c, key=c.get) for c in columns)
    return [t for t in voted if t is not None]


def distance(a: list, b: list) -> int:
    return sum(1 for i, j in align(a, b) if i < 0 or j < 0 or a[i] != b[j])


def closest_to_consensus(values: list[str], weights: list[float] | None = None) -> int:
    """The index of the value closest to the consensus of `values`, which come most trusted first; their weights halve unless given."""
    tokens = [v.split() for v in values]
    agreed = consensus(tokens, [2.0**-k for k in range(len(tokens))] if weights is None else weights)
    best, least = 0, None
    for k, t in enumerate(tokens):
        if t == agreed:
            return k
        d = distance(agreed, t)
        if least is None or d < least:
            best, least = k, d
    return best


@F.pandas_udf(ArrayType(StringType()))
def _agreed(values: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([consensus([list(t) for t in v], list(w)) for v, w in zip(values, weights)], dtype=object)


@F.pandas_udf(IntegerType())
def _distance(tokens: pd.Series, agreed: pd.Series) -> pd.Series:
    return pd.Series([distance(list(a), list(t)) for t, a in zip(tokens, agreed)], dtype="int32")


def canonical_id(column: str, prefix: str | Column) -> Column:
    """Lower case, no outer spaces, exactly one type prefix."""
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^t[0-9]_", "")
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, bare)


def usable(column: Column) -> Column:
    """Neither null nor blank nor a placeholder."""
    bare = F.lower(F.trim(column))
    return column.isNotNull() & (bare != "") & ~bare.isin(*PLACEHOLDERS)


def _votes(detections: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`id`, `trust`, `sure`, `field_name`, `value` of every usable value, `id` of every thing with two or more detections)."""
    authors = (
        posts.where("user_id is not null and post_id is not null")
        .select(canonical_id("post_id", "t3_").alias("a_id"), F.col("user_id").alias("a_user"))
        .distinct()
        .withColumn("a_found", F.lit(True))
    )
    kind = F.lower(F.trim("thing_type"))
    prefix = F.when(kind == "post", "t3_").when(kind == "comment", "t1_")
    rows = detections.select(
        canonical_id("id", prefix).alias("id"),
        F.col("user_id").alias("by"),
        "created_timestamp",
        "probability",
        "detection_id",
        "thing_type",
        *FIELDS,
    ).where("id is not null")
    # Only posts can be by the post's author: the other rows do not take part in the join's shuffle.
    of_posts = rows.where(kind == "post").join(authors, (F.col("id") == F.col("a_id")) & (F.col("by") == F.col("a_user")), "left")
    others = rows.where(kind == "comment").withColumns({"a_id": F.lit(None).cast("string"), "a_user": F.lit(None).cast("string"), "a_found": F.lit(False)})
    rows = of_posts.unionByName(others)
    trust = F.struct(
        F.coalesce("a_found", F.lit(False)).alias("author"),
        F.col("created_timestamp").alias("at"),
        F.col("probability").alias("probability"),
        (-F.col("detection_id")).alias("order"),
    )
    sure = F.col("probability").between(0, 1)
    votes = [
        F.struct(F.lit(f).alias("field_name"), F.when(usable(F.col(f)) & (sure if f == "language" else F.lit(True)), F.col(f)).alias("value"))
        for f in FIELDS
    ]
    long = rows.select("id", trust.alias("trust"), F.when(sure, F.col("probability")).alias("sure"), F.explode(F.array(*votes)).alias("v"))
    long = long.select("id", "trust", "sure", "v.*").where("value is not null")
    counted = detections.select(canonical_id("id", prefix).alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return long, counted.select("id")


def surviving_fields(detections: DataFrame, posts: DataFrame, with_value: bool = False) -> DataFrame:
    """The row that supplies each field of every thing with two or more detections: `id`, `field_name`, `detection_id`.

    `with_value` adds the field's `value` itself.

    Trust order: rows by the post's author, then latest `created_timestamp`, highest `probability` (nulls last),
    smallest `detection_id`. A field with no usable value gives no row; a null id or thing type gives no thing.

    The window that keeps the most trusted row is limited on the map side before its shuffle, so a thing with a third of
    all rows sends one row per field and map task; its number of rows is a partial aggregate.
    """
    long, counted = _votes(detections, posts)
    by_trust = Window.partitionBy("id", "field_name").orderBy(F.desc("trust"))
    first = long.withColumn("nth", F.row_number().over(by_trust)).where("nth = 1")
    winners = first.select("id", "field_name", (-F.col("trust.order")).alias("detection_id"), *(["value"] if with_value else []))
    return winners.join(counted, "id", "left_semi")


def consensus_fields(detections: DataFrame, posts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`id`, `field_name`, `detection_id`, `value`, `support`, `votes`, `values`: the field values that the evidence agrees on.

    For every thing with two or more detections and every field with a usable value, the existing value closest to the
    weighted consensus (see above), the best trusted row that holds it, its part of the weights, and how many votes and
    different values there were. Equal distances take the value most trusted. A probability that is null or outside
    0..1 counts as `DOUBT`.

    Equal values are folded on the map side, so a value that a million rows repeat is one vote of their weight. More than
    `chunk` different values of a group are hashed into chunks of about that size; the consensus of each chunk votes with the weight of
    its members on the next level, until one is left. No task holds more than a chunk of a group.
    """
    long, counted = _votes(detections, posts)
    weight = F.when(F.col("trust.author"), AUTHOR).otherwise(1.0) * F.greatest(F.coalesce("sure", F.lit(DOUBT)), F.lit(0.01))
    keys = ["id", "field_name"]
    folded = long.join(counted, "id", "left_semi").groupBy(*keys, "value").agg(F.sum(weight).alias("weight"), F.max("trust").alias("trust"), F.count(F.lit(1)).alias("votes"))
    folded = cut_lineage(folded.withColumn("tokens", F.filter(F.split("value", r"\s+"), lambda t: t != "")))
    level, agreed = folded.select(*keys, "tokens", "weight", "trust"), None
    while True:
        sizes = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("values"))
        most = sizes.agg(F.max("values")).first()[0] or 0
        level = level.join(sizes.where("values > 1") if agreed is None else sizes, keys)
        chunks = F.ceil(F.col("values") / chunk)
        placed = level.withColumn("chunk", F.pmod(F.xxhash64("trust", "tokens"), chunks).cast("int"))
        lists = placed.groupBy(*keys, "chunk").agg(F.reverse(F.array_sort(F.collect_list(F.struct("trust", "weight", "tokens")))).alias("c"))
        agreed = lists.select(*keys, _agreed("c.tokens", "c.weight").alias("tokens"), F.aggregate("c.weight", F.lit(0.0), lambda s, w: s + w).alias("weight"), F.col("c")[0]["trust"].alias("trust"))
        if most <= chunk:
            break
        level = cut_lineage(agreed)
    judged = folded.join(agreed.select(*keys, F.col("tokens").alias("agreed")), keys, "left").withColumn("near", F.when(F.col("agreed").isNotNull(), -_distance("tokens", F.coalesce("agreed", "tokens"))).otherwise(0))
    best = judged.groupBy(*keys).agg(
        F.max(F.struct("near", "trust", "value", "weight")).alias("b"), F.sum("weight").alias("all"), F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("values")
    )
    return best.select(*keys, (-F.col("b.trust.order")).alias("detection_id"), F.col("b.value").alias("value"), (F.col("b.weight") / F.col("all")).alias("support"), "votes", "values")


def surviving_records(detections: DataFrame, posts: DataFrame) -> DataFrame:
    """One wide record per thing with two or more detections, each field from the row `surviving_fields` names."""
    long = surviving_fields(detections, posts, with_value=True)
    return long.groupBy("id").agg(*(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS))
