"""Filling fixed-capacity containers with items (problem 6): best-two-fit.

Documents are sized in tokens of a public tokenizer, cut only where they exceed the capacity, and hashed into packs of
bounded size; every pack is packed by one task. Within a pack bins are filled greedily from the largest item down, each
time with the largest item that still fits. When nothing fits any more, the bin's smallest item gives way to the two
unpacked items that fit its expanded gap most tightly, if they fill it better than it did.

Packs are independent, so one pack's last bin may stay open: with `PACK_TOKENS` tokens a pack that is at most one
capacity in `PACK_TOKENS`. No item is dropped: every piece lies in exactly one container.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.session import cut_lineage, spread

#: Where the public tokenizers' files lie, and the one used; tokens of a pack, at least so many capacities.
TOKENIZER_DIR, TOKENIZER, PACK_TOKENS, PACK_CAPACITIES = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken", 4_000_000, 200
#: Fixed value: the pattern that splits text before byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Kinds of container at most, beyond which it is an error; each is one more copy of the documents' sizes (16 bytes a document).
MAX_KINDS = 100

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    sent = SparkFiles.get(os.path.basename(path))
    path = sent if os.path.exists(sent) else path
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`doc_id`, `tokens`: whole texts, sized on the executors. Null and empty texts have no tokens and give no row.

    The tokenizer's file is sent from the driver to the executors, so no machine but the driver's must hold it.
    """
    path = tokenizer or f"{TOKENIZER_DIR}/{TOKENIZER}"
    documents.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(encode(t)) for t in b["text"]]})

    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return spread(rows).mapInPandas(run, "doc_id long, tokens long")


class _Pool:
    """Unpacked sizes with their counts: the largest at most x, and the tightest pair at most x."""

    def __init__(self, sizes: list[int]):
        values, counts = np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True)
        self.sizes, self.left = values.tolist(), dict(zip(values.tolist(), counts.tolist()))

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def put(self, size: int) -> None:
        if size not in self.left:
            self.left[size] = 0
            self.sizes.insert(bisect_left(self.sizes, size), size)
        self.left[size] += 1

    def fits(self, room: int) -> int | None:
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def pair(self, room: int) -> tuple[int, int] | None:
        """Two sizes with the greatest sum up to `room`; both ends move towards each other once."""
        sizes, lo, hi = self.sizes, 0, bisect_right(self.sizes, room) - 1
        best: tuple[int, int] | None = None
        while lo <= hi:
            total = sizes[lo] + sizes[hi]
            if total <= room:
                if (lo < hi or self.left[sizes[lo]] > 1) and (best is None or total > sum(best)):
                    best = (sizes[lo], sizes[hi])
                    if total == room:
                        break
                lo += 1
            else:
                hi -= 1
        return best


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of sizes, each at most `capacity`. Every size must lie in 1..capacity."""
    pool, bins = _Pool(sizes), []
    while pool.sizes:
        current, room = [], capacity
        while (size := pool.fits(room)) is not None:
            pool.take(size)
            current.append(size)
            room -= size
        if room and pool.sizes and len(current) > 1:
            smallest = current[-1]
            pair = pool.pair(room + smallest)
            if pair and sum(pair) > smallest:
                current.pop()
                for size in pair:
                    pool.take(size)
                    current.append(size)
                pool.put(smallest)
        bins.append(current)
    return bins


def pack(sized: DataFrame, budgets: DataFrame, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """`container_kind`, `container_id`, `capacity_tokens`, `doc_id`, `copy_no`, `piece_no`, `piece_tokens`, one row per piece.

    `sized` has `doc_id`, `tokens`; null or non-positive sizes give no row. Repeated `doc_id`s are items of their own,
    told apart by `copy_no` (0 for the smallest). A document larger than the capacity is cut into full pieces and a rest. Kinds with a
    null or non-positive capacity give no row; either table may be empty.
    """
    wanted = budgets.where("container_kind is not null and capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    kinds = sorted(map(tuple, wanted.distinct().limit(MAX_KINDS + 1).collect()))
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    items = sized.where("doc_id is not null and tokens > 0").select("doc_id", "tokens")
    total = items.agg(F.sum("tokens")).first()[0] or 0
    rooms = F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(F.lit(pack_tokens), F.col("capacity_tokens") * PACK_CAPACITIES))).cast("int")
    # The kinds are a fixed list of a few entries; each document meets each of them once.
    listed = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens")) for k, c in kinds))
    if kinds:
        pairs = items.withColumn("kind", F.explode(listed)).select("doc_id", "tokens", "kind.*")
    else:
        pairs = items.limit(0).withColumns({"container_kind": F.lit(""), "capacity_tokens": F.lit(1).cast("bigint")})
    pairs = pairs.withColumn("pack", F.pmod(F.xxhash64("doc_id"), rooms).cast("int"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        kind, number = key
        capacity = int(b["capacity_tokens"].iloc[0])
        b = b.sort_values(["doc_id", "tokens"], ignore_index=True)
        tokens, docs, copy = b["tokens"].to_numpy(), b["doc_id"].to_numpy(), b.groupby("doc_id").cumcount().to_numpy()
        full, rest = tokens // capacity, tokens % capacity
        whole = np.repeat(np.arange(len(b)), full)
        out = [(docs[k], copy[k], n, capacity, bin_no) for bin_no, (k, n) in enumerate(zip(whole, (np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)).tolist()))]
        waiting: dict[int, list[int]] = {}
        for k in np.nonzero(rest)[0][::-1]:
            waiting.setdefault(int(rest[k]), []).append(int(k))
        bins = best_two_fit(rest[rest > 0].tolist(), capacity)
        for bin_no, sizes in enumerate(bins, start=len(out)):
            for size in sizes:
                k = waiting[size].pop()
                out.append((docs[k], copy[k], int(full[k]), size, bin_no))
        got = pd.DataFrame(out, columns=["doc_id", "copy_no", "piece_no", "piece_tokens", "bin"])
        return got.assign(container_kind=kind, capacity_tokens=capacity, container_id=[f"{kind}-{number:06d}-{n:07d}" for n in got["bin"]]).drop(columns="bin")

    schema = "doc_id long, copy_no int, piece_no int, piece_tokens long, container_kind string, capacity_tokens long, container_id string"
    return pairs.groupBy("container_kind", "pack").applyInPandas(run, schema)


def packed_documents(documents: DataFrame, budgets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The documents' pieces in containers of every kind; the sizes are computed once and kept for both passes."""
    return pack(cut_lineage(token_counts(documents, tokenizer)), budgets)
