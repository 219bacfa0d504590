"""Best-fit-decreasing packing of token pieces into windows.

Pieces are spread over buckets by hash, each of a bounded number of pieces, and every bucket is packed by itself: the
longest piece first, each into the open window whose remaining capacity is the least that holds it, found in a segment
tree over capacities. With some thousand pieces to a bucket, what a bucket leaves open at its end is a trifle, and a
lost executor costs the buckets it was at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import WINDOW, pieces

BUCKET_PIECES = 20_000


class CapacityTree:
    """Open windows by remaining capacity: a segment tree whose nodes tell if any window lies below."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.at: list[deque[int]] = [deque() for _ in range(window + 1)]

    def put(self, capacity: int, window_id: int) -> None:
        self.at[capacity].append(window_id)
        i = capacity + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes the window of the smallest capacity that is at least *least*: (capacity, window); None: no such."""
        i = least + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window_id = self.at[capacity].popleft()
        if not self.at[capacity]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return capacity, window_id


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; *lengths* are descending, each from 1 to *window*."""
    tree, out, n = CapacityTree(window), [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            capacity, k, n = window, n, n + 1
        else:
            capacity, k = found
        out.append((k, window - capacity))
        if capacity > length:
            tree.put(capacity - length, k)
    return out


def bucket_packer(window: int) -> Callable[[pa.Table], pa.Table]:
    """Packs one bucket: adds sequence_id and offset. Ties go by doc_id, start and content, so reruns agree."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit(t.column("length").to_pylist(), window)
        base = t.column("bucket")[0].as_py() << 32
        t = t.append_column("sequence_id", pa.array([base + k for k, _ in placed], pa.int64()))
        return t.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return pack


def with_buckets(p: DataFrame, buckets: int) -> DataFrame:
    return p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    Repeated rows are packed each for itself; rows with a null doc_id like any others. No rows in, no rows out.
    """
    p = written(pieces(docs, window, vocabulary), "pieces")
    buckets = -(-p.count() // BUCKET_PIECES) or 1
    columns = [*p.columns, "sequence_id", "offset"]
    schema = ", ".join(f"{c} long" for c in [*p.columns, "bucket", "sequence_id", "offset"])
    return with_buckets(p, buckets).groupBy("bucket").applyInArrow(bucket_packer(window), schema).select(*columns)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
