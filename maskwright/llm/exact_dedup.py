"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (``counters`` per partition, merged by sum) names the digests that may be frequent; one exact
aggregation verifies them and picks their winners, at most ``counters`` rows, which are broadcast so that copies of
frequent texts are resolved on the map side. All other digests, each of which holds at most about 1/``counters`` of
the rows, go through an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import few, freed, table, unused, written

COUNTERS = 1024


def _hashed(texts: pa.Array) -> pa.Array:
    """SHA-256 of each normalised text; bytes.lower() touches A-Z only."""
    return pa.array([hashlib.sha256((x or "").encode().lower()).digest() for x in texts.to_pylist()], pa.binary())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _hashed(b.column(1))], ["doc_id", "digest"])


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text with A-Z lower-cased; null counts as empty), one row per row of *docs*."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digests, "doc_id long, digest binary")


def misra_gries(items: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most *counters* values of a binary *column* with a lower bound of their counts.

    Every value on more than 1/(counters + 1) of the rows is among them: each partition's summary undercounts by at
    most its rows/(counters + 1), and so does the merged one.
    """
    if counters < 1:
        raise ValueError("counters must be at least 1")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for x in b.column(0).to_pylist():
                if x in held:
                    held[x] += 1
                elif len(held) < counters:
                    held[x] = 1
                else:
                    for k in [k for k in held if held[k] == 1]:
                        del held[k]
                    for k in held:
                        held[k] -= 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["item", "low"])

    parts = items.select(column).where(F.col(column).isNotNull()).mapInArrow(summarise, "item binary, low long")
    # The largest `counters` sums are those left when all are lowered by the next one, as a merge of summaries does.
    return parts.groupBy("item").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "item").limit(counters)


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: one row per row of *docs*.

    Of equal texts the row with the largest doc_id is kept; a null doc_id ranks lowest, and of rows that also tie in
    doc_id exactly one is kept. Null texts equal empty ones. An empty table gives no rows.
    """
    d = written(text_digests(docs).withColumn("uid", F.monotonically_increasing_id()), "digests")
    row = F.struct("doc_id", "uid")
    candidates = misra_gries(d, "digest", counters).select(F.col("item").alias("digest"))
    heavy = written(
        d.join(F.broadcast(candidates), "digest")  # at most `counters` rows
        .groupBy("digest")
        .agg(F.max(row).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1),
        "heavy",
    )
    small = F.broadcast(heavy)  # at most `counters` rows of 32 bytes and three numbers
    frequent = d.join(small, "digest")
    per = Window.partitionBy("digest")
    rest = d.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "*", F.max(row).over(per).alias("top"), F.count(F.lit(1)).over(per).alias("group_size")
    )
    both = frequent.select(rest.columns).unionByName(rest)
    kept = (F.col("top.uid") == F.col("uid")).alias("kept")
    return both.select("doc_id", "digest", F.col("top.doc_id").alias("keep_id"), "group_size", kept)


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of *docs* (all its columns) whose text is kept; see exact_groups for the rule.

    Only the (doc_id, digest) pairs of dropped rows are joined back: by a broadcast while they are few, and otherwise by
    hash tables of their partitions, so texts are shuffled once at most and never sorted.
    """
    groups = written(exact_groups(docs, counters), "groups")
    mark, id_, digest, nth = unused(docs.columns, "__digest", "__id", "__d", "__nth")
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _hashed(b.column(at))], [*b.schema.names, mark])

    full = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())]))
    pair = (F.col("doc_id").alias(id_), F.col("digest").alias(digest))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(digest))
    lost, tie = groups.where(~F.col("kept")), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = written(lost.where(~tie).select(*pair).distinct(), "gone")
    tied = written(lost.where(tie).select(*pair).distinct(), "tied")
    freed(groups)
    left = full.join(few(gone), same, "left_anti")
    if tied.take(1):  # rows that repeat both doc_id and text: one of each stays
        once = Window.partitionBy("doc_id", mark).orderBy(F.lit(1))
        one = left.join(few(tied), same, "left_semi").withColumn(nth, F.row_number().over(once))
        left = left.join(few(tied), same, "left_anti").unionByName(one.where(F.col(nth) == 1).drop(nth))
    return left.drop(mark)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, dropped ones too; see exact_groups."""
    g = exact_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE = {
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}
