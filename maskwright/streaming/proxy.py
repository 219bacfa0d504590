"""Streams of messages: responses are pseudonymised, requests of trusted peers restored.

The mapping is a Parquet folder. Each micro-batch allocates tokens for values that the mapping doesn't hold and appends
them only if there are any. Tokens depend on key and value, and a batch that is replayed finds its values in the
mapping, so replays give what the first run gave.
"""

from __future__ import annotations

import logging
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.detectors import Detector
from ..functions.keys import Secret
from ..operators.mapping import SCHEMA, empty_mapping
from ..operators.pseudonymize import pseudonymize, restore

log = logging.getLogger(__name__)
#: Kinds of message whose text is looked at; prompts, images and other kinds pass through.
TEXT_KINDS = ("text", "resource", "structured", "meta")


def load_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The mapping in *folder*, on whatever file system; empty where there is none yet."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files)
    return spark.read.schema(SCHEMA).parquet(folder) if found else empty_mapping(spark)


def batch(messages: DataFrame, secret: Secret, mapping_folder: str, detectors: list[Detector] | None = None, *, trusted: bool = False, fail_open: bool = False) -> DataFrame:
    """One batch of (id, direction, kind, text, ...): the messages as they go on."""
    return _batch(messages, secret, mapping_folder, detectors, trusted, fail_open)[0]


def _batch(messages: DataFrame, secret: Secret, mapping_folder: str, detectors: list[Detector] | None, trusted: bool, fail_open: bool) -> tuple[DataFrame, DataFrame]:
    """The messages, and the mapping that is cached for them."""
    spark = messages.sparkSession
    held = load_mapping(spark, mapping_folder)
    looked_at = F.col("kind").isin(*TEXT_KINDS) & F.col("text").isNotNull()
    out = messages.where((F.col("direction") == "response") & looked_at)
    requests = messages.where((F.col("direction") == "request") & looked_at)
    rest = messages.where(~F.coalesce(looked_at & F.col("direction").isin("response", "request"), F.lit(False)))
    table = held
    try:
        result = pseudonymize(out, secret, detectors, mapping=held, order="id")
        table = result.mapping
        new = table.join(held.select("token"), "token", "left_anti").select(held.columns)
        if new.take(1):
            new.write.mode("append").parquet(mapping_folder)
        done = result.documents.select(messages.columns)
    except Exception:
        if not fail_open:
            raise
        log.warning("a batch could not be pseudonymised and passes as it is")  # never its texts
        done = out
    back = restore(requests, held, order="id") if trusted else requests
    return done.unionByName(back).unionByName(rest), table


def start(messages: DataFrame, secret: Secret, mapping_folder: str, output: str, checkpoint: str, detectors: list[Detector] | None = None, *, trusted: bool = False, fail_open: bool = False) -> StreamingQuery:
    """A streaming query over *messages*, written to *output* as Parquet, a folder per batch, so replays replace it."""

    def work(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            out, table = _batch(df, secret, mapping_folder, detectors, trusted, fail_open)
            out.write.mode("overwrite").parquet(f"{output}/batch={epoch}")
            table.unpersist()
        finally:
            df.unpersist()

    return messages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
