"""Helpers shared by the training-data operators: shared-folder tables and native text expressions."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Rows of a few numbers (under 100 bytes each) up to which a counted table is broadcast; beyond, joins shuffle.
FEW_ROWS = 1_000_000

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset and Spark
    runs on this machine alone (tests), a temporary folder of this process; on a cluster it must be set."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder's owner clears it then
            return


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """*df* as a Parquet table in the shared folder, written with *options*: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes *tables*, each from written(), that no DataFrame still to be computed reads. The driver then collects its
    garbage, by which Spark learns that the shuffle files they were made from can go too."""
    for t in tables:
        _remove(t.sparkSession, t._written_path)
        _written.remove((t.sparkSession, t._written_path))
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def few(df: DataFrame) -> DataFrame:
    """A written table of short rows, to be joined by a broadcast if it has at most FEW_ROWS, else by hash tables of its
    partitions, which spares the other side a sort."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df.hint("shuffle_hash")


def unused(columns: list[str], *names: str) -> tuple[str, ...]:
    """*names*, prolonged until none is, but for case, among *columns*."""
    taken = {c.lower() for c in columns}
    more = ""
    while any((n + more).lower() in taken for n in names):
        more += "_"
    return tuple(n + more for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Where a text has one byte a character, the faster lower() does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """The array of words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null; empty if it has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
