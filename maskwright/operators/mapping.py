"""The token mapping as a table: allocation, merge, lookup, reports.

``mode, scope, token, original, entity_type``: mode is ``hmac`` or ``seq``. Hashed tokens are unique by themselves;
sequential ones count per document, which is their scope, and entity type, so they are looked up with both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import MaskError, Secret, token_pads

SCHEMA = "mode string, scope string, token string, original string, entity_type string"
#: Digits of the HMAC in a token, and values that may share so many before allocation refuses, as a sign of a broken mapping.
#: Fewer digits are shared by ever more values, so those are counted without bound.
DIGITS, MOST_COLLISIONS = 8, 10_000


class MappingError(MaskError):
    exit_code = 5


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def hmac_hex(value: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 of a composed string in hexadecimal, with the pads of the key as binary columns."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def with_pads(df: DataFrame, secret: Secret) -> DataFrame:
    """Adds the pads as columns __ipad, __opad by a broadcast of one row, so that no plan shows the key as a literal."""
    pads = df.sparkSession.createDataFrame([tuple(map(bytearray, token_pads(secret)))], "__ipad binary, __opad binary")
    return df.join(F.broadcast(pads))  # one row


def allocate(values: DataFrame, secret: Secret, existing: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """values (original, entity_type, seen) -> the mapping rows of all their originals.

    A value keeps its token in *existing*. New ones take the first *digits* digits of their HMAC; of those that agree in
    them, the first by ``seen`` takes them bare and others -2, -3 and so on, after those that exist. The entity type is
    that of the first sighting. Values are pre-aggregated, so a value on a third of all rows is one row here.
    """
    first = values.groupBy("original").agg(F.min_by("entity_type", F.struct("seen", "entity_type")).alias("entity_type"), F.min("seen").alias("seen"))
    if existing is not None:
        old = existing.where("mode = 'hmac'")
        first = first.join(old.select("original"), "original", "left_anti")
    new = with_pads(first, secret).withColumn("h", F.left(hmac_hex(F.col("original"), F.col("__ipad"), F.col("__opad")), F.lit(digits)))
    if existing is not None:
        suffix = F.substring_index("token", "-", -1)
        taken = old.groupBy(F.substring_index("token", "-", 1).alias("h")).agg(F.max(F.when(F.contains("token", F.lit("-")), suffix.cast("int")).otherwise(1)).alias("taken"))
        new = new.join(taken, "h", "left")
    else:
        new = new.withColumn("taken", F.lit(0))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("seen", "original")) + F.coalesce("taken", F.lit(0))
    new = new.withColumn("nth", nth)
    token = F.when(F.col("nth") == 1, F.col("h"))
    if digits >= DIGITS:
        token = token.when(F.col("nth") > MOST_COLLISIONS, F.raise_error(F.lit("too many values share a token")).cast("string"))
    token = token.otherwise(F.concat("h", F.lit("-"), F.col("nth").cast("string")))
    new = new.select(F.lit("hmac").alias("mode"), F.lit(None).cast("string").alias("scope"), token.alias("token"), "original", "entity_type")
    return new if existing is None else existing.unionByName(new)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both mappings; of rows with the same key those of *old* stay, and of two in *new* that with the least original."""
    key = ["mode", "scope", "token", "entity_type"]
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    new = new.groupBy(*key).agg(F.min("original").alias("original"))
    other = new.alias("n").join(old.alias("o"), same, "left_anti")
    return old.unionByName(other.select(*(F.col(f"n.{c}") for c in old.columns)))


def tokens_by_type(mapping: DataFrame, entity_type: str) -> DataFrame:
    return mapping.where(F.col("entity_type") == entity_type).select("token")


def inspect(mapping: DataFrame) -> DataFrame:
    """All entries sorted by token."""
    return mapping.orderBy("token", "entity_type")


def last_numbers(mapping: DataFrame) -> DataFrame:
    """scope, entity_type, last: the largest sequential number of each document and type."""
    return mapping.where("mode = 'seq'").groupBy("scope", "entity_type").agg(F.max(F.col("token").cast("int")).alias("last"))
