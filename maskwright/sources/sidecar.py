"""The encrypted mapping file: mark, version, length of the key name, key name, nonce, AES-GCM text with tag.

The header is authenticated with the text. Serialisation, encryption and decryption are Spark expressions; mappings
too large for one file belong into a table instead.
"""

from __future__ import annotations

import secrets
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import MAPPING_LABEL, Secret, derive
from ..operators.mapping import SCHEMA, MappingError

MARK, VERSION = b"MWMP", 2
MOST_ENTRIES = 1_000_000
SUFFIX = ".mapping.enc"


class WrongKeyError(MappingError):
    exit_code = 6


def sidecar_path(path: str) -> str:
    return path + SUFFIX


def header(key_id: str) -> bytes:
    name = key_id.encode()
    if len(name) > 255:
        raise MappingError("a key name has at most 255 bytes")
    return MARK + bytes((VERSION, len(name))) + name


def encode(mapping: DataFrame, secret: Secret, key_id: str = "default") -> bytes:
    """The file's bytes, with a nonce of their own; hashed entries only."""
    m = mapping.where("mode = 'hmac'")
    if m.count() > MOST_ENTRIES:
        raise MappingError(f"more than {MOST_ENTRIES} entries: write the mapping as a table")
    spark, head = mapping.sparkSession, header(key_id)
    entry = F.struct("token", F.struct("entity_type", "original"))
    body = m.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.to_json(F.struct(F.map_from_entries("e").alias("entries"))).alias("j"))
    row = tuple(map(bytearray, (derive(secret, MAPPING_LABEL), head, secrets.token_bytes(12))))
    keys = spark.createDataFrame([row], "k binary, a binary, nonce binary")
    sealed = body.join(F.broadcast(keys)).select(F.aes_encrypt(F.encode("j", "UTF-8"), "k", F.lit("GCM"), F.lit("DEFAULT"), "nonce", "a").alias("x"))
    return head + bytes(sealed.first().x)


def decode(spark: SparkSession, blob: bytes, secret: Secret, expected_key_id: str | None = None) -> DataFrame:
    if len(blob) < 6 or blob[:4] != MARK:
        raise MappingError("not a mapping file")
    end = 6 + blob[5]
    if len(blob) < end + 12:
        raise MappingError("the mapping file is cut off")
    if blob[4] != VERSION:
        raise MappingError(f"mapping version {blob[4]} isn't known")
    name = blob[6:end].decode()
    if expected_key_id is not None and name != expected_key_id:
        raise MappingError(f"the mapping is of key {name!r}, not {expected_key_id!r}")
    row = spark.createDataFrame([(bytearray(blob[end:]), bytearray(derive(secret, MAPPING_LABEL)), bytearray(blob[:end]))], "x binary, k binary, a binary")
    kind = "struct<entries:map<string,struct<original:string,entity_type:string>>>"
    plain = F.try_aes_decrypt("x", "k", F.lit("GCM"), F.lit("DEFAULT"), "a").cast("string")
    text = row.select(plain.alias("j")).first().j
    if text is None:
        raise WrongKeyError("wrong key, or the mapping file was changed")
    entries = spark.createDataFrame([(text,)], "j string").select(F.explode(F.from_json("j", kind)["entries"]).alias("token", "e"))
    out = entries.select(F.lit("hmac").alias("mode"), F.lit(None).cast("string").alias("scope"), "token", "e.original", "e.entity_type")
    assert out.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    return out


def save_mapping(mapping: DataFrame, secret: Secret, path: str | Path, key_id: str = "default") -> Path:
    target = Path(path)
    target.write_bytes(encode(mapping, secret, key_id))
    return target


def load_mapping(spark: SparkSession, path: str | Path, secret: Secret, expected_key_id: str | None = None) -> DataFrame:
    return decode(spark, Path(path).read_bytes(), secret, expected_key_id)
