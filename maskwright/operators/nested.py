"""Pseudonymising and restoring nested columns: every string leaf, never keys, numbers, booleans or nulls.

The walk is over the schema, on the driver; what runs is one expression per column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..functions.detectors import Detector, build_detectors, nfc
from ..functions.keys import Secret
from .mapping import allocate, hmac_hex, with_pads
from .pseudonymize import Result, _composes, _tokens, find_spans, with_map


def map_leaves(col: Column, kind: T.DataType, leaf: Callable[[Column], Column]) -> Column:
    """*leaf* applied to all strings in *col*."""
    if isinstance(kind, T.StringType):
        return leaf(col)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: map_leaves(x, kind.elementType, leaf)) if _has_text(kind) else col
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, v: map_leaves(v, kind.valueType, leaf)) if _has_text(kind.valueType) else col
    if isinstance(kind, T.StructType) and _has_text(kind):
        fields = F.struct(*(map_leaves(col.getField(f.name), f.dataType, leaf).alias(f.name) for f in kind.fields))
        return F.when(col.isNotNull(), fields)
    return col


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def leaves(col: Column, kind: T.DataType) -> Column:
    """All strings in *col*, nulls left out, as an array."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(col.isNull(), none).otherwise(F.array(col))
    if isinstance(kind, T.ArrayType) and _has_text(kind):
        return F.coalesce(F.flatten(F.transform(col, lambda x: leaves(x, kind.elementType))), none)
    if isinstance(kind, T.MapType) and _has_text(kind.valueType):
        return F.coalesce(F.flatten(F.transform(F.map_values(col), lambda x: leaves(x, kind.valueType))), none)
    if isinstance(kind, T.StructType) and _has_text(kind):
        return F.concat(*(leaves(col.getField(f.name), f.dataType) for f in kind.fields if _has_text(f.dataType)))
    return none


def pseudonymize_nested(df: DataFrame, secret: Secret, columns: list[str], detectors: list[Detector] | None = None, *, mapping: DataFrame | None = None, order: str = "doc_id") -> Result:
    """Replaces the spans in all string leaves of *columns*. Native detectors only."""
    detectors = build_detectors() if detectors is None else detectors
    if any(d.python for d in detectors):
        raise ValueError("nested columns take native detectors only")
    spans_of = lambda t: F.get(find_spans(F.array(t), detectors), F.lit(0))
    kinds = {c: df.schema[c].dataType for c in columns}
    texts = F.concat(*(leaves(F.col(c), k) for c, k in kinds.items()))
    d = df.withColumn("__raw", F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(spans_of(t), lambda s: s["text"])))))
    value = lambda s: s["text"]
    if _composes(detectors):  # as in plain texts, a value's token is that of its composed form
        d = d.withColumn("__nfc", F.map_from_arrays("__raw", F.get(nfc(F.array("__raw")), F.lit(0))))
        value = lambda s: F.try_element_at(F.col("__nfc"), s["text"])
    found = d.select("*", F.posexplode(texts).alias("__i", "__t")).withColumn("__s", F.explode(spans_of(F.col("__t"))))
    found = found.select(value(F.col("__s")).alias("original"), F.col("__s.entity_type").alias("entity_type"), F.struct(F.col(order).alias("o"), F.col("__i").alias("i"), F.col("__s.start").alias("start")).alias("seen"))
    table = allocate(found, secret, mapping).persist()
    odd = table.where((F.col("mode") == "hmac") & F.contains("token", F.lit("-"))).select("original", "token")
    used = F.map_values("__nfc") if _composes(detectors) else F.col("__raw")
    d = with_map(with_pads(d, secret), used, odd, "__odd")

    def leaf(t: Column) -> Column:
        token = lambda v: F.coalesce(F.try_element_at(F.col("__odd"), v), F.left(hmac_hex(v, F.col("__ipad"), F.col("__opad")), F.lit(8)))
        return F.when(t.isNotNull(), S.let(spans_of(t), lambda s: S.substitute(t, s, F.transform(s, lambda x: S.format_token(x["entity_type"], token(value(x)))))))

    return Result(d.select(*(map_leaves(F.col(c), kinds[c], leaf).alias(c) if c in kinds else F.col(c) for c in df.columns)), table)


def restore_nested(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Originals for the hashed tokens in all string leaves of *columns*."""
    pairs = mapping.where("mode = 'hmac'").select("token", "original")
    texts = F.concat(*(leaves(F.col(c), df.schema[c].dataType) for c in columns))
    d = with_map(df, F.flatten(F.transform(texts, lambda t: F.transform(_tokens(t, F.lit("")), lambda m: m["token"]))), pairs, "__of")

    def leaf(t: Column) -> Column:
        back = F.transform(_tokens(t, F.lit("")), lambda m: F.coalesce(F.try_element_at(F.col("__of"), m["token"]), m["text"]))
        gaps = F.split(t, S.TOKEN_PATTERN, -1)
        return S.let(back, lambda b: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(b, i), F.lit("")))), ""))

    whole = lambda t: F.when(t.isNotNull(), leaf(t))
    return d.select(*(map_leaves(F.col(c), df.schema[c].dataType, whole).alias(c) if c in columns else F.col(c) for c in df.columns))


def with_parsed(df: DataFrame, column: str, schema: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs *work* with the JSON text in *column* parsed by *schema*, and writes it as JSON again."""
    parsed = df.withColumn(column, F.from_json(column, schema))
    return work(parsed).withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))
