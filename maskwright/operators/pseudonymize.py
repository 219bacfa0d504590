"""Pseudonymisation and restoration of documents.

One projection finds, filters and resolves the spans of every document; texts never pass a shuffle. Only distinct
values are shuffled, to allocate tokens; those that collide come back as a broadcast map while they are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.detectors import Detector, build_detectors, nfc, python_spans
from ..functions.keys import Secret
from ..sources import formats
from .mapping import allocate, hmac_hex, with_pads

#: Entries (about 200 bytes each) up to which collided or restored tokens are broadcast as one map.
FEW_ENTRIES = 50_000


@dataclass(frozen=True)
class Result:
    """documents: the input's columns with the new text, and replaced, its spans; mapping: old and new entries, cached if
    tokens are hashed, until unpersist() is called on it."""

    documents: DataFrame
    mapping: DataFrame


def find_spans(chunks: Column, detectors: list[Detector], shield: tuple[str, Column] | None = None) -> Column:
    """Resolved spans of an array of texts. Spans that touch earlier tokens are left out, and those that touch matches
    of the shield's pattern where its condition holds."""
    native = [d for d in detectors if d.native]

    def one(text: Column) -> Column:
        return F.concat(*(d.native(text) for d in native)) if native else S.no_spans()

    def settle(text: Column, raw: Column) -> Column:
        taken = S.own_tokens(text)
        if shield:
            taken = F.concat(taken, F.when(shield[1], S.regex_spans(text, shield[0], "PERSON", "__shield__", 9999)).otherwise(S.no_spans()))
        return S.let(raw, lambda r: F.when(F.size(r) == 0, r).otherwise(S.resolve(S.outside(r, taken))))

    if any(d.python for d in detectors):
        return F.zip_with(chunks, F.zip_with(chunks, python_spans(chunks, detectors), lambda t, p: F.concat(one(t), p)), settle)
    return F.transform(chunks, lambda t: settle(t, one(t)))


def _composes(detectors: list[Detector]) -> bool:
    """Whether a value may need composing: e-mail addresses and telephone numbers are ASCII."""
    return any(d.entity_type not in ("EMAIL", "PHONE") for d in detectors)


def pseudonymize(
    docs: DataFrame, secret: Secret, detectors: list[Detector] | None = None, *, mapping: DataFrame | None = None,
    order: str = "doc_id", text: str = "text", sequential: bool = False, format: str | Column = "text", digits: int = 8,
) -> Result:
    """Replaces every span by ``[[TYPE_token]]``.

    Hashed tokens depend on value and key alone (but for collisions, in the order of *order*); sequential ones count
    per document and type. *format* picks which parts of a text are looked at. Null texts stay null, and second passes
    change nothing.
    """
    detectors = build_detectors() if detectors is None else detectors
    cols = docs.columns
    d = docs.withColumn("__chunks", formats.chunks(F.col(text), format))
    d = d.withColumn("__spans", find_spans(F.col("__chunks"), detectors, formats.shield(format)))
    values = F.transform("__spans", lambda row: F.transform(row, lambda s: s["text"]))
    d = d.withColumn("__values", nfc(values) if _composes(detectors) else values)
    seen = F.zip_with("__spans", "__values", lambda row, v: F.zip_with(row, v, lambda s, o: F.struct(o.alias("original"), s["entity_type"].alias("entity_type"), s["start"].alias("start"))))
    if sequential:
        d, tokens, table = _sequential(d, seen, mapping, order)
        d = d.withColumn("__tokens", tokens)
    else:
        flat = d.select(F.col(order).alias("__o"), F.posexplode(seen).alias("c", "row")).select("__o", "c", F.explode("row").alias("x"))
        found = flat.select("x.original", "x.entity_type", F.struct("__o", "c", F.col("x.start").alias("s")).alias("seen"))
        # Cached, so that texts are searched once for values and once for replacing; a lost part is computed again.
        table = allocate(found, secret, mapping, digits).persist()
        odd = table.where((F.col("mode") == "hmac") & F.contains("token", F.lit("-"))).select("original", "token")
        d = with_map(with_pads(d, secret), F.flatten("__values"), odd, "__odd")
        plain = lambda v: F.left(hmac_hex(v, F.col("__ipad"), F.col("__opad")), F.lit(digits))
        d = d.withColumn("__tokens", F.transform("__values", lambda row: F.transform(row, lambda v: F.coalesce(F.try_element_at(F.col("__odd"), v), plain(v)))))
    names = F.zip_with("__spans", "__tokens", lambda row, t: F.zip_with(row, t, lambda s, x: S.format_token(s["entity_type"], x)))
    done = F.zip_with(F.col("__chunks"), F.zip_with("__spans", names, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda c, x: S.substitute(c, x["s"], x["n"]))
    replaced = F.flatten("__spans").alias("replaced")
    if isinstance(format, str) and format == "text":
        return Result(d.select(*(F.get(done, F.lit(0)).alias(c) if c == text else F.col(c) for c in cols), replaced), table)
    kind = F.lit(format) if isinstance(format, str) else format
    parts = d.select(*cols, replaced, done.alias("__parts"), kind.alias("__format"))
    return Result(formats.reassembled(parts, text, "__parts", "__format"), table)


def with_map(d: DataFrame, keys: Column, pairs: DataFrame, name: str) -> DataFrame:
    """Adds *name*, a map that holds at least those of the rows of *pairs* (key, value) whose keys are in the array *keys*.

    Up to FEW_ENTRIES pairs are one broadcast map. Beyond, the keys that occur are joined to the pairs and brought back
    per row.
    """
    key, value = pairs.columns
    entries = F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name)
    if pairs.count() <= FEW_ENTRIES:
        return d.join(F.broadcast(pairs.agg(entries)))  # one row
    d = d.withColumn("__row", F.monotonically_increasing_id())
    used = d.select("__row", F.explode(F.array_distinct(keys)).alias(key))
    of = used.join(pairs, key).groupBy("__row").agg(entries)
    return d.join(of, "__row", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>"))).drop("__row")


def _sequential(d: DataFrame, seen: Column, mapping: DataFrame | None, order: str) -> tuple[DataFrame, Column, DataFrame]:
    """Numbers per document and type by first place, after the mapping's last; values that it holds keep theirs. The
    mapping's entries come to their document by a join, so that no plan shows an original."""
    scope = F.col(order).cast("string")
    none = F.create_map().cast("map<string,string>")
    if mapping is None:
        d = d.withColumn("__known", none).withColumn("__last", none)
    else:
        old = mapping.where("mode = 'seq'")
        own = F.concat("scope", F.lit("\x00"), "entity_type")
        first = old.groupBy("scope", own.alias("t"), F.concat(own, F.lit("\x00"), "original").alias("k")).agg(F.min(F.col("token").cast("int")).cast("string").alias("v"))
        known = first.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__known"))
        top = old.groupBy("scope", own.alias("t")).agg(F.max(F.col("token").cast("int")).cast("string").alias("n"))
        last = top.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("__last"))
        per = known.join(last, "scope").withColumnRenamed("scope", "__scope")
        d = d.join(F.broadcast(per) if old.count() <= FEW_ENTRIES else per, scope.eqNullSafe(F.col("__scope")), "left").drop("__scope")
        d = d.withColumn("__known", F.coalesce("__known", none)).withColumn("__last", F.coalesce("__last", none))
    old, base = F.col("__known"), F.col("__last")
    key = lambda t: F.concat(scope, F.lit("\x00"), t)
    flat = F.flatten(F.transform(seen, lambda row: F.transform(row, lambda x: F.struct(key(x["entity_type"]).alias("t"), F.concat(key(x["entity_type"]), F.lit("\x00"), x["original"]).alias("k"), x["original"].alias("o"), x["entity_type"].alias("e")))))
    firsts = F.array_distinct(F.filter(flat, lambda x: F.try_element_at(old, x["k"]).isNull()))
    number = lambda x, i: (F.size(F.filter(F.slice(firsts, 1, i + 1), lambda y: y["t"] == x["t"])) + F.coalesce(F.try_element_at(base, x["t"]).cast("int"), F.lit(0))).cast("string")
    given = F.map_concat(F.map_from_entries(F.transform(firsts, lambda x, i: F.struct(x["k"], number(x, i)))), old)
    tokens = F.transform(seen, lambda row: F.transform(row, lambda x: F.element_at(given, F.concat(key(x["entity_type"]), F.lit("\x00"), x["original"]))))
    rows = F.transform(firsts, lambda x, i: F.struct(F.lit("seq").alias("mode"), scope.alias("scope"), number(x, i).alias("token"), x["o"].alias("original"), x["e"].alias("entity_type")))
    new = d.select(F.explode(rows).alias("r")).select("r.*")
    return d, tokens, new if mapping is None else mapping.unionByName(new)


def restore(docs: DataFrame, mapping: DataFrame, *, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Every token that *mapping* holds becomes its original; others stay. Never fails on a text.

    A hashed token is looked up by itself, a sequential one with its document and type. Small mappings are broadcast as one map;
    beyond FEW_ENTRIES, the tokens that occur are joined to the mapping and brought back per document.
    """
    mode = F.when(F.col("mode") == "seq", F.concat("scope", F.lit("\x00"), "entity_type", F.lit("_"), "token")).otherwise(F.col("token"))
    scope = F.col(order).cast("string") if order in docs.columns else F.lit("")
    pairs = mapping.select(mode.alias("k"), "original").dropDuplicates(["k"])
    if pairs.count() <= FEW_ENTRIES:
        entries = pairs.agg(F.map_from_entries(F.collect_list(F.struct("k", "original"))).alias("__of"))
        d = docs.join(F.broadcast(entries))  # one row
    else:
        d = docs.withColumn("__row", F.monotonically_increasing_id())
        used = d.select("__row", F.explode(F.array_distinct(F.flatten(F.transform(_tokens(F.col(text), scope), lambda m: F.array(m["token"], m["full"]))))).alias("k"))
        of = used.join(pairs, "k").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "original"))).alias("__of"))
        d = d.join(of, "__row", "left").withColumn("__of", F.coalesce("__of", F.create_map().cast("map<string,string>")))
    back = F.transform(_tokens(F.col(text), scope), lambda m: F.coalesce(F.try_element_at(F.col("__of"), m["token"]), F.try_element_at(F.col("__of"), m["full"]), m["text"]))
    gaps = F.split(F.col(text), S.TOKEN_PATTERN, -1)
    whole = S.let(back, lambda b: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(b, i), F.lit("")))), ""))
    out = F.when(F.contains(F.col(text), F.lit("[[")), whole).otherwise(F.col(text))
    return d.select(*(out.alias(c) if c == text else F.col(c) for c in docs.columns))


def _tokens(text: Column, scope: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(S.TOKEN_PATTERN), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(
            m.alias("text"), F.regexp_extract(m, S.TOKEN_PATTERN, 2).alias("token"), F.concat(scope, F.lit("\x00"), F.regexp_replace(m, r"^\[\[|\]\]$", "")).alias("full")
        ),
    )


def report(result: DataFrame, *by: str) -> DataFrame:
    """by..., n_replaced per row: how many replacements each document had."""
    return result.select(*by, F.size("replaced").alias("n_replaced"))
