"""Line deduplication across documents: exact segments, then deletion neighbourhoods on words.

Lines count by their words, A-Z lower-cased. Two lines are near when they are equal, or when few enough words replaced,
inserted or deleted turn one into the other: one for every LEAST_WORDS words of the shorter line, and no more than the
bound. A line goes if an earlier one, by doc_id and line number, is near.

Lines within e edits agree in one of e + 1 segments of the shorter one, which lies shifted by e words at most in the
other; every line emits the hashes of these segments. Lines that share one with few others are paired with them, and
pairs go on whose word parities differ in no more bits than the edits can change. Lines of large groups emit the hashes
of their variants without up to e words and the gaps these left: two lines with the same variant are no further apart
than the union of their gaps. Of a variant and its gaps only the earliest line is paired with the others, so no large
group is expanded to pairs. Hashes only propose: each line that would go is verified by its edit distance from the
earlier line. Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, ascii_lower, few, freed, table, unused, written

LEAST_WORDS = 5
#: Edits at most, in production.
BOUND = 2
#: Lines that share a segment up to which all are paired: this many, or this share of their squared length.
FEW_LINES, FEW_OF_SQUARE = 64, 1 / 64
#: Document ids (8 bytes each) up to which documents are selected by a broadcast, not a shuffle.
FEW_IDS = 1_000_000
#: How tables of hashes are written: a dictionary of them is built in vain, and slow to read.
PLAIN = {"parquet.enable.dictionary": "false"}


def _has_words(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS)) != ""


def _words(line: Column) -> Column:
    """As words(), for a line that has some: no btrim, which takes two arrays as long as the text, and a pattern only
    where words aren't separated by single spaces."""
    other = reduce(or_, (line.contains(x) for x in BLANKS[1:]), line.startswith(" ") | line.endswith(" ") | line.rlike("  "))
    return F.when(other, F.array_remove(F.split(line, BLANK_RUN), "")).otherwise(F.split(line, " "))


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, line, w: the lines that have words. Lower-cased one by one: most have one byte a character."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    d = d.where(_has_words(F.col("t"))).select("doc_id", *more, "line", ascii_lower(F.col("t")).alias("t"))
    return d.select("doc_id", *more, "line", _words(F.col("t")).alias("w"))


def _edits(size: Column, bound: int) -> Column:
    """Edits allowed to a line of *size* words."""
    return F.least(F.lit(bound), F.floor(size / LEAST_WORDS).cast("int"))


def _segments(size: Column, more: int, edits: int) -> Column:
    """Hashes of where the segments of a near line with *more* fewer words than this one may lie in it; the words' hashes are h."""
    of, keys = size - more, []
    for s in range(edits + 1):
        begin, end = (F.floor(of * k / (edits + 1)).cast("int") for k in (s, s + 1))
        if s in (0, edits):
            shifts = [more if s else 0]
        else:  # words added before the segment; were all edits on one side, the first or last segment would be whole
            shifts = [k for k in range(-edits, edits + 1) if abs(k) + abs(more - k) <= edits and not (more == edits and k in (0, more))]
        keys += [F.xxhash64(F.lit(s), of, F.slice("h", begin + 1 + k, end - begin)) for k in shifts]
    return F.array(*keys)


def _keys(size: Column, bound: int) -> Column:
    none = F.array().cast("array<bigint>")
    per = []
    for more in range(bound + 1):
        allowed = _edits(size - more, bound)
        c = F.when(F.lit(False), none)
        for edits in range(max(1, more), bound + 1):
            c = c.when(allowed == edits, _segments(size, more, edits))
        per.append(c.otherwise(none))
    return F.array_distinct(F.concat(*per))


def _order() -> Column:
    """What lines are ordered by: null doc_ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line")


def within_edits(a: Column, b: Column, edits: Column, bound: int) -> Column:
    """Whether at most *edits*, itself at most *bound*, words replaced, inserted or deleted turn array a into array b.

    After each edit, how far into a every diagonal of the alignment (place in b less that in a) can have come.
    """
    n, m = F.size(a), F.size(b)

    def along(i: Column, diagonal: Column) -> Column:
        left = F.least(n - i, m - i - diagonal)
        same = F.zip_with(F.slice(a, i + 1, left), F.slice(b, i + diagonal + 1, left), lambda x, y: x == y)
        # One more that differs, so that the words are compared once, whether any differs or not.
        equal = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)).cast("int") - 1
        return F.when((i < 0) | (left <= 0), i).otherwise(i + equal)

    def step(at: Column, _: Column) -> Column:
        moved = F.transform(at, lambda i, k: F.least(n, m - (k - bound), F.greatest(i + 1, F.when(k > 0, F.get(at, k - 1)), F.get(at, k + 1) + 1)))
        return F.transform(moved, lambda i, k: along(i, k - bound))

    start = F.array(*(F.lit(0 if k == bound else -2 * bound - 2) for k in range(2 * bound + 1)))
    start = F.transform(start, lambda i, k: along(i, k - bound))
    steps = F.filter(F.array(*(F.lit(k) for k in range(1, bound + 1))), lambda k: k <= edits)
    return F.coalesce(F.get(F.aggregate(steps, start, step), m - n + bound) >= n, F.lit(False))


def near_lines(docs: DataFrame, bound: int = 1) -> DataFrame:
    """doc_id, line, kept_doc_id, kept_line: the lines that go, and the earliest line that is near each, with *bound*
    edits at most.

    Lines without words never go and never make others go. Repeated doc_ids with the same text count as one document:
    its lines stay where they are earliest. A written table.
    """
    if bound < 1:
        raise ValueError("bound must be at least 1")
    lines = _lines(docs).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    size = F.size("h")
    # Of 64 classes of words, which the line has an odd number of; an edit changes two bits at most.
    odd = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    all_ = written(
        lines.select("doc_id", "line", size.alias("n"), F.xxhash64("h").alias("f"), F.xxhash64(F.lit(1), "h").alias("f2"), odd.alias("odd"), _keys(size, bound).alias("keys")), "lines", **PLAIN
    )
    first = written(all_.groupBy("f", "f2", "n").agg(F.min(_order()).alias("at"), F.count(F.lit(1)).alias("lines"), F.first("odd").alias("odd"), F.first("keys").alias("keys")), "distinct", **PLAIN)
    hits = _shared(first)
    ends = first.where(F.size("keys") > 0).select("f", "f2", "n", "at", "odd")
    met = written(hits.join(ends, "f"), "met", **PLAIN)
    freed(hits)
    a = met.where("few").select("k", "f", "n", "at", "odd")
    b = a.withColumnsRenamed({"f": "g", "n": "m", "at": "to", "odd": "odds"})
    # The join itself drops the pairs too far apart, before any of them is shuffled.
    edits = _edits(F.least("n", "m"), bound)
    near = (F.abs(F.col("n") - F.col("m")) <= edits) & (F.bit_count(F.col("odd").bitwiseXOR(F.col("odds"))) <= 2 * edits)
    pairs = a.join(b, "k").where((F.col("f") < F.col("g")) & near).select(F.greatest("at", "to").alias("at"), F.least("at", "to").alias("top"))
    likely = written(met.where("NOT few").select("f", "f2", "at.doc_id", "at.line").distinct(), "likely")
    variants = _variants(docs, likely, bound)
    tops = written(variants.groupBy("v", "gaps").agg(F.min("at").alias("top")), "tops")
    other = tops.select("v", F.col("gaps").alias("other"), F.col("top").alias("by"))
    best = tops.join(other, "v").where(F.size(F.array_union("gaps", "other")) <= bound).groupBy("v", "gaps").agg(F.collect_set("by").alias("by"))
    grouped = variants.join(best, ["v", "gaps"]).select("at", F.explode("by").alias("top")).where("at > top")
    proposed = written(pairs.union(grouped).groupBy("at").agg(F.array_sort(F.collect_set("top")).alias("tops")), "proposed")
    freed(met, likely, variants, tops)
    checked = _verified(docs, proposed, bound)
    # Every line goes that equals an earlier one, or whose text goes for an earlier near one.
    verdict = first.select("f", "f2", "n", "lines", F.col("at").alias("first")).join(few(checked), F.col("first") == F.col("at"), "left")
    verdict = verdict.where((F.col("lines") > 1) | F.col("top").isNotNull()).select("f", "f2", "n", "first", "top")
    out = all_.withColumn("at", _order()).join(verdict.hint("shuffle_hash"), ["f", "f2", "n"])
    gone = out.where(F.col("top").isNotNull() | (F.col("at") > F.col("first")))
    keep = F.coalesce("top", "first")
    gone = written(gone.select("doc_id", "line", keep["doc_id"].alias("kept_doc_id"), keep["line"].alias("kept_line")).distinct(), "near_lines")
    freed(all_, first, proposed, checked)
    return gone


def _shared(first: DataFrame) -> DataFrame:
    """k, f, few: the segments that several of the distinct lines have, a row for each line, and whether these are few.
    A window over the segments, so that each is shuffled once."""
    of = Window.partitionBy("k")
    some = first.where(F.size("keys") > 0).select("f", "n", F.explode("keys").alias("k"))
    some = some.withColumns({"c": F.count(F.lit(1)).over(of), "most": F.max("n").over(of)}).where("c > 1")
    few = F.col("c") <= F.greatest(F.lit(FEW_LINES), F.col("most") * F.col("most") * FEW_OF_SQUARE)
    return written(some.select("k", "f", few.alias("few")), "shared", **PLAIN)


def _picked(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, line, w of the lines at *places* (doc_id, line); rows that share a doc_id may bring others too."""
    by = places.groupBy("doc_id").agg(F.collect_set("line").alias("__want")).withColumnRenamed("doc_id", "__id")
    if places.select("doc_id").distinct().count() <= FEW_IDS // 10:
        by = F.broadcast(by)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(by, F.col("doc_id").eqNullSafe(F.col("__id")))
    return _lines(d, "__want").where(F.array_contains("__want", F.col("line"))).select("doc_id", "line", "w")


def _variants(docs: DataFrame, likely: DataFrame, bound: int) -> DataFrame:
    """v, gaps, at: hashes of the likely lines and of their variants without as many words as may be edited, and the
    gaps where these stood; a gap's number is its place times bound, and one more for each further word of it. Variants
    that a single line has are left out."""
    d = _picked(docs, likely.select("doc_id", "line")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("f", F.xxhash64("h")).withColumn("f2", F.xxhash64(F.lit(1), "h"))
    d = d.join(likely.select("doc_id", "line", "f", "f2").withColumnsRenamed({"doc_id": "__id", "line": "__l"}), ["f", "f2"]).where(F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__l") == F.col("line")))
    full = written(d.select(_order().alias("at"), "h").distinct(), "likely_words")
    step = full.select("at", "h", _edits(F.size("h"), bound).alias("edits"), F.array().cast("array<int>").alias("gaps"), F.lit(0).alias("place"))
    v = step
    for k in range(1, bound + 1):
        # Words go from front to back, so that each choice of words is taken once.
        left = step.where((F.col("edits") >= k) & (F.col("place") < F.size("h")))
        left = left.select("at", "h", "edits", "gaps", F.col("place").alias("last"), F.explode(F.sequence("place", F.size("h") - 1)).alias("place"))
        gap = F.when((F.size("gaps") > 0) & (F.col("place") == F.col("last")), F.element_at("gaps", -1) + 1) if k > 1 else F.when(F.lit(False), F.lit(0))
        gap = gap.otherwise(F.col("place") * bound)
        rest = F.concat(F.slice("h", F.lit(1), F.col("place")), F.slice("h", F.col("place") + 2, F.size("h")))
        step = left.select("at", rest.alias("h"), "edits", F.concat("gaps", F.array(gap)).alias("gaps"), "place")
        v = v.union(step)
    # Plain columns up to here, which compress in the shuffle; arrays and structs are made of the few rows that stay.
    gaps = [f"g{k}" for k in range(bound)]
    v = v.select(F.xxhash64("h").alias("v"), "at.doc_id", "at.line", *(F.get("gaps", F.lit(k)).alias(g) for k, g in enumerate(gaps))).repartition("v")
    of = Window.partitionBy("v")
    ends = {f"{end}_{c}": getattr(F, end)(c).over(of) for c in ("doc_id", "line") for end in ("min", "max")}
    v = v.withColumns(ends | {"rows": F.count(F.lit(1)).over(of), "ids": F.count("doc_id").over(of)})
    several = F.coalesce(F.col("min_doc_id") < F.col("max_doc_id"), F.lit(False)) | (F.col("min_line") < F.col("max_line")) | ((F.col("ids") > 0) & (F.col("ids") < F.col("rows")))
    shared = written(v.where(several).select("v", F.array_compact(F.array(*gaps)).alias("gaps"), _order().alias("at")), "variants")
    freed(full)
    return shared


def _verified(docs: DataFrame, proposed: DataFrame, bound: int) -> DataFrame:
    """at, top: the earliest of the proposed lines that are near."""
    pair = proposed.select("at", F.explode("tops").alias("top"))
    ends = pair.select("at.doc_id", "at.line").union(pair.select("top.doc_id", "top.line")).distinct()
    texts = written(_picked(docs, ends).select(_order().alias("p"), "w").distinct(), "texts")
    a, b = texts.select(F.col("p").alias("at"), F.col("w").alias("wa")), texts.select(F.col("p").alias("top"), F.col("w").alias("wb"))
    edits = _edits(F.least(F.size("wa"), F.size("wb")), bound)
    sure = pair.join(a, "at").join(b, "top").where(within_edits(F.col("wa"), F.col("wb"), edits, bound))
    sure = written(sure.groupBy("at").agg(F.min("top").alias("top")), "verified")
    freed(texts)
    return sure


def dedup_lines(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """The rows of *docs*, all columns, without the lines that go; other lines, blank ones too, stay as they are. A
    null text stays null; a document all of whose lines go has an empty one."""
    id_, mark = unused(docs.columns, "__id", "__gone")
    gone = few(written(near_lines(docs, bound).groupBy("doc_id").agg(F.collect_set("line").alias(mark)).withColumnRenamed("doc_id", id_), "gone"))
    d = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(mark, i)), "\n")
    return d.select(*(F.when(F.col(mark).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with words), n_gone, gone (their numbers, from 0) of every document."""
    docs = table(spark, sf_dir, "documents")
    gone = near_lines(docs, BOUND).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("gone")).withColumnRenamed("doc_id", "__id")
    has = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _has_words)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has.alias("n_lines"))
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    none = F.array().cast("array<int>")
    return d.select("doc_id", "n_lines", F.coalesce(F.size(F.coalesce("gone", none)), F.lit(0)).cast("long").alias("n_gone"), F.array_join(F.coalesce("gone", none).cast("array<string>"), ",").alias("gone"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE: dict[str, str] = {}
