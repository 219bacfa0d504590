"""Exact Jaccard self-join of documents on word n-grams: a grouped prefix join.

Documents with equal n-gram sets form a class, so copies are never paired. Under a total order of n-grams, two sets
with Jaccard similarity of at least t share one of their first ``n - ceil(t n) + 1`` n-grams (their prefixes). Classes
with the same prefix and size form a group; group pairs are joined on prefix n-grams, cut by size and by the number
of shared prefix n-grams, then expanded to classes and verified on whole sets, block against block.

There is one fixed order of n-grams: by 64-bit hash, but those that many classes hold come last, rarest first, so that a
passage repeated across documents takes no place in the prefixes of documents that have enough beside it. Of each set
only the smallest hashes, a window somewhat longer than the prefix, are kept at first. Classes whose window holds too
few n-grams that aren't common get their prefix from the whole set; what many of these hold becomes common for all,
until no window is too short. A prefix n-gram that isn't common thus has fewer than 2 * LATE holders, and a common one
is in prefixes of classes only that consist of common n-grams almost wholly. Only DataFrame operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, few, freed, table, unused, words, written
from .components import connected_components

WORDS, NUM, DEN = 5, 90, 100
#: N-grams that so many classes hold, in their windows or in sets that had to be taken whole, come last.
LATE = 32
#: N-grams (8 bytes each) that a verification block holds about.
BLOCK_GRAMS = 1 << 17


def shingle_set(text: Column, n: int = WORDS, name: str = "__w") -> tuple[Column, Column]:
    """An expression for a column *name* of words, and over it the sorted distinct 64-bit hashes of the n-grams of a text's
    words, A-Z lower-cased. With fewer words the whole sequence is one n-gram; null, empty and blank texts have none."""
    w, size = words(ascii_lower(F.coalesce(text, F.lit("")))), F.size(name)
    many = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(F.col(name), i, n)))
    return w, (
        F.when(size == 0, F.array().cast("array<bigint>")).when(size <= n, F.array(F.xxhash64(name))).otherwise(F.sort_array(F.array_distinct(many)))
    )


def _prefix_len(n: str, num: int, den: int) -> Column:
    return F.expr(f"cast({n} - ({num}L * {n} + {den - 1}L) div {den}L + 1 AS int)")


def similar_documents(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id: one row per row of *docs*.

    Two rows link when ``den * |A & B| >= num * |A | B|`` for their sets of word n-grams; n_similar counts the other
    rows linked directly, and component_id is the smallest doc_id reachable by links. Rows with equal texts link like
    any others, also where they repeat a doc_id. A row without words links with none; its component is its own doc_id.
    Null doc_ids are passed over in minima. No rows in, no rows out.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold num/den must be above 0 and at most 1")
    members, classes, links = linked_classes(docs, n, num, den)
    keys = ["n", "f1", "f2"]
    one = links.select("a", "b").union(links.select("b", "a"))
    size = classes.select("cid", "m", "low")
    more = one.join(size, F.col("b") == F.col("cid")).groupBy("a").agg(F.sum("m").alias("more"))
    roots = connected_components(links)
    lows = roots.join(size, F.col("node") == F.col("cid")).groupBy("root").agg(F.min("low").alias("component"))
    linked = roots.join(lows, "root").join(more, F.col("node") == F.col("a"))
    info = (
        classes.join(linked.select(F.col("node").alias("cid"), "more", "component"), "cid", "left")
        .where((F.col("m") > 1) | F.col("more").isNotNull())
        .select(*keys, (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("n_similar"), F.coalesce("component", "low").alias("component"))
    )
    info = written(info, "linked")
    freed(classes, links)
    return members.join(info, keys, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def linked_classes(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: members (doc_id, n, f1, f2: a row per document; n and two hashes name its class), classes (cid,
    rep: a document of the class, m: its rows, low: its smallest doc_id, n, f1, f2) and links (a, b: cids, a < b)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = _prefix_len("n", num, den)
    size = p + F.floor(p / 2).cast("int") + 32
    windows = written(_sets(base, n).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n", "f1", "f2", F.slice("s", 1, size).alias("win")), "windows")
    keys = ["n", "f1", "f2"]
    whole = written(
        windows.where("n > 0")
        .groupBy(*keys)
        .agg(F.min(F.struct("uid", "doc_id")).alias("r"), F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("low"), F.first("win").alias("win"))
        .select(F.col("r.uid").alias("cid"), F.col("r.doc_id").alias("rep"), "m", "low", *keys, "win"),
        "classes",
    )
    members, classes = written(windows.drop("win", "uid"), "members"), written(whole.drop("win"), "classes")
    freed(windows)
    groups = _groups(whole, base, p, n)
    freed(whole)
    pairs = _candidates(groups, num, den)
    freed(groups)
    links = _verified(pairs, classes, base, n, num, den)
    freed(pairs)
    return members, classes, links


def _sets(base: DataFrame, n: int) -> DataFrame:
    """doc_id, n (size), f1, f2 (hashes) and s, the n-gram set, of each text."""
    w, grams = shingle_set(F.col("text"), n)
    sets = base.withColumn("__w", w).select("doc_id", grams.alias("s"))
    return sets.select("doc_id", F.size("s").alias("n"), F.xxhash64("s").alias("f1"), F.xxhash64(F.lit(n), "s").alias("f2"), "s")


def _whole_sets(classes: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """cid, s of *classes* (cid, rep, n, f1, f2): the texts read again; rows that share a doc_id may bring a set twice."""
    reps = few(written(classes.select(F.col("rep").alias("__rep")).distinct(), "reps"))
    texts = base.join(reps, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    return _sets(texts, n).join(classes.select("cid", "n", "f1", "f2"), ["n", "f1", "f2"]).select("cid", "s")


def _groups(classes: DataFrame, base: DataFrame, p: Column, n: int) -> DataFrame:
    """cid, gid, n, prefix (only where cid = gid): classes with the same prefix and size have the same gid."""
    in_windows = written(classes.select(F.explode("win").alias("g")).groupBy("g").count().where(F.col("count") >= LATE), "common")
    grams = classes.select("cid", F.explode("win").alias("g"))
    late = in_windows.select("g")
    short = None  # classes, and the n-grams of their whole sets
    spent = [in_windows]
    while True:
        counts = grams.join(few(late), "g").groupBy("cid").agg(F.count(F.lit(1)).alias("k"))
        lacking = classes.select("cid", "rep", "n", "f1", "f2", F.size("win").alias("size"), p.alias("p")).join(counts, "cid").where("n > size AND size - k < p")
        if short is not None:
            lacking = lacking.join(short.select("cid").distinct(), "cid", "left_anti")
        lacking = written(lacking, "short")
        spent.append(lacking)
        if not lacking.take(1):
            break
        more = _whole_sets(lacking, base, n).groupBy("cid").agg(F.first("s").alias("s")).select("cid", F.explode("s").alias("g"))
        short = written(more if short is None else short.select("cid", "g").union(more), "whole")
        spent.append(short)
        late = written(late.union(short.groupBy("g").count().where(F.col("count") >= LATE).select("g")).distinct(), "late")
        spent.append(late)
    # Rarest first among the late, by the counts known, in doublings.
    seen = in_windows if short is None else in_windows.union(short.groupBy("g").count())
    known = seen.groupBy("g").agg(F.max("count").alias("c")).join(late, "g", "left_semi")
    ranked = written(known.select("g", F.floor(F.log2(F.col("c").cast("double"))).cast("int").alias("rank")), "ranked")
    of_late = grams.join(few(ranked), "g").groupBy("cid").agg(F.sort_array(F.collect_set(F.struct("rank", "g")))["g"].alias("late"))
    prefixed = classes.join(of_late, "cid", "left")
    order = F.when(F.col("late").isNull(), F.col("win")).otherwise(F.concat(F.array_except("win", "late"), "late"))
    prefixed = prefixed.select("cid", "n", F.slice(order, 1, p).alias("prefix"))
    if short is not None:
        row = F.struct(F.coalesce("rank", F.lit(-1)).alias("rank"), "g")
        last = short.join(few(ranked), "g", "left").groupBy("cid").agg(F.sort_array(F.collect_set(row))["g"].alias("order"))
        taken = last.join(classes.select("cid", "n"), "cid").select("cid", "n", F.slice("order", 1, p).alias("prefix"))
        prefixed = prefixed.join(last.select("cid"), "cid", "left_anti").union(taken)
    same = Window.partitionBy("n", "h1", "h2")
    grouped = prefixed.select("*", F.xxhash64("prefix").alias("h1"), F.xxhash64(F.lit(1), "prefix").alias("h2")).select(
        "cid", "n", "prefix", F.min("cid").over(same).alias("gid")
    )
    out = written(grouped.select("cid", "gid", "n", F.when(F.col("cid") == F.col("gid"), F.col("prefix")).alias("prefix")), "groups")
    freed(*spent, ranked)
    return out


def _candidates(groups: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: class pairs, a < b, that pass the filters on sizes and on places in the prefixes."""
    grams = groups.where("cid = gid").select(F.posexplode("prefix").alias("i", "g"), "gid", "n")
    shared = written(grams.groupBy("g").count().where("count > 1").select("g"), "shared")
    # Sizes of similar sets differ by a factor of den / num at most: a key's rows meet band by band, not all with all.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num + 1e-9) if num < den else F.col("n")).cast("int")
    held = written(grams.join(few(shared), "g").withColumn("band", band), "held")
    x = held.select("g", "band", F.col("gid").alias("gx"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    y = held.select("g", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("gid").alias("gy"), F.col("n").alias("ny"), F.col("i").alias("iy"))
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("gx") < F.col("gy")))
    # The n-grams shared from the first shared one on, of which both sets hold no more than lies behind it.
    least = F.expr(f"({num}L * (nx + ny) + {num + den - 1}L) div {num + den}L")
    enough = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= least
    met = written(x.join(y, ["g", "band"]).where(larger & (F.col("ny") * den >= F.col("nx") * num) & enough).select(F.col("gx").alias("ga"), F.col("gy").alias("gb")).distinct(), "group_pairs")
    of = groups.select("cid", "gid")
    apart = met.join(of.select(F.col("cid").alias("a"), F.col("gid").alias("ga")), "ga").join(of.select(F.col("cid").alias("b"), F.col("gid").alias("gb")), "gb")
    crowded = of.groupBy("gid").count().where("count > 1").select("gid")
    inner = of.join(crowded, "gid", "left_semi")
    within = inner.select("gid", F.col("cid").alias("a")).join(inner.select("gid", F.col("cid").alias("b")), "gid").where("a < b")
    out = written(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(within.select("a", "b")), "pairs")
    freed(shared, held, met)
    return out


def _verified(pairs: DataFrame, classes: DataFrame, base: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are similar.

    Classes that have candidates in common are put into blocks of about BLOCK_GRAMS n-grams; a set is sent once to each
    pair of blocks, not to each pair of classes, and a pair of blocks is verified within one row.
    """
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("cid"), F.least("a", "b").alias("label"))
    near = written(near.join(classes.select("cid", "rep", "n", "f1", "f2"), "cid"), "near")
    count = near.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("r"))
    block = F.xxhash64("label", F.pmod(F.xxhash64("cid"), F.col("r")))
    nodes = written(near.join(count, "label").select("cid", "rep", "n", "f1", "f2", block.alias("blk")), "nodes")
    blocked = written(
        pairs.join(nodes.select(F.col("cid").alias("a"), F.col("blk").alias("ka")), "a").join(nodes.select(F.col("cid").alias("b"), F.col("blk").alias("kb")), "b"),
        "blocked",
    )
    needed = blocked.select("ka", "kb", F.col("a").alias("cid")).union(blocked.select("ka", "kb", F.col("b").alias("cid"))).distinct()
    held = _whole_sets(nodes, base, n).join(needed, "cid").groupBy("ka", "kb").agg(F.collect_set(F.struct("cid", "s")).alias("held"))
    asked = blocked.groupBy("ka", "kb").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    rows = asked.join(held, ["ka", "kb"]).select("asked", F.map_from_entries("held").alias("of"))
    size = lambda k: F.element_at(F.col("of"), k)
    checked = rows.select(
        F.explode(
            F.transform(
                "asked",
                lambda p: F.struct(
                    p["a"].alias("a"), p["b"].alias("b"), F.size(F.array_intersect(size(p["a"]), size(p["b"]))).alias("both"),
                    (F.size(size(p["a"])) + F.size(size(p["b"]))).alias("sum"),
                ),
            )
        ).alias("x")
    ).select("x.*")
    links = written(checked.where(F.col("both") * (num + den) >= num * F.col("sum")).select("a", "b"), "links")
    freed(near, nodes, blocked)
    return links


def drop_similar(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of *docs*, all columns, of which one of each component of linked rows stays: that with the smallest
    doc_id (nulls last, and of rows that tie any one). Rows without words all stay."""
    members, classes, links = linked_classes(docs, n, num, den)
    roots = connected_components(links)
    top = (
        classes.join(roots, F.col("cid") == F.col("node"), "left")
        .select("cid", "m", "low", "n", "f1", "f2", F.coalesce("root", "cid").alias("root"), F.col("root").isNotNull().alias("linked"))
        .where("m > 1 OR linked")
    )
    best = top.groupBy("root").agg(F.min_by("cid", F.struct(F.col("low").isNull(), "low", "cid")).alias("best"), F.min("low").alias("keep"))
    keep = top.join(best, "root").select("n", "f1", "f2", F.when(F.col("cid") == F.col("best"), F.col("keep")).alias("keep"), (F.col("cid") == F.col("best")).alias("is_best"))
    keep = written(keep, "keep")
    marked = members.join(keep, ["n", "f1", "f2"])
    marks = written(marked.select("doc_id", "n", "f1", "f2", (F.col("is_best") & F.col("doc_id").eqNullSafe(F.col("keep"))).alias("stays")), "marks")
    freed(members, classes, links, keep)
    return _keep_rows(docs, marks, n)


def _keep_rows(docs: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """Drops the marked rows that don't stay, found again by doc_id and class; of those that stay and repeat, one does."""
    cols = docs.columns
    id_, f_, m_, hash_, nth = unused(cols, "__id", "__f1", "__m", "__f", "__nth")
    name = [F.col("doc_id").alias(id_), F.col("f1").alias(f_)]
    gone = written(marked.where(~F.col("stays")).select(*name).distinct(), "gone")
    twice = written(marked.where("stays").groupBy(*name).count().where("count > 1").drop("count"), "twice")
    # Most documents are in no mark at all; sets are hashed again only for ids that are.
    ids = few(written(gone.select(F.col(id_).alias(m_)).union(twice.select(id_)).distinct(), "ids"))
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col(m_))
    free = docs.join(ids, same_id, "left_anti")
    bound = docs.join(ids, same_id, "left_semi")
    (w_,) = unused(cols, "__w")
    w, grams = shingle_set(F.col("text").cast("string"), n, w_)
    bound = bound.withColumn(w_, w).withColumn(hash_, F.xxhash64(grams)).select(*cols, hash_)
    hit = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(f_))
    bound = bound.join(few(gone), hit, "left_anti")
    if twice.take(1):
        once = Window.partitionBy("doc_id", hash_).orderBy(F.lit(1))
        one = bound.join(few(twice), hit, "left_semi").withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(nth)
        bound = bound.join(few(twice), hit, "left_anti").unionByName(one)
    return free.unionByName(bound.select(*cols))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all documents at Jaccard similarity 0.9 of their 5-word shingles."""
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE: dict[str, str] = {}
