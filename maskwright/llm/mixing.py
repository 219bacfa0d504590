"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are water-filled: sources share the total budget by weight, none above its limit. A target that holds whole
epochs of its source first takes every document that often; the fraction left is drawn without replacement in the
order of exponential keys ``-ln(u) / quality``, u being a hash of the document and quality a weight from its statistics,
whose sizes are prefix-summed to the budget; one more document then closes the gap that whole documents leave. The
prefix sum is never one task's work: keys are first summed per source in fine logarithmic bins, and only the bin in
which the budget is crossed is sorted. What comes of it is a row per source: the last key taken and the document that
closes the gap. From that row every document's copies are computed where its text is; texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, freed, table, written
from .quality_rules import text_statistics

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
#: Bins to a doubling of the key; one holds about 1/10,000 of a source.
KEY_BINS = 4096
SEED = "mix-1"
#: A document's least sampling weight.
LEAST_QUALITY = 0.01


def quality_weight() -> Column:
    """A document's sampling weight in (0, 1], over the columns of text_statistics: what share of its words isn't in
    repeated windows, times what share isn't matched by a symbol, by its lines that repeat an earlier one and itself."""
    n = F.col("n_words")
    w = (1 - F.col("n_repeat_words") / n) * (1 - F.least(F.lit(1.0), F.col("n_symbols") / n)) / (1 + F.col("n_dup_lines"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_QUALITY), w))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> and target: sources in code-point order, null last, weigh *weights* in turn and split
    share * total; none gets more than limit * its size, what is over being shared again among the others.

    With sources sorted by size/weight, those that stop at the limit are the first few, so one running sum finds the
    level at which the rest share. Sources have a row each; their number, not the corpus, is what one task sorts.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(limit))
    every = Window.partitionBy(F.lit(0))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The level at which the first source that isn't capped shares; beyond the last, all are capped.
    s = s.withColumn("at", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at.level") * F.col("w"))).alias("target"))


def _keyed(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """*more*, source, size, bin and id (key, doc_id and hash, by which rows are ordered) of each row."""
    hash_ = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = text_statistics(docs, *more, hash_.alias("mark"))
    u = (F.shiftrightunsigned("mark", 11) + 0.5) / float(1 << 53)
    d = d.withColumn("key", -F.log(u) / quality_weight())
    id_ = F.struct("key", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "mark")
    bin_ = F.floor(F.log2("key") * KEY_BINS).cast("int")
    return d.select(*(c for c in d.columns if c in ("row", "doc_id")), "source", F.col("n_words").alias("size"), bin_.alias("bin"), id_.alias("id"))


def _per_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.join(b.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def _plan(d: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """A row per source of the written table *d*: source, source_size, target, epochs, left (the budget beyond whole
    epochs), edge (the bin that crosses it), cut (the last id taken in it), n_cut (how many rows of that id are), fill
    (the id that closes the gap), fill_nth (which of its rows), ties (whether cut or fill is an id of several rows)."""
    per = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    per = per.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = written(per.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    over = Window.partitionBy("source").orderBy("bin")
    sums = d.where("size > 0").groupBy("source", "bin").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(over))
    crossed = _per_source(sums, per.select("source", "left")).where("upto > left").groupBy("source").agg(F.min(F.struct("bin", "upto", "s")).alias("c"))
    edge = written(crossed.select("source", F.col("c.bin").alias("edge"), (F.col("c.upto") - F.col("c.s")).alias("before")), "edges")
    inside = _per_source(_per_source(d.where("size > 0"), few(edge)).where("bin = edge"), per.select("source", "left"))
    run = Window.partitionBy("source").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("more", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") <= F.col("left"))
    top = inside.where("more").groupBy("source").agg(F.max_by("id", "id").alias("cut"), F.sum("size").alias("in_edge"))
    cut = written(_per_source(_per_source(edge, top, "left").select("source", "edge", "before", "cut", "in_edge"), per.select("source", "left")), "cut")
    # A source's budget that no bin crosses is what all its documents make.
    open_ = _per_source(d.where("size > 0"), few(cut)).where((F.col("bin") > F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("cut").isNull() | (F.col("id") >= F.col("cut")))))
    gap = F.col("left") - F.col("before") - F.coalesce("in_edge", F.lit(0))
    miss = F.abs(gap - F.col("size"))
    nearest = open_.where((gap > 0) & (miss < gap)).where(F.col("cut").isNull() | (F.col("id") > F.col("cut"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "id")).alias("f"))
    fill = nearest.select("source", F.col("f.id").alias("fill"))
    n_cut = inside.where("more").join(top.select("cut"), F.col("id") == F.col("cut"), "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    out = written(_per_source(_per_source(_per_source(per, cut.select("source", "edge", "cut"), "left"), fill, "left"), n_cut, "left"), "plan")
    marks = out.select("source", F.explode(F.array("cut", "fill")).alias("mark")).where("mark IS NOT NULL")
    tied = d.join(few(marks.select("mark")), F.col("id") == F.col("mark"), "left_semi").groupBy("source", "id").count().where("count > 1").select("source").distinct()
    done = written(_per_source(out, tied.withColumn("ties", F.lit(True)), "left").withColumn("ties", F.coalesce("ties", F.lit(False))), "plan")
    freed(per, edge, cut, out)
    return done


def _with_copies(d: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies. Rows of one id among which the cut falls are numbered; no others are moved."""
    d = _per_source(d, few(plan))
    at_cut, at_fill = (F.coalesce(F.col("id") == F.col(c), F.lit(False)) for c in ("cut", "fill"))
    below = F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & F.coalesce(F.col("id") < F.col("cut"), F.lit(False)))
    more = (F.col("size") > 0) & (F.col("left") > 0) & below
    kept = [c for c in d.columns if c in ("row", "doc_id", "source", "size", "source_size", "target")]
    out = lambda x, extra: x.select(*kept, (F.col("epochs") + extra.cast("long")).alias("copies"))
    one = out(d.where(~(F.col("ties") & (at_cut | at_fill))), more | at_cut | at_fill)
    if not plan.where("ties").take(1):
        return one
    nth = F.row_number().over(Window.partitionBy("source", "id").orderBy(F.lit(1)))
    tied = d.where(F.col("ties") & (at_cut | at_fill)).withColumn("nth", nth)
    return one.unionByName(out(tied, (at_cut & (F.col("nth") <= F.col("n_cut"))) | (at_fill & (F.col("nth") == 1))))


def copies(docs: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of *docs*, where taken = copies * size.

    Reruns over the same rows agree: a key depends on seed, doc_id and text alone; rows that tie in all of these are
    taken in an order of their own that changes no sum. Null sources form one source; documents without words are taken
    with whole epochs only. No rows in, no rows out.
    """
    d = written(_keyed(docs, seed), "keys")
    done = _with_copies(d, _plan(d, weights, share, limit))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The rows of *docs*, all columns, each as often as the mix takes it."""
    d = written(_keyed(docs, seed), "keys")
    plan = _plan(d, weights, share, limit)
    freed(d)
    done = _with_copies(_keyed(docs, seed, F.struct(*docs.columns).alias("row")), plan)
    return done.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
