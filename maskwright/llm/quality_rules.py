"""Quality rules: fixed limits, then robust multivariate outliers.

Each document's statistics are transformed to a vector; per language and source the minimum-covariance-determinant
estimate (deterministic starts, concentration steps until none lowers the determinant, one reweighting) gives a centre
and a covariance that junk can't shift, and documents whose squared Mahalanobis distance exceeds a chi-square quantile
are rejected. Rates and shares have their variance stabilised by square roots and arcsines; the sampling variance, 1/4n,
that they have at least in a document of n words is added to the covariance, at the least n that the fixed limits
pass, so that a statistic which is constant in a group doesn't reject a single deviation. Only DataFrame operations
are used: a concentration step is two grouped aggregations, in which the h-th smallest distance is found from a fine
histogram of log-distances, and covariance factors are computed as columns of a table with a row per group and start.
No group is ever collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, freed, table, words, written

MIN_WORDS, MAX_REPEATED = 50, 50
#: Share of a group's rows that the covariance of least determinant is sought for.
COVERAGE = 0.75
#: Concentration steps at most; a start's end once one doesn't lower the determinant's logarithm by SETTLED.
STEPS, SETTLED = 60, 1e-6
#: Groups of fewer rows are judged by the estimate of all rows of their language, or of all rows if these are few too.
LEAST_ROWS = 60
#: Chance that a document of a normally distributed group lies beyond the cut.
TAIL = 1e-6
#: Variances added to those estimated: what a variance-stabilised share of MIN_WORDS words has by chance, and a trifle.
SAMPLING, RIDGE = 1 / (4 * MIN_WORDS), 1e-6
FLOORS = {"x1": RIDGE, "x2": RIDGE, "x3": SAMPLING, "x4": SAMPLING, "x5": SAMPLING}
X = list(FLOORS)
P = len(X)
LOW = [(i, j) for i in range(P) for j in range(i + 1)]
#: Histogram bins to a doubling of the distance: those of the h-th distance are told apart to 0.07 %.
BINS = 1024
#: Groups (about 300 bytes each) up to which their parameters are broadcast.
FEW_GROUPS = 20_000


def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function at (k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail by continued fraction (Lentz), accurate for small tails."""
    a, z = k / 2, x / 2
    if z < a + 1:
        return 1 - chi2_cdf(x, k)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def chi2_upper(tail: float, k: float) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, k) > tail else (lo, mid)
    return hi


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the innermost *share* of a normal sample consistent."""
    return share / chi2_cdf(chi2_upper(1 - share, P), P + 2)


def text_statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row, and
    *more* columns, named row or mark.

    Null texts count as empty, with no words. Windows of three words are told apart by 64-bit hashes.
    """
    d = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    carried = [c for c in d.columns if c not in ("t", "w")]
    d = d.select(
        *carried, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("l"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    rest = lambda k: F.slice("h", k, F.size("h") + 1)
    pairs = F.zip_with("h", rest(2), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, rest(3), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("h") - 2, F.lit(0)))
    kept = [c for c in d.columns if c not in ("l", "h")]
    d = d.select(*kept, (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("g"))
    some = F.size(F.array_distinct("g")) < F.size("g")
    d = d.select(*kept, "n_dup_lines", F.when(some, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("s"))
    twin = lambda x, i, k: x["h"] == F.get("s", i + k)["h"]
    at = F.sort_array(F.transform(F.filter("s", lambda x, i: twin(x, i, -1) | twin(x, i, 1)), lambda x: x["p"]))
    d = d.select(*kept, "n_dup_lines", at.alias("at"))
    gaps = F.zip_with("at", F.slice("at", 2, F.size("at") + 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return d.select(*kept, "n_dup_lines", covered.alias("n_repeat_words")).withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """The transformed statistics of a document with words."""
    n = F.col("n_words")
    return [
        F.log(n).alias("x1"), F.log(F.col("word_chars") / n).alias("x2"), F.sqrt(F.col("n_symbols") / n).alias("x3"),
        F.asin(F.sqrt(F.col("n_repeat_words") / n)).alias("x4"), F.sqrt(F.col("n_dup_lines") / n).alias("x5"),
    ]


def _language(rest: Column | None = None) -> Column:
    """A name of a row's language and of what follows; the length in it keeps names apart."""
    lang = F.coalesce(F.concat(F.length("lang").cast("string"), F.lit(":"), "lang"), F.lit("-"))
    return F.concat(lang, F.lit("/*") if rest is None else rest)


def _own() -> Column:
    """The name of a row's language and source."""
    return _language(F.coalesce(F.concat(F.lit("/="), "source"), F.lit("/-")))


ALL_ROWS = "*"


def _levels(v: DataFrame) -> DataFrame:
    """own, grp: by whose estimate each language and source is judged; a written table of a row per pair."""
    sizes = v.groupBy("own", "lg").count()
    per = sizes.withColumn("k", F.sum("count").over(Window.partitionBy("lg")))
    level = F.when(F.col("count") >= LEAST_ROWS, F.col("own")).when(F.col("k") >= LEAST_ROWS, F.col("lg")).otherwise(ALL_ROWS)
    return written(per.select("own", level.alias("grp")), "levels")


def _sums(weight: str = "1D", *more: str) -> list[Column]:
    """Weighted moments about the centre m, by which sums stay small. As SQL, which takes one call each."""
    of = [f"({x} - m[{i}])" for i, x in enumerate(X)]
    terms = {"w": "1D"} | {f"s_{i}": of[i] for i in range(P)} | {f"q_{i}{j}": f"{of[i]} * {of[j]}" for i, j in LOW}
    return [F.expr(f"sum({weight} * {t}) AS {name}") for name, t in terms.items()] + [F.expr(f"first({c}) AS {c}") for c in ("m", *more)]


def _fitted(moments: DataFrame, keys: list[str], scale: float = 1.0, diagonal: bool = False) -> DataFrame:
    """keys, m (centre), u (the inverse of the Cholesky factor of the covariance, row by row), det (its log-determinant).
    The covariance is *scale* times that of the moments, and FLOORS on the diagonal."""
    c = {f"c_{i}{j}": "0D" if diagonal and i != j else f"{scale!r}D * (q_{i}{j} / w - s_{i} * s_{j} / (w * w)) + {FLOORS[X[i]] if i == j else 0.0!r}D" for i, j in LOW}
    for j in range(P):
        c[f"l_{j}{j}"] = f"sqrt(greatest(1e-12D, c_{j}{j}{''.join(f' - l_{j}{k} * l_{j}{k}' for k in range(j))}))"
        c |= {f"l_{i}{j}": f"(c_{i}{j}{''.join(f' - l_{i}{k} * l_{j}{k}' for k in range(j))}) / l_{j}{j}" for i in range(j + 1, P)}
    for i in range(P):
        c[f"u_{i}{i}"] = f"1D / l_{i}{i}"
        c |= {f"u_{i}{j}": f"-({' + '.join(f'l_{i}{k} * u_{k}{j}' for k in range(j, i))}) / l_{i}{i}" for j in range(i)}
    centre = ", ".join(f"m[{i}] + s_{i} / w" for i in range(P))
    # Later columns refer to earlier ones of the same list.
    d = moments.where("w > 0").selectExpr(*keys, f"array({centre}) AS centre", *(f"{e} AS {name}" for name, e in c.items()))
    det = " + ".join(f"ln(l_{i}{i})" for i in range(P))
    return d.selectExpr(*keys, "centre AS m", f"array({', '.join(f'u_{i}{j}' for i, j in LOW)}) AS u", f"2 * ({det}) AS det")


def _distance() -> str:
    """Squared Mahalanobis distance of x to the parameters in the same row, as SQL."""
    rows = [" + ".join(f"u[{i * (i + 1) // 2 + j}] * ({X[j]} - m[{j}])" for j in range(i + 1)) for i in range(P)]
    return "(" + " + ".join(f"({r}) * ({r})" for r in rows) + ")"


def _with(v: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Each row with its group's parameters, which are broadcast where their number has been checked."""
    return v.join(F.broadcast(params) if few else params, "grp")


def robust_parameters(v: DataFrame) -> tuple[DataFrame, bool]:
    """grp, m, u per group of a written table (grp, x...), and whether the groups are few.

    Starts: all rows, the variances of all rows, and rows weighted by the inverse of their distance, once and squared.
    """
    v = v.select("grp", *X)
    sizes = written(v.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(x) for x in X)).alias("m")), "sizes")
    few = sizes.count() <= FEW_GROUPS
    moments = written(_with(v, sizes, few).groupBy("grp").agg(*_sums()), "moments")
    plain = written(_fitted(moments, ["grp"]), "plain")
    near = [_fitted(_with(v, plain, few).groupBy("grp").agg(*_sums(f"pow({_distance()} + 1e-3, {-k})")), ["grp"]) for k in (0.5, 1.0)]
    params = plain.withColumn("start", F.lit(0))
    for k, s in enumerate((_fitted(moments, ["grp"], diagonal=True), *near), 1):
        params = params.unionByName(s.withColumn("start", F.lit(k)))
    params = written(params.join(sizes.select("grp", "n"), "grp"), "starts")
    spent, settled, keys = [sizes, moments, plain, params], None, ["grp", "start"]
    bin_ = F.expr(f"CAST(floor(log2({_distance()} + 1e-9) * {BINS}) AS int)")
    per = Window.partitionBy(*keys).orderBy("bin")
    for step in range(STEPS):
        counted = _with(v, params, few).groupBy(*keys, "n", bin_.alias("bin")).count()
        reached = counted.select("*", F.sum("count").over(per).alias("cum")).where(F.col("cum") >= F.col("n") * COVERAGE)
        edged = params.withColumnRenamed("det", "was").join(reached.groupBy(*keys).agg(F.min("bin").alias("edge")), keys)
        inner = _with(v, edged, few).where(bin_ <= F.col("edge"))
        moved = inner.groupBy(*keys, "n", "was").agg(*_sums())
        # The determinant of a start isn't one of h rows, so the first step never ends it.
        moves = F.lit(True) if step == 0 else F.col("was") - F.col("det") > SETTLED
        new = written(_fitted(moved, [*keys, "n", "was"], _consistency(COVERAGE)).withColumn("moves", moves), "step")
        spent.append(new)
        done = new.where(~F.col("moves")).drop("moves", "was")
        settled = done if settled is None else settled.unionByName(done)
        params = new.where("moves").drop("moves", "was")
        if not params.take(1):
            break
    best = settled.unionByName(params).groupBy("grp").agg(F.min_by(F.struct("m", "u"), F.struct("det", "start")).alias("b")).select("grp", "b.*")
    # One reweighting: rows within the 97.5 % ellipsoid of the raw estimate.
    raw = written(best, "raw")
    within = F.expr(f"{_distance()} <= {chi2_upper(0.025, P)!r}D")
    out = written(_fitted(_with(v, raw, few).where(within).groupBy("grp").agg(*_sums()), ["grp"], _consistency(0.975)).drop("det"), "robust")
    freed(*spent, raw)
    return out, few


def _rules(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The statistics of all rows with their vectors, a written table; own, m, u: by what each language and source is
    judged, a written table; and whether that has few rows."""
    stats = text_statistics(docs)
    v = written(stats.select("*", *(F.when(~F.col("base_failed"), c).alias(n) for n, c in zip(X, _vector()))), "statistics")
    good = v.where(~F.col("base_failed")).select(_own().alias("own"), _language().alias("lg"), *X)
    levels = _levels(good)
    few = levels.count() <= FEW_GROUPS
    used = levels.select("grp").distinct()
    every = good.withColumn("grp", F.explode(F.array("own", "lg", F.lit(ALL_ROWS)))).select("grp", *X)
    fitted = written(every.join(F.broadcast(used) if few else used, "grp", "left_semi"), "vectors")
    params, _ = robust_parameters(fitted)
    rules = written(levels.join(params, "grp").select("own", "m", "u"), "rules")
    freed(levels, fitted, params)
    return v, rules, few


def _scored(stats: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """Adds distance (null where base rules fail) and kept to statistics with vectors."""
    own = F.when(~F.col("base_failed"), _own())
    d = stats.withColumn("own", own).join(F.broadcast(rules) if few else rules, "own", "left")
    d = d.withColumn("distance", F.expr(_distance()))
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_upper(TAIL, P))).drop("own", "m", "u", *X)


def judged(docs: DataFrame) -> DataFrame:
    """The columns of text_statistics and distance, kept: one row per row of *docs*.

    A document fails the base rules with fewer than MIN_WORDS words, or if more than MAX_REPEATED per cent of its
    words are in repeated 3-word windows. Others are kept unless they are outliers of their language and source (of
    their language, or of all documents, where there are fewer than LEAST_ROWS); nulls in these form groups of their
    own. Rows that repeat are judged alike. No rows in, no rows out.
    """
    return _scored(*_rules(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of *docs*, all columns, that are kept. Each row's verdict is computed beside its text, from the
    parameters of its group, so texts aren't shuffled (while groups are few) and rows that share a doc_id are judged apart."""
    v, rules, few = _rules(docs)
    freed(v)
    stats = text_statistics(docs, F.struct(*docs.columns).alias("row"))
    # A column that isn't deterministic keeps the filter from being pushed into the statistics, which it would multiply.
    fence = F.monotonically_increasing_id().alias("fence")
    stats = stats.select("*", *(F.when(~F.col("base_failed"), c).alias(n) for n, c in zip(X, _vector())), fence)
    return _scored(stats, rules, few).where("kept AND fence >= 0").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict on every document."""
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
