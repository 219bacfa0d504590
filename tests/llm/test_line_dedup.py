import random

import pytest
from pyspark.sql import functions as F

from maskwright.llm import common
from maskwright.llm import line_dedup as L

from . import brute


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    pool = [[r.choice(vocab) for _ in range(r.randint(1, 14))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(pool))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k = r.randrange(len(w))
                what = r.randrange(3)
                if what == 0:
                    w[k] = r.choice(vocab)
                elif what == 1:
                    w.insert(k, r.choice(vocab))
                elif len(w) > 1:
                    del w[k]
            lines.append(r.choice((" ", "  ")).join(x.upper() if r.random() < 0.1 else x for x in w))
            if r.random() < 0.2:
                lines.append(r.choice(("", " \t")))
        rows.append((d, "\n".join(lines)))
    return rows + [(None, "a b c d e\nA b c d e x"), (200, None), (201, ""), (202, "a b c d e"), (203, "é b c d e f"), (204, "É b c d e g"), (204, "É b c d e g")]


def test_equals_brute_force(spark):
    rows = corpus()
    got = {(x.doc_id, x.line) for x in L.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.gone_lines(rows)


def test_cleaned_documents_keep_columns_and_rows(spark):
    rows = [(1, "x y z a b\nkeep", "en"), (2, "x y z a c\n\nother", "de"), (3, None, None)]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, line string"))
    assert out.columns == ["doc_id", "text", "line"]
    assert sorted((x.doc_id, x.text) for x in out.collect()) == [(1, "x y z a b\nkeep"), (2, "\nother"), (3, None)]


def test_no_rows(spark):
    assert L.near_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def gone_within(rows, bound):
    """As brute.gone_lines, for any bound: an edit for every five words of the shorter line, at most *bound*."""
    lines = sorted(((d is None, d or 0, i), d, i, brute.words(brute.ascii_lower(x))) for d, t in rows for i, x in enumerate((t or "").split("\n")) if brute.words(x))
    near = lambda v, w: v == w or brute.word_distance(v, w) <= min(bound, min(len(v), len(w)) // L.LEAST_WORDS)
    return {(d, i) for k, (at, d, i, w) in enumerate(lines) if any(x[0] < at and near(x[3], w) for x in lines[:k])}


@pytest.mark.parametrize("bound,few", [(1, 3), (2, 1), (2, 64), (3, 3)])
def test_any_bound_equals_brute_force(spark, monkeypatch, bound, few):
    monkeypatch.setattr(L, "FEW_LINES", few)
    monkeypatch.setattr(L, "FEW_OF_SQUARE", 0.0)
    rows = [(d, t) for d, t in corpus() if d is not None]
    got = {(x.doc_id, x.line) for x in L.near_lines(spark.createDataFrame(rows, "doc_id long, text string"), bound).collect()}
    assert got == gone_within(rows, bound)


def test_long_line_with_two_edits_goes_in_production(spark, tmp_path):
    w = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(w)), (2, " ".join("x" if i in (7, 31) else x for i, x in enumerate(w))), (3, " ".join(w[:20] + ["x"] + w[20:40] + w[41:])), (4, " ".join("x" if i in (7, 20, 31) else x for i, x in enumerate(w)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id: x.n_gone for x in L.op6_line_dedup(spark, str(tmp_path)).select("doc_id", F.col("n_gone")).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}


def test_only_the_result_stays_on_the_disk(spark):
    had = len(common._written)
    L.near_lines(spark.createDataFrame(corpus(), "doc_id long, text string"), 2)
    assert len(common._written) == had + 1


def test_variants_of_a_single_line_are_left_out(spark):
    texts = [(1, "a b c d e f g h i j"), (2, "a b c d e x g h i j"), (3, "k l m n o p q r s t"), (None, "k l m n o p q r s u"), (5, "0 1 2 3 4 5 6 7 8 9")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    h = F.transform(F.split("text", " "), lambda x: F.xxhash64(x))
    likely = docs.select("doc_id", F.lit(0).alias("line"), F.xxhash64(h).alias("f"), F.xxhash64(F.lit(1), h).alias("f2"))
    got = L._variants(docs, likely, 2).groupBy("at.doc_id").count().collect()
    # Without the word that differs, and without it and any of the other nine.
    assert {x.doc_id: x["count"] for x in got} == {1: 10, 2: 10, 3: 10, None: 10}


def test_words_of_odd_lines(spark):
    text = "\n".join(("a b", " a  b ", "a\tB\x0bc\x0cd\re", "", " ", "\t", "\r", "É Ab", "İI ẞ", "a\u00a0B c", "a ", " a", "\x1c A"))
    got = L._lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    want = {(1, i): brute.words(brute.ascii_lower(x)) for i, x in enumerate(text.split("\n")) if brute.words(x)}
    assert {(x.doc_id, x.line): x.w for x in got} == want


def test_words_are_cut_without_trimming_and_compared_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert " trim(" not in plan(L._lines(docs)) and "(trim(" not in plan(L._lines(docs))
    w = F.split("text", " ")
    # Where the alignment starts, and after each edit.
    assert plan(docs.select(L.within_edits(w, w, F.lit(2), 2).alias("near"))).count("zip_with(") == 2


def test_tables_of_hashes_have_no_dictionaries(spark, monkeypatch):
    made, write = {}, L.written

    def noted(df, name, **options):
        made[name] = options
        return write(df, name, **options)

    monkeypatch.setattr(L, "written", noted)
    L.near_lines(spark.createDataFrame(corpus(), "doc_id long, text string"), 2)
    assert {n for n, o in made.items() if o.get("parquet.enable.dictionary") == "false"} == {"lines", "distinct", "shared", "met"}
