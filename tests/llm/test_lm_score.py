import math
import random

import numpy as np
import pytest

from maskwright.llm import lm_score as L

from . import brute


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["É", "the", "The"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(60)]
    return rows + [(7, rows[7][1]), (None, "the\tthe\nthe"), (100, None), (101, ""), (102, "nowhereelse"), (103, "a b a b")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(L, "BATCH_BYTES", 1500)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_words, round(x.log_score, 6)) for x in L.stupid_backoff(df, order).collect()), key=str)
    want = brute.backoff_scores([t for _, t in rows], order, L.BACKOFF)
    assert got == sorted(((d, n, round(s, 6)) for (d, _), (n, s) in zip(rows, want)), key=str)


def test_no_rows_and_a_single_row(spark):
    assert L.stupid_backoff(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    x = L.stupid_backoff(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert x.n_unseen == 2 and x.log_score == pytest.approx(math.log(0.4))


def test_codes_round_trip():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    c = r.integers(1, 300, len(h))
    for n in (1, 2, len(h)):
        x, y = L.unpack(L.pack(h[:n], c[:n]))
        assert (x == h[:n]).all() and (y == c[:n]).all()


def test_production_tells_the_order_of_words(spark, tmp_path):
    texts = ["a b c", "x b d", "a b c", "a b d"]  # the last has only pairs that others have
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.log_score for x in L.op1_lm_score(spark, str(tmp_path)).collect()}
    want = brute.backoff_scores(texts, 3, L.BACKOFF)
    assert got == pytest.approx({i: s for i, (_, s) in enumerate(want)})
    assert got[3] != pytest.approx(brute.backoff_scores(texts, 2, L.BACKOFF)[3][1])


def test_codes_are_near_the_shortest():
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 1 << 57, 18000, dtype=np.uint64))  # a batch's part of 128 partitions
    c = np.where(r.random(len(h)) < 0.1, 2, 1)
    assert len(L.pack(h, c)) < 6 * len(h)  # log2(2^57 / 18000) + 1.44 bits each at least, and 0.5 of counts
    assert (L.unpack(L.pack(h, c))[1] == c).all()
