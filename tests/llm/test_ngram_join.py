import random

import pytest

from maskwright.llm import ngram_join as J

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, base = [], [r.choice(vocab) for _ in range(150)]
    for i in range(150):  # unrelated documents, half with the shared passage
        w = [r.choice(vocab) for _ in range(r.randint(1, 200))]
        rows.append(w + passage if i % 2 else w)
    for i in range(80):  # a large family of near copies, some alike but in case or white space
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows += [w, [x.upper() for x in w]] if i % 9 == 0 else [w]
    for k in range(0, 12):
        rows += [[f"s{i}" for i in range(k)], [f"s{i}" for i in range(k + 1)]]
    out = [(i, " \n"[i % 2].join(w)) for i, w in enumerate(rows)]
    out += [(9001, None), (9002, ""), (9003, " \t\n"), (None, "a b c"), (9004, "A b C"), (9004, "A b C"), (9005, "Éa b c d e"), (9006, "éa b c d e")]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    return sorted([tuple(x) for x in J.similar_documents(df).collect()], key=str)


@pytest.mark.parametrize("late,block", [(32, 1 << 17), (3, 500)])
def test_equals_brute_force(spark, monkeypatch, late, block):
    monkeypatch.setattr(J, "LATE", late)
    monkeypatch.setattr(J, "BLOCK_GRAMS", block)
    rows = corpus()
    assert run(spark, rows) == brute.similar(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_drop_similar_keeps_one_of_each_component(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(d, t, "en", "s", 1, 5) for d, t in rows], SCHEMA + ", n int")
    kept = J.drop_similar(df)
    assert kept.columns == df.columns
    got = sorted((x.doc_id, x.text) for x in kept.collect() if x.doc_id is not None)
    want = brute.similar(rows)
    assert sorted({d for d, _ in got}) == sorted({c if n else d for d, n, _, c in want if d is not None})
    assert len(got) == len(set(got)) and not any(x.doc_id is None for x in kept.collect())
