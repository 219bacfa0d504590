import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions import spans as S


def found(spark, fn, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = d.select("i", "t", fn(F.col("t")).alias("s")).orderBy("i").collect()
    for r in rows:
        assert all(r.t[x.start : x.end] == x.text for x in r.s)
    return [[x.text for x in r.s] for r in rows]


def test_emails(spark):
    got = found(
        spark, D.email_spans, "a@b.de, c@d.de sowie eva.schmidt+filter@example.co.uk", "mail@über.de", "𝒳 x a@b.de é@b.de mu\u0308ller@x.de", "a..b@c.de a.@c.de a@-b.de a@b.test a@localhost",
        "x" * 65 + "@b.de", "ende a@b.de. und a@b.c",
    )
    assert got == [["a@b.de", "c@d.de", "eva.schmidt+filter@example.co.uk"], [], ["a@b.de", "ller@x.de"], [], [], ["a@b.de"]]


def test_handles(spark):
    got = found(
        spark, D.handle_spans, "@eva.schmidt [~accountid:557058:F58131CB-1234] [~eva.s]", "@Override @Component @Deprecated @pytest.fixture @pytest.mark.parametrize",
        "@types/node @123abc user@firma.de", "@ab @abc- @abc.",
    )
    assert got == [["@eva.schmidt", "[~accountid:557058:F58131CB-1234]", "[~eva.s]"], [], [], ["@abc-", "@abc."]]


def test_phones(spark):
    got = found(
        spark, D.phone_spans, "+49 40 123456-78 oder 040 123456", "+1 (310) 555-6503 +1 (499) 555-6503 +1 211 555 6503", "1234567890123456 192.168.10.20 2024-01-02", "+999 123456789 +41 44 668 18 00 +33 1 42 68 53 00",
    )
    assert got == [["+49 40 123456-78", "040 123456"], ["+1 (310) 555-6503"], [], ["+41 44 668 18 00", "+33 1 42 68 53 00"]]
    with pytest.raises(ValueError):
        D.phone_spans(F.col("t"), "XX")


def test_terms(spark):
    fn = lambda t: D.term_spans(t, ["a.b.c", "some+thing", "Alpha", "Alpha GmbH", "", "x\\E|y", "e\u0301t"])
    assert found(spark, fn, "a.b.c axbxc some+thing alpha Alpha GmbH", "x\\E|y é\u0074 Alpha Alpha") == [["a.b.c", "some+thing", "Alpha GmbH"], ["x\\E|y", "ét", "Alpha", "Alpha"]]


def test_composed_offsets():
    text = "ab\u0308c e\u0301"
    c, at = D.composed(text)
    assert c == "ab\u0308c \u00e9" and [text[a:b] for a, b in zip(at, at[1:])][-1] == "e\u0301"


def plain_resolve(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[2], s[0], s[3])):
        if all(not (s[0] < o[1] and o[0] < s[1]) for o in out):
            out.append(s)
    return sorted(out)


def test_resolver_is_greedy(spark):
    r = random.Random(5)
    sets = []
    for _ in range(300):
        spans = []
        for k in range(r.randint(0, 8)):
            a = r.randint(0, 20)
            spans.append((a, a + r.randint(1, 9), r.choice((10, 70, 100)), f"d{k % 3}"))
        sets.append(spans)
    rows = [(i, [(a, b, "", "TERM", d, p) for a, b, p, d in spans]) for i, spans in enumerate(sets)]
    d = spark.createDataFrame(rows, f"i int, s {S.SPANS}")
    for x in d.select("i", S.resolve(F.col("s")).alias("s")).collect():
        got = sorted((y.start, y.end, y.priority) for y in x.s)
        assert got == [s[:3] for s in plain_resolve(sets[x.i])]
        assert [y.start for y in x.s] == sorted(y.start for y in x.s)


def test_own_tokens_and_substitution(spark):
    d = spark.createDataFrame([("x [[EMAIL_9f4b5081]] y [[PERSON_12]] [[TERM_ab-2]] [[bad_X]]",)], "t string")
    s = S.own_tokens(F.col("t"))
    row = d.select(s.alias("s"), S.substitute(F.col("t"), s, F.transform(s, lambda _: F.lit("#"))).alias("r")).first()
    assert [x.text for x in row.s] == ["[[EMAIL_9f4b5081]]", "[[PERSON_12]]", "[[TERM_ab-2]]"] and row.r == "x # y # # [[bad_X]]"


def test_word_class_matches_letters_and_numbers():
    assert re.search(r"\\p\{L\}", S.WORD)
