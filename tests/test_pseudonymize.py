import pytest
from pyspark.sql import functions as F

from maskwright.functions import keys
from maskwright.functions.detectors import Detector, build_detectors, person_detector
from maskwright.operators import mapping as M
from maskwright.operators.pseudonymize import pseudonymize, report, restore

SECRET = keys.Secret("00112233445566778899aabbccddeeff" * 2)

TOKENS = {
    "max.mueller@firma.de": "9f4b5081", "+49 40 123456-78": "66fd7fd5", "@eva.schmidt": "0da61607", "[~accountid:5b10ac8d82e05b22cc7d4ef5]": "7265f538",
    "Alpha GmbH": "5cd3e8f0", "support@alpha.de": "842ef308", "klaus.mueller@firma.de": "82cb864a", "+49 40 12345-678": "82a497e1", "eva.schmidt@firma.de": "b98ba497",
    "+49 40 99999-111": "b7193c82", "max@firma.de": "061fa5e7", "@hans.mueller": "38d23f47", "peter@example.com": "035e72fe", "hans@firma.de": "82e73bd5",
}


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def run(spark, *texts, **options):
    r = pseudonymize(docs(spark, *texts), SECRET, **options)
    return [x.text for x in r.documents.orderBy("doc_id").collect()], r


def test_tokens_are_those_of_the_key(spark):
    assert {v: keys.full_token(SECRET, v)[:8] for v in TOKENS} == TOKENS
    d = M.with_pads(spark.createDataFrame([(v,) for v in TOKENS], "v string"), SECRET)
    assert {r.v: r.t[:8] for r in d.select("v", M.hmac_hex(F.col("v"), F.col("__ipad"), F.col("__opad")).alias("t")).collect()} == TOKENS


def test_mixed_entities(spark):
    text = (
        "Sehr geehrte Damen und Herren,\nbitte wenden Sie sich an max.mueller@firma.de oder +49 40 123456-78.\n"
        "Bei Rückfragen cc @eva.schmidt oder [~accountid:5b10ac8d82e05b22cc7d4ef5].\nMit freundlichen Grüßen\n"
    )
    want = (
        "Sehr geehrte Damen und Herren,\nbitte wenden Sie sich an [[EMAIL_9f4b5081]] oder [[PHONE_66fd7fd5]].\n"
        "Bei Rückfragen cc [[HANDLE_0da61607]] oder [[HANDLE_7265f538]].\nMit freundlichen Grüßen\n"
    )
    (got, nothing), r = run(spark, text, None)
    assert got == want and nothing is None
    # a second pass changes nothing, and the mapping brings the text back
    again = pseudonymize(r.documents.drop("replaced"), SECRET)
    assert again.documents.orderBy("doc_id").first().text == want and again.mapping.count() == 0
    assert restore(r.documents, r.mapping).orderBy("doc_id").first().text == text
    assert [x.n_replaced for x in report(r.documents, "doc_id").orderBy("doc_id").collect()] == [4, 0]


def test_terms_and_overlaps(spark):
    (a, b), _ = run(spark, "Unser Kunde Alpha GmbH hat einen Bug gemeldet bei support@alpha.de", "ping @max@firma.de bitte", detectors=build_detectors(["Alpha GmbH", "Alpha"]))
    assert a == "Unser Kunde [[TERM_5cd3e8f0]] hat einen Bug gemeldet bei [[EMAIL_842ef308]]"
    assert b == "ping @[[EMAIL_061fa5e7]] bitte"


def test_many_terms_use_an_automaton(spark):
    terms = [f"Kunde{i:04d}" for i in range(1100)]
    detectors = build_detectors(terms)
    assert detectors[-1].python is not None
    (a,), _ = run(spark, "Kunde0003 und Kunde1099x", detectors=detectors)
    assert a.count("[[TERM_") == 2


def test_persons_by_an_injected_model(spark):
    def model():
        def predict(text):
            at = text.find("Eva Schmidt")
            return [(at, at + 11, 0.9), (-1, 3, 0.9), (5, 5, 0.9), (0, 999, 0.9), (0, 3, 0.1)]

        return predict

    (a, b), _ = run(spark, "Mit Eva Schmidt", "  ", detectors=build_detectors(person=person_detector(model)))
    assert a.startswith("Mit [[PERSON_") and b == "  "


def test_sequential_tokens(spark):
    (a, b), r = run(spark, "a@b.de c@d.de a@b.de @eva.schmidt", "c@d.de", sequential=True)
    assert a == "[[EMAIL_1]] [[EMAIL_2]] [[EMAIL_1]] [[HANDLE_1]]" and b == "[[EMAIL_1]]"
    assert [x.text for x in restore(r.documents, r.mapping).orderBy("doc_id").collect()] == ["a@b.de c@d.de a@b.de @eva.schmidt", "c@d.de"]
    next_ = pseudonymize(docs(spark, "c@d.de x@y.de"), SECRET, mapping=r.mapping, sequential=True)
    assert next_.documents.first().text == "[[EMAIL_2]] [[EMAIL_3]]"
    assert {(x.scope, x.entity_type): x.last for x in M.last_numbers(next_.mapping).collect()}[("0", "EMAIL")] == 3


def test_collisions_count_on_and_old_tokens_stay(spark):
    values = [(f"v{i}", "TERM", i) for i in range(40)]
    v = spark.createDataFrame(values, "original string, entity_type string, seen int")
    first = M.allocate(v.where("seen < 20"), SECRET, digits=1)
    both = M.allocate(v, SECRET, first, digits=1)
    old, new = {x.original: x.token for x in first.collect()}, {x.original: x.token for x in both.collect()}
    assert len(new) == 40 == len(set(new.values())) and all(new[o] == t for o, t in old.items())
    want: dict[str, int] = {}
    for o, _, _ in values:
        h = keys.full_token(SECRET, o)[0]
        want[h] = want.get(h, 0) + 1
        assert new[o] == (h if want[h] == 1 else f"{h}-{want[h]}")
    texts = ["t " + " ".join(f"v{i}@x.de" for i in range(60))]
    (a,), r = run(spark, *texts, digits=1)
    assert a.count("-") > 30 and restore(r.documents, r.mapping).first().text == texts[0]


def test_short_tokens_are_counted_without_bound(spark):
    v = spark.createDataFrame([("new", "TERM", 0)], "original string, entity_type string, seen int")
    h = keys.full_token(SECRET, "new")
    held = lambda n: spark.createDataFrame([("hmac", None, f"{h[:n]}-{M.MOST_COLLISIONS}", "old", "TERM")], M.SCHEMA)
    tokens = {x.original: x.token for x in M.allocate(v, SECRET, held(1), digits=1).collect()}
    assert tokens["new"] == f"{h[0]}-{M.MOST_COLLISIONS + 1}"
    with pytest.raises(Exception, match="too many values share a token"):  # so many whole tokens can only be a broken mapping
        M.allocate(v, SECRET, held(M.DIGITS)).collect()


def test_restore_leaves_unknown_tokens(spark):
    m = spark.createDataFrame([("hmac", None, "abcdef12", "one", "TERM"), ("hmac", None, "abcdef12-2", "two", "TERM")], M.SCHEMA)
    (a,) = restore(docs(spark, "[[PERSON_deadbeef]] [[TERM_abcdef12]] [[X_abcdef12-2]] [[bad]]"), m).collect()
    assert a.text == "[[PERSON_deadbeef]] one two [[bad]]"


def test_restore_by_join_equals_restore_by_map(spark, monkeypatch):
    from maskwright.operators import pseudonymize as P

    _, r = run(spark, "a@b.de, c@d.de", None, "plain", "x@y.de")
    want = sorted(map(str, restore(r.documents, r.mapping).select("doc_id", "text").collect()))
    monkeypatch.setattr(P, "FEW_ENTRIES", 0)
    assert sorted(map(str, P.restore(r.documents, r.mapping).select("doc_id", "text").collect())) == want


def test_merge_keeps_old_entries(spark):
    old = spark.createDataFrame([("hmac", None, "a", "one", "TERM")], M.SCHEMA)
    new = spark.createDataFrame([("hmac", None, "a", "other", "TERM"), ("hmac", None, "b", "two", "EMAIL")], M.SCHEMA)
    m = M.merge(old, new)
    assert [(x.token, x.original) for x in M.inspect(m).collect()] == [("a", "one"), ("b", "two")]
    assert [x.token for x in M.tokens_by_type(m, "EMAIL").collect()] == ["b"]


@pytest.mark.parametrize("bad", ["", "00", "g" * 64, "0" * 63])
def test_bad_secrets(bad):
    with pytest.raises(keys.InvalidKeyError):
        keys.Secret(bad)


def test_secrets_ignore_blanks_and_hide(tmp_path, monkeypatch):
    s = keys.Secret("\ufeff" + "00112233 445566778899aabbccddeeff\u200b\n" * 2)
    assert s == SECRET and SECRET.hex not in repr(s)
    f = keys.init_key(tmp_path / "k")
    assert f.stat().st_mode & 0o777 == 0o600 and keys.load_key(f).raw
    with pytest.raises(FileExistsError):
        keys.init_key(f)
    with pytest.raises(keys.KeyNotFoundError):
        keys.load_key(tmp_path / "none")
    monkeypatch.setenv(keys.ENV, SECRET.hex)
    assert keys.load_key() == SECRET


def test_key_is_not_in_the_plan(spark):
    r = pseudonymize(docs(spark, "a@b.de"), SECRET)
    plan = r.documents._jdf.queryExecution().toString()
    assert all(p.hex()[:32] not in plan.lower() for p in keys.token_pads(SECRET))


def test_detectors_have_names_and_types():
    assert [(d.name, d.entity_type, d.priority) for d in build_detectors(["x"])] == [("email", "EMAIL", 100), ("phone", "PHONE", 90), ("handle", "HANDLE", 80), ("denylist", "TERM", 70)]
    assert isinstance(build_detectors()[0], Detector)
