"""Operators that have no SQL, against brute force, exact round trips and planted cases."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import exact_dedup, html_text, mixing, packing, pii, quality_rules, registry, token_output, tokens

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, SCHEMA + more)


def prose(seed, n=300):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti") for b in ("na", "ri", "sta", "vel", "m", "")]
    return [(i, " ".join(r.choice(vocab) for _ in range(int(r.lognormvariate(5, 0.5)) + 55)), "en", f"s{i % 3}", 0) for i in range(n)]


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


# exact dedup


def test_exact_groups(spark):
    rows = [(i, ("Same Text" if i % 3 else f"t{i % 50}"), None, None, None) for i in range(400)] + [(None, "same text", "x", "y", 1), (7, None, "", "", 0), (8, "", "", "", 0), (9, "É", "", "", 0), (10, "é", "", "", 0), (11, "dup", "", "", 0), (11, "dup", "", "", 0)]
    for counters in (1, 4, 1024):
        got = exact_dedup.exact_groups(table(spark, rows), counters).collect()
        by = {}
        for d, t, *_ in rows:
            by.setdefault(brute.ascii_lower(t or ""), []).append(d)
        want = sorted((str(d), str(max((x for x in by[brute.ascii_lower(t or "")] if x is not None))), len(by[brute.ascii_lower(t or "")])) for d, t, *_ in rows)
        assert sorted((str(x.doc_id), str(x.keep_id), x.group_size) for x in got) == want
        assert sum(x.kept for x in got) == len(by)
    kept = exact_dedup.drop_exact_copies(table(spark, [(*r, 1) for r in rows], ", digest int"))
    assert kept.columns[-1] == "digest" and kept.count() == len(by)
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_misra_gries_finds_the_frequent(spark):
    items = spark.createDataFrame([(bytearray(str(0 if i % 3 == 0 else i).encode()),) for i in range(3000)], "x binary").repartition(7)
    found = {bytes(r.item): r.low for r in exact_dedup.misra_gries(items, "x", 5).collect()}
    assert 0 < found[b"0"] <= 1000 and len(found) <= 5


# quality rules


def windows(w):
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_statistics_equal_brute_force(spark):
    texts = ["a b c a b c d", "", None, " \n\t", "x\nx\n\nx \nX", "a a a a a", "é #b $c|d <e>\x0bf", "a b", "one two three four " * 40, "l1\nl1\n  \n  \nl2"]
    got = {x.doc_id: x for x in quality_rules.text_statistics(table(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        x = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), windows(w))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 50 or 100 * windows(w) > 50 * len(w))


def test_chi_square_quantiles():
    assert quality_rules.chi2_upper(0.05, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_rules.chi2_upper(0.025, 1) == pytest.approx(5.0239, abs=1e-3)
    assert quality_rules.chi2_sf(60, 5) == pytest.approx(1.2e-11, rel=0.05)


def test_junk_goes_and_clean_documents_stay(spark):
    rows = prose(1)
    junk = [(1000 + i, " ".join(f"{w}$$$ %%% &&&" for w in t.split()), la, so, 0) for i, (_, t, la, so, _) in enumerate(rows[:60])]
    short = [(2000, "too short", "en", "s0", 0), (2001, None, None, None, None)]
    got = {x.doc_id: x.kept for x in quality_rules.judged(table(spark, rows + junk + short)).collect()}
    assert len(got) == len(rows) + len(junk) + 2
    assert all(got[i] for i, *_ in rows) and not any(got[i] for i, *_ in junk) and not got[2000] and not got[2001]
    kept = quality_rules.keep_good(table(spark, [(*r, 5) for r in rows + junk + short], ", n_words int"))
    assert kept.columns[-1] == "n_words" and {x.doc_id for x in kept.collect()} == {i for i, *_ in rows}
    assert quality_rules.judged(table(spark, [])).count() == 0


def fit_of(x):
    """Centre and covariance as the operator regularises them."""
    share = quality_rules._consistency(quality_rules.COVERAGE)
    return x.mean(0), share * np.cov(x.T, bias=True) + np.diag(list(quality_rules.FLOORS.values()))


def distances(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def mcd_of_all_subsets(x):
    """The reweighted estimate that starts from the subset of least determinant among all of its size."""
    h = math.ceil(quality_rules.COVERAGE * len(x))
    best = min((fit_of(x[list(s)]) for s in itertools.combinations(range(len(x)), h)), key=lambda f: np.linalg.slogdet(f[1])[1])
    inner = x[distances(x, *best) <= quality_rules.chi2_upper(0.025, quality_rules.P)]
    floors = np.diag(list(quality_rules.FLOORS.values()))
    return inner.mean(0), quality_rules._consistency(0.975) * np.cov(inner.T, bias=True) + floors


def test_estimate_and_verdicts_are_those_of_all_subsets(spark):
    r = np.random.default_rng(2)
    sets = {g: np.concatenate([r.normal(0, 1, (12, 5)) @ r.normal(0, 0.5, (5, 5)), r.normal(9, 0.5, (3, 5))]) for g in "abcd"}
    v = spark.createDataFrame([(g, *map(float, row)) for g, x in sets.items() for row in x], "grp string, " + ", ".join(f"{c} double" for c in quality_rules.X))
    params, _ = quality_rules.robust_parameters(v)
    cut = quality_rules.chi2_upper(quality_rules.TAIL, quality_rules.P)
    for p in params.collect():
        m, c = mcd_of_all_subsets(sets[p.grp])
        u = np.zeros((5, 5))
        u[np.tril_indices(5)] = p.u
        assert np.allclose(p.m, m, atol=1e-6) and np.allclose(u.T @ u, np.linalg.inv(c), rtol=1e-4)
        x = sets[p.grp]
        assert ((distances(x, p.m, np.linalg.inv(u.T @ u)) > cut) == (distances(x, m, c) > cut)).all() and (distances(x, m, c)[12:] > cut).all()


def test_small_groups_and_repeated_ids_are_judged(spark):
    rows = [(i, t, la, "s0", 0) for i, (_, t, la, _, _) in enumerate(prose(1))]
    marked = " ".join(f"{w}$$$" for w in rows[0][1].split())
    rows += [(5000 + i, t if i % 2 else marked, la, "rare", 0) for i, (_, t, la, *_) in enumerate(prose(2, 8))]
    rows += [(6000, prose(3, 1)[0][1], "xx", None, 0), (6001, marked, "xx", None, 0), (7, marked, "en", "s0", 0)]
    kept = quality_rules.keep_good(table(spark, [(*r, 1, 2) for r in rows], ", row int, own int")).collect()
    want = [r for r in rows if "$" not in r[1]]
    assert sorted((x.doc_id, x.text) for x in kept) == sorted((r[0], r[1]) for r in want)


# mixing


def test_targets_are_water_filled(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 4000, None: 10}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (budget - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    assert got == pytest.approx({s: capped.get(s, level * weight[s]) for s in sizes})


@pytest.mark.parametrize("bins", [4096, 1])
def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "KEY_BINS", bins)
    rows = prose(3, 400) + [(900, None, "en", None, 0), (901, "x y", None, None, 0), (902, "", "en", "s1", 0), (903, "a b c", "en", "s1", 0), (903, "a b c", "en", "s1", 0)]
    df = table(spark, rows)
    first = mixing.copies(df).collect()
    again = mixing.copies(df.repartition(3)).collect()
    key = lambda x: (str(x.doc_id), x.source or "", x.size, x.taken)
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    by = {}
    for x in first:
        assert x.taken <= 2 * x.size and x.taken == x.copies * x.size
        t = by.setdefault(x.source, [x.target, 0])
        t[1] += x.taken
    assert all(abs(a - b) <= max(3, 0.01 * a) for a, b in by.values())
    mixed = mixing.mixed(table(spark, [(*r, 1) for r in rows], ", copies int"))
    assert mixed.columns[-1] == "copies" and mixed.count() == sum(x.copies for x in first)
    assert mixing.copies(table(spark, [])).count() == 0


# packing and binary output


def docs_to_pack():
    rows = prose(5, 120)
    return rows + [(500, " ".join(t for _, t, *_ in rows[:40]), "en", "s", 0), (501, None, "en", "s", 0), (502, "", "en", "s", 0), (503, "<|endoftext|> x", "en", "s", 0), (None, "y", None, None, None), (1, rows[1][1], "en", "s1", 0)]


def test_best_fit_equals_a_plain_search():
    r = random.Random(6)
    for _ in range(50):
        lengths = sorted((r.randint(1, 64) for _ in range(r.randint(0, 80))), reverse=True)
        left: list[int] = []
        want = []
        for n in lengths:
            fits = [c for c in left if c >= n]
            want.append(64 - min(fits) if fits else 0)
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - n)
            else:
                left.append(64 - n)
        assert [o for _, o in packing.best_fit(lengths, 64)] == want


def ids_of(text):
    return [*tokens.encoder(tokens.default_vocabulary())(text or ""), tokens.END_ID]


def test_fast_ids_are_those_of_the_reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "Héllo wörld's  12345\n\n\t x y \U0001f600 <|endoftext|>", "a" * 300, "l'été\r\n#%$ don't  ", "ﬁ ǅ ½ ​́"] + [t for _, t, *_ in prose(8, 30)]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [ids_of(x)[:-1] for x in texts]


def test_pieces_cover_every_document(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 60)
    rows = docs_to_pack()
    got = packing.packed(table(spark, rows), window=256).collect()
    left = [ids_of(t) for _, t, *_ in rows]
    for x in got:
        assert 0 < x.length <= 256
    by = {}
    for x in got:
        by.setdefault((x.doc_id, x.doc_tokens), []).append(x)
    for (d, n), parts in by.items():
        ids = next(i for (r, *_), i in zip(rows, left) if r == d and len(i) == n)
        copies = sum(r == d and len(i) == n for (r, *_), i in zip(rows, left))
        assert sorted((p.start, p.length) for p in parts) == sorted([(a, min(256, n - a)) for a in range(0, n, 256)] * copies)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in parts)
    for seq in {x.sequence_id for x in got}:
        at = 0
        for x in sorted((x for x in got if x.sequence_id == seq), key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 256
    assert packing.packed(table(spark, [])).count() == 0


def test_packed_matrices_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BUCKET_BYTES", 20_000)
    rows = docs_to_pack()
    seqs = token_output.sequences(table(spark, rows), window=256)
    kept = seqs.collect()
    index = token_output.write_shards(spark.createDataFrame(kept, seqs.schema), f"file://{tmp_path}/out", 256)
    index = spark.createDataFrame(index.collect(), index.schema)
    manifest = token_output.manifest(index).collect()
    assert sum(m.n_sequences for m in manifest) == len(kept) and not list((tmp_path / "out").glob("*.tmp"))
    assert {(x.sequence_id, x.ids_crc32) for x in index.collect()} == {(x.sequence_id, zlib.crc32(x.ids)) for x in kept}
    pieces = {}
    for x in kept:
        ids = np.frombuffer(x.ids, "<u2")
        for a, b, d, s in zip(x.cu_seqlens, x.cu_seqlens[1:], x.doc_ids, x.starts):
            pieces.setdefault(d, []).append((s, ids[a:b].tolist()))
        assert x.position_resets == x.cu_seqlens[:-1] and not ids[x.n_tokens :].any()
    for d in {r[0] for r in rows}:
        whole = sorted(ids_of(t) for r, t, *_ in rows if r == d)
        if len(whole) == 1:
            assert [i for _, part in sorted(pieces[d]) for i in part] == whole[0]
        else:
            assert sorted(i for _, part in pieces[d] for i in part) == sorted(i for w in whole for i in w)
    total = 0
    for m in manifest:
        ids, cu, positions = token_output.read_shard(m.path)
        total += sum(int(c[-1]) for c in cu)
        assert all((positions[k, c[:-1]] == 0).all() for k, c in enumerate(cu)) and ids.shape[1] == 256
    assert total == sum(len(ids_of(t)) for _, t, *_ in rows)
    assert token_output.sequences(table(spark, [])).count() == 0


# personal data


def test_pii_base_spans_and_consistency(spark):
    text = (
        "call +1 (743) 555-3824 or mail joe.x@mail.example.com from 10.0.255.1, not 10.0.256.1; card 4111 1111-1111 1111 is not 4111111111111112. "
        "Later 555-3824 again. 1.2.3.4.5.6.7.8 and é+49 (0)30 1234567 5"
    )
    rows = [(1, text, "en", "s", 0), (2, None, "en", "s", 0), (3, "nothing here", "en", "s", 0), (4, "x@" * 2000 + "y", "en", "s", 0), (5, "1" * 3000, "en", "s", 0)]
    field = pii.fit(pii.training_graphs(table(spark, rows)))
    got = {x.doc_id: x for x in pii.find_pii(table(spark, rows), field).collect()}
    x = got[1]
    assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == (1, 3, 1, 2)
    base = [f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in (("phone", "+1 (743) 555-3824"), ("email", "joe.x@mail.example.com"), ("ip", "10.0.255.1"), ("card", "4111 1111-1111 1111"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("phone", "+49 (0)30 1234567 5"))]
    assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) <= set(x.spans.split(","))
    for d in (2, 3):
        assert got[d].spans == "" and got[d].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(table(spark, []), field).count() == 0


def test_repeated_values_are_labelled_alike():
    text = "call +1 (743) 555-3824 now. Later 555-3824 and so on"
    base = pii.base_spans(text)
    graphs = [pii.graph(t, pii.base_spans(t)) for t in (f"ring +1 ({200 + i}) 555-{1000 + i} or {i} of 20{i:02d}" for i in range(50))]
    added = pii.added_spans(text, base, pii.fit(graphs))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [("phone", "555-3824")]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a></ul></nav>
<div id="cookie-notice">We use cookies, and this notice is as long as a paragraph of the article itself.</div><div class="sidebar"><p>Side words that go on for a while and on</p></div>
<div class="content"><h1>Title &amp; more</h1><p>First   paragraph with a <a href=x>link</a> and<br>many more words to read.</p><p>Short.<p>Second paragraph is long&nbsp;enough to count as text.</div>
<form>name <input></form><div class="comments"><p>Reader says a lot of things here that no one wants to have.</p></div><footer>&copy; x</footer><script>var t="</p>";</script></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &lt; words"), (5, "u", "<p>a<p>b</div></span>")]
    got = {x.page_id: x for x in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Title & more\n\nFirst paragraph with a link and many more words to read.\n\nShort.\n\nSecond paragraph is long enough to count as text."
    assert got[1].n_chars == len(got[1].text) and [got[i].text for i in (2, 3, 4, 5)] == ["", "", "plain < words", "a\n\nb"]


def test_parts_beside_the_longest_stay():
    lead, body = "lead " * 20, "body " * 160
    page = f"<html><body><div class=post><div class=lead>{lead}</div><div class=text>{body}</div></div></body></html>"
    assert html_text.main_text(page) == f"{lead.strip()}\n\n{body.strip()}"


def cluster_by_formula(lines):
    """Every pair of lines, by the definition."""
    ratio = [max(0, len(t) - linked) / tags * html_text.PENALTY**depth for t, tags, linked, _, _, depth in lines]
    weight = lambda i, k: math.exp(-((i - k) ** 2) / (2 * html_text.SIGMA**2)) if abs(i - k) <= 3 * html_text.SIGMA and len({x[5] for x in lines[min(i, k) : max(i, k) + 1]}) == 1 else 0.0
    smooth = [sum(weight(i, k) * r for k, r in enumerate(ratio)) / sum(weight(i, k) for k in range(len(ratio))) for i in range(len(ratio))]
    return [x > 0 and x >= html_text.THRESHOLD * np.std(smooth) for x in smooth]


def test_clusters_equal_the_formula():
    r = random.Random(9)
    for _ in range(200):
        lines = [("x" * n, r.randint(1, 9), r.choice((0, n, n // 2)), 0, False, r.choice((0, 0, 0, 1, 2))) for n in (r.randint(1, 200) for _ in range(r.randint(1, 30)))]
        assert html_text.content_cluster(lines) == cluster_by_formula(lines)


def test_a_wrapper_by_any_name_changes_nothing():
    inner = "<nav><a href=x>Menu</a></nav><div>" + "<p>Some words of the article, many of them.</p>" * 6 + "</div><div class=share>Share this</div>"
    want = html_text.main_text(f"<body>{inner}</body>")
    assert want == "\n\n".join(["Some words of the article, many of them."] * 6)
    for a, b in (("<form>", "</form>"), ("<div class=content-sidebar-wrap>", "</div>"), ("<div class=post-with-comments><main>", "</main></div>")):
        assert html_text.main_text(f"<body>{a}{inner}{b}</body>") == want


def test_the_cluster_decides():
    """Without tags or names to go by, what lies apart from the long paragraphs goes."""
    body = "<div>" + "<p>A paragraph of the article with a good many words in it, one after another.</p>" * 5 + "</div>"
    apart = lambda at: "".join(f"<div><i>{at}</i><b>{k}</b></div>" for k in range(8))
    got = html_text.main_text(f"<html><body>{apart('x')}{body}{apart('y')}</body></html>").split("\n\n")
    assert sum(len(x) > 9 for x in got) == 5 and not {"x0", "x1", "x2", "y5", "y6", "y7"} & set(got)


# the pipeline


def test_pipeline_stages(spark):
    rows = prose(7, 150)
    near = [(3000 + i, t + " tail", la, so, 0) for i, (_, t, la, so, _) in enumerate(rows[:10])]
    same = [(4000 + i, t.upper(), la, so, 0) for i, (_, t, la, so, _) in enumerate(rows[20:30])]
    docs = table(spark, rows + near + same + [(5000, "x", "en", "s0", 0)])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_duplicates", "mixing", "packing"]
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k < 4:
            assert docs.columns == columns
        counts.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert 5000 not in counts[0] and len(counts[0]) == 170
    assert counts[1] == counts[0] - {r[0] for r in rows[20:30]}
    assert counts[2] == counts[1] - {n[0] for n in near}
    assert counts[3] <= counts[2] and counts[4] == counts[3]
    assert docs.agg(F.max("offset")).first()[0] < 2048
