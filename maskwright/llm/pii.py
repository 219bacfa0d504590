"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The nodes of the field are the tokens that hold a digit or an at sign; all others are of no kind by a hard constraint,
so the graph of a document falls into small parts. Neighbours in the text share chain potentials; tokens that repeat
(same text, same digits, or same last seven digits) share skip potentials, each with the next of its like
and with the first of them that a pattern labels, so a document's edges grow with its tokens. Loopy sum-product message passing gives marginals. The weights are fitted by
pseudo-likelihood on a bounded sample of documents, labelled by the fixed patterns: a bare repetition of a labelled
value is left out there, and it is these that message passing labels.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Documents that the field is fitted on: those whose hashed ids come first, of those with any node.
TRAINING_DOCUMENTS = 1000
#: Tasks that merge the tasks' choices of them.
MERGERS = 4
#: Nodes of a training document; longer ones aren't used for training.
TRAINING_NODES = 500
SURE = 0.8
ROUNDS, DAMPING = 12, 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match that fails at the first digit of a run fails within it, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at signs: linear also in texts of one long word."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, sorted; leftmost and non-overlapping within a kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        # a part of many digits is above 255 unless it is zeros
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Graph:
    """The nodes of a document: their places, features, labels by fixed patterns (-1: left out), and edges."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    labels: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


N_FEATURES = 24


def _features(token: str, before: str, after: str) -> list[int]:
    digits = sum("0" <= c <= "9" for c in token)
    core = token.strip(_EDGE)
    on = [0, 1 + min(digits, 1) + (digits > 1) + (digits > 3) + (digits > 6) + (digits > 9) + (digits > 13) + (digits > 19)]
    tests = (
        "@" in token, "@" in token and "." in core.rpartition("@")[2], core.isdigit(), core.count(".") == 3 and core.replace(".", "").isdigit(),
        any(c.isalpha() for c in token), "-" in token, token[:1] == "(", token[:1] == "+", token[-1:] in ".,;:", before[-1:] == ":", after[:1].isupper(), "=" in token or '"' in token,
        "." in core, not any(c.isalpha() for c in token) and digits > 0,
    )
    return on + [9 + i for i, t in enumerate(tests) if t]


def _keys(token: str) -> list[str]:
    digits = "".join(c for c in token if "0" <= c <= "9")
    keys = [f"t{token.strip(_EDGE).lower()}"] if "@" in token else []
    if len(digits) >= 4:
        keys.append(f"d{digits}")
    if len(digits) >= 7:
        keys.append(f"e{digits[-7:]}")
    return keys


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    spans: list[tuple[int, int]] = []
    end = 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not _BLANK.match(text, a - 1):
            a -= 1
        found = _BLANK.search(text, m.start())
        end = found.start() if found else len(text)
        spans.append((a, end))
    rows = np.zeros((len(spans), N_FEATURES), np.float32)
    labels = np.zeros(len(spans), np.int64)
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    last: dict[str, int] = {}
    keys = []
    at = 0
    reach: list[tuple[int, int, int]] = sorted(base)
    for i, (a, b) in enumerate(spans):
        before, after = text[max(0, a - 20) : a].rstrip(), text[b : b + 20].lstrip()
        rows[i, _features(text[a:b], before, after)] = 1
        if i and not text[spans[i - 1][1] : a].strip(" \t\n\x0b\x0c\r"):
            chain.append((i - 1, i))
        while at < len(reach) and reach[at][2] <= a:
            at += 1
        labels[i] = next((k + 1 for s, k, e in reach[at : at + 8] if s < b and e > a), 0)
        own = _keys(text[a:b])
        keys.append(own)
        for k in own:
            if k in last and (last[k], i) not in skip[-2:]:
                skip.append((last[k], i))
            last[k] = i
    known: dict[str, int] = {}
    for i, own in enumerate(keys):
        if labels[i]:
            for k in own:
                known.setdefault(k, i)
    for i, own in enumerate(keys):
        anchor = next((known[k] for k in own if k in known), None)
        if not labels[i] and anchor is not None:
            labels[i] = -1
            skip.append((anchor, i))
    return Graph(spans, rows, labels, chain, skip)


@dataclass
class Field:
    """Weights: of features by label, of neighbouring labels, and of equal labels across a skip edge."""

    w: np.ndarray
    a: np.ndarray
    s: np.ndarray


def prior() -> Field:
    n = len(LABELS)
    w = np.zeros((N_FEATURES, n))
    w[0, 0] = 2.0
    return Field(w, np.zeros((n, n)), np.full(n, 7.0))


def fit(graphs: list[Graph], rounds: int = 300, rate: float = 0.1) -> Field:
    """Maximum a posteriori pseudo-likelihood about prior(), by Adam. Without graphs: the prior."""
    field = prior()
    n = len(LABELS)
    xs, ys, left, right, votes = [], [], [], [], []
    for g in graphs:
        y = np.maximum(g.labels, 0)
        prev, nxt, v = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64), np.zeros((len(y), n))
        for i, j in g.chain:
            prev[j], nxt[i] = y[i], y[j]
        for i, j in g.skip:
            v[i, y[j]] += g.labels[j] >= 0
            v[j, y[i]] += g.labels[i] >= 0
        use = g.labels >= 0
        for to, x in ((xs, g.features), (ys, y), (left, prev), (right, nxt), (votes, v)):
            to.append(x[use])
    if not xs or not sum(map(len, ys)):
        return field
    x, y, p, q, v = np.concatenate(xs).astype(float), np.concatenate(ys), np.concatenate(left), np.concatenate(right), np.concatenate(votes)
    one, ep, eq = np.eye(n)[y], np.eye(n)[p], np.eye(n)[q]
    start = [field.w.copy(), field.a.copy(), field.s.copy()]
    theta = [t.copy() for t in start]
    m, u = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        w, a, s = theta
        z = x @ w + a[p] + a[:, q].T + v * s
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        d = one - e / e.sum(1, keepdims=True)
        grads = [x.T @ d, ep.T @ d + (eq.T @ d).T, (v * d).sum(0)]
        for k, (g, t, t0, pull) in enumerate(zip(grads, theta, start, (0.1, 0.1, 5.0))):
            g = g - pull * (t - t0)
            m[k] = 0.9 * m[k] + 0.1 * g
            u[k] = 0.999 * u[k] + 0.001 * g * g
            t += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.999**step)) + 1e-8)
    return Field(*theta)


def marginals(g: Graph, field: Field) -> np.ndarray:
    """Label probabilities of each node by damped loopy message passing, all messages at once. Nodes whose label the
    fixed patterns give are held to it."""
    n = len(LABELS)
    node = g.features @ field.w
    open_left, open_right = np.ones(len(node), bool), np.ones(len(node), bool)
    for i, j in g.chain:
        open_left[j] = open_right[i] = False
    node[open_left] += field.a[0]
    node[open_right] += field.a[:, 0]
    fixed = g.labels > 0
    node[fixed] = -50.0
    node[fixed, g.labels[fixed]] = 0.0
    pairs = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
    if len(pairs):
        psi = np.stack([field.a] * len(g.chain) + [np.diag(field.s)] * len(g.skip))
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(src)), len(pairs))
        msg = np.zeros((len(src), n))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + psi
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            new -= new.max(1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        np.add.at(node, dst, msg)
    node = node - node.max(1, keepdims=True)
    e = np.exp(node)
    return e / e.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens of one kind that the field is sure of and that touch no span of the patterns."""
    g = graph(text, base)
    if not len(g.spans):
        return []
    p = marginals(g, field)
    best = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    # A token that has a pattern's span in it stays as it is.
    covered = [any(s < b and e > a for s, _, e in near) for (a, b), near in zip(g.spans, _near(g.spans, base))]
    joined = {j for _, j in g.chain}
    out: list[list[int]] = []
    for i, (a, b) in enumerate(g.spans):
        k = int(best[i])
        if not k or covered[i]:
            continue
        token = text[a:b]
        a, b = a + len(token) - len(token.lstrip(_EDGE.replace("(", ""))), b - len(token) + len(token.rstrip(_EDGE))
        if a >= b:
            continue
        if out and i in joined and out[-1][1] == k - 1 and out[-1][3] == i - 1:
            out[-1][2:] = [b, i]
        else:
            out.append([a, k - 1, b, i])
    return [(a, k, b) for a, k, b, _ in out]


def _near(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    ordered, at = sorted(base), 0
    for a, b in spans:
        while at < len(ordered) and ordered[at][2] <= a:
            at += 1
        yield [x for x in ordered[max(0, at - 2) : at + 8] if x[0] < b]


def training_graphs(docs: DataFrame, limit: int = TRAINING_DOCUMENTS) -> list[Graph]:
    """The graphs of at most *limit* documents, those with the smallest hashes of doc_id and text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each task hands on no more than `limit` of its own
        held: list[tuple[bytes, bytes]] = []
        most = None  # above it no hash is among the smallest
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and _MARK.search(text):
                    h = hashlib.blake2b(f"{doc_id}\0{text}".encode(), digest_size=16).digest()
                    if most is None or h < most:
                        g = graph(text, base_spans(text))
                        if len(g.spans) <= TRAINING_NODES:
                            g.spans = []
                            g.features = np.packbits(g.features.astype(bool), axis=1)
                            held.append((h, pickle.dumps(g)))
                if len(held) > 2 * limit:
                    held = sorted(held)[:limit]
                    most = held[-1][0]
        held = sorted(held)[:limit]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.binary()), pa.array([g for _, g in held], pa.binary())], ["h", "g"])

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        for b in batches:
            held = sorted(held + list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))[:limit]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.binary()), pa.array([g for _, g in held], pa.binary())], ["h", "g"])

    schema = "h binary, g binary"
    # Merged by a few tasks first, so that what reaches the driver doesn't grow with the number of tasks.
    some = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(build, schema).repartition(MERGERS, "h").mapInArrow(fewer, schema)
    top = some.orderBy("h").limit(limit).collect()
    out = [pickle.loads(r.g) for r in top]
    for g in out:
        g.features = np.unpackbits(g.features, axis=1)[:, :N_FEATURES].astype(np.float32)
    return out


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row of *docs*.

    The counts and the digest are of the fixed patterns' spans; spans holds these and those the field adds. Null texts
    count as empty. Repeated rows are treated alike. Offsets are code points. Without *field* one is fitted here.
    """
    field = field or fit(training_graphs(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                base: list[tuple[int, int, int]] = []
                more: list[tuple[int, int, int]] = []
                if text and _MARK.search(text):
                    base = base_spans(text)
                    more = added_spans(text, base, field)
                for k in range(4):
                    out[k].append(sum(x[1] == k for x in base))
                out[4].append(hashlib.sha256(rendered(base).encode()).hexdigest())
                out[5].append(rendered(base + more))
                out[6].append(len(more))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds))], NAMES)

    NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
