"""Stupid-backoff language-model scores of documents against the rest of the corpus.

Documents are spread over batches by hash, and travel compressed. Each batch sends its distinct n-grams with their counts to the count
tables, which are partitioned by n-gram hash; these are summed over all batches and joined back to every batch that
asked, and the batch sums the scores of its documents. A document's own n-grams are taken out of the counts, so
that each is scored by all others. N-grams travel as sorted 64-bit hashes in Elias-Fano code, one row for a batch and
a partition of the table; a reply holds only counts that differ from the batch's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORDER, BACKOFF = 3, 0.4
#: Bytes of text to a batch, about; what one task holds, with its n-grams.
BATCH_BYTES = 9_000_000
#: Low bits of a hash that are kept as they are; about as many as make the rest shortest in batches of this size.
LOW_BITS = 44
#: Bytes of rows that a task gathers before it sends them to their batches.
CHUNK_BYTES = 32_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """Word hashes of a batch's documents and the hashes of their n-grams, order by order."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        import xxhash

        vocabulary: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        for t in texts:
            words = (t or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
            ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        self.sizes = np.array([len(x) for x in ids], np.int64)
        word = hashes[np.concatenate(ids)] if self.sizes.sum() else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        self.place = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        #: grams[k][i] ends at token i and has k + 1 words; it stands only where place >= k.
        self.grams = [_mix(word + _K)]
        for k in range(1, order):
            g = np.zeros_like(word)
            g[k:] = _mix((self.grams[k - 1][k - 1 : -1] + np.uint64(k)) * _K + word[k:])
            self.grams.append(g)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([g[self.place >= k] for k, g in enumerate(self.grams)]), return_counts=True)

    def indexed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """distinct(); which of them stands where, order after order; and how often it does in the same document. A
        stable sort leaves equal n-grams in the order of their documents."""
        every = np.concatenate([g[self.place >= k] for k, g in enumerate(self.grams)])
        doc = np.concatenate([self.doc[self.place >= k] for k in range(len(self.grams))])
        at = np.argsort(every, kind="stable")
        every, doc = every[at], doc[at]
        new = np.ones(len(at), bool)
        new[1:] = every[1:] != every[:-1]
        run = new.copy()
        run[1:] |= doc[1:] != doc[:-1]
        index, own = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        index[at] = np.cumsum(new) - 1
        sizes = np.diff(np.append(np.flatnonzero(run), len(at)))
        own[at] = np.repeat(sizes, sizes)
        begin = np.flatnonzero(new)
        return every[begin], np.diff(np.append(begin, len(at))), index, own


def pack(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct hashes and their counts."""
    n = len(h)
    low = h.view(np.uint8).reshape(n, 8)[:, : LOW_BITS // 8].tobytes()
    half = np.zeros(n + n % 2, np.uint8)  # bits 40 to 43, two to a byte
    half[:n] = (h >> np.uint64(40)).astype(np.uint8) & 15
    high = ((h >> np.uint64(LOW_BITS)) - (h[0] >> np.uint64(LOW_BITS))).astype(np.int64)
    unary = np.zeros(int(high[-1]) + n, np.uint8)
    unary[high + np.arange(n)] = 1
    head = np.array([n, len(unary)], "<u4").tobytes() + (h[:1] >> np.uint64(LOW_BITS)).tobytes()
    return head + low + (half[::2] | half[1::2] << 4).tobytes() + np.packbits(unary).tobytes() + pack_counts(counts)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, bits = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    base = np.frombuffer(raw, "<u8", 1, 8)[0]
    width = LOW_BITS // 8
    h = np.zeros((n, 8), np.uint8)
    h[:, :width] = np.frombuffer(raw, np.uint8, n * width, 16).reshape(n, width)
    at = 16 + n * width
    half = np.frombuffer(raw, np.uint8, (n + 1) // 2, at)
    h[:, width] = np.stack([half & 15, half >> 4], 1).ravel()[:n]
    at += len(half)
    size = (bits + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=bits)) - np.arange(n)
    return h.view("<u8")[:, 0] + ((high.astype(np.uint64) + base) << np.uint64(LOW_BITS)), unpack_counts(raw[at + size :], n)


def pack_counts(c: np.ndarray) -> bytes:
    """A bit each, whether it is above 1, a byte for each that is, and eight for those of 255 and more."""
    more = c[c > 1]
    return np.packbits(c > 1).tobytes() + np.minimum(more, 255).astype(np.uint8).tobytes() + more[more >= 255].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    c = np.ones(n, np.int64)
    size = (n + 7) // 8
    more = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size), count=n))
    high = np.frombuffer(raw, np.uint8, len(more), size).astype(np.int64)
    high[high == 255] = np.frombuffer(raw, "<u8", -1, size + len(more)).astype(np.int64)
    c[more] = high
    return c


_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text, batch as a compressed Arrow batch for each of the batches: batch, size, chunk."""
    codec = pa.Codec("zstd")

    def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        of = t.column("batch").to_numpy()
        at = np.argsort(of, kind="stable")
        ids, begin = np.unique(of[at], return_index=True)
        docs = t.select(["doc_id", "text"]).cast(_DOCS)
        raws = [docs.take(pa.array(rows)).combine_chunks().to_batches()[0].serialize() for rows in np.split(at, begin[1:])]
        chunks = [codec.compress(x, asbytes=True) for x in raws]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.size for x in raws], pa.int64()), pa.array(chunks, pa.binary())], ["batch", "size", "chunk"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= CHUNK_BYTES:
            yield sent(held)
            held = []
    if held:
        yield sent(held)


def _opened(t: pa.Table) -> pa.Table:
    codec = pa.Codec("zstd")
    raws = (codec.decompress(x, size) for x, size in zip(t.column("chunk").to_pylist(), t.column("size").to_pylist()))
    return pa.Table.from_batches([pa.ipc.read_record_batch(x, _DOCS) for x in raws], _DOCS)


def _bounds(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each partition, the hashes with equal first *bits* bits, begins."""
    if not bits:
        return np.array([0, len(h)])
    return np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _asked(order: int, bits: int):
    def ask(t: pa.Table) -> pa.Table:
        h, c = Batch(_opened(t).column("text").to_pylist(), order).distinct()
        cut = _bounds(h, bits)
        rows = [(p, pack(h[a:b], c[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        batch = t.column("batch")[0].as_py()
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "grams": pa.array([x for _, x in rows], pa.binary())})

    return ask


def _answered(t: pa.Table) -> pa.Table:
    t = t.sort_by("batch")
    got = [unpack(x) for x in t.column("grams").to_pylist()]
    _, inverse = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
    counts = np.concatenate([c for _, c in got])
    totals = np.bincount(inverse, counts).astype(np.int64)[inverse]
    replies, at = [], 0
    for _, c in got:
        total = totals[at : at + len(c)]
        at += len(c)
        more = total > c
        replies.append(np.packbits(more).tobytes() + pack_counts(total[more]))
    return pa.table({"batch": t.column("batch"), "part": t.column("part"), "reply": pa.array(replies, pa.binary())})


def _scored(order: int, backoff: float, bits: int, total: int):
    def score(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _opened(docs)
        b = Batch(docs.column("text").to_pylist(), order)
        h, c, index, own = b.indexed()
        count = c.astype(np.int64)
        cut = _bounds(h, bits)
        for p, raw in zip(replies.column("part").to_pylist(), replies.column("reply").to_pylist()):
            lo, n = int(cut[p]), int(cut[p + 1] - cut[p])
            more = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8), count=n))
            count[lo + more] = unpack_counts(raw[(n + 7) // 8 :], len(more))
        docs_n, tokens = len(b.sizes), len(b.doc)
        others = (total - b.sizes)[b.doc]  # words of all other documents
        out = np.full(tokens, np.nan)
        level = np.zeros(tokens, np.int64)
        previous = None  # counts of the (k)-grams before, by token
        at = 0
        for k in range(order):
            on = np.flatnonzero(b.place >= k)
            here = slice(at, at + len(on))
            at += len(on)
            rest = np.zeros(tokens, np.int64)
            rest[on] = count[index[here]] - own[here]
            if k == 0:
                value = np.where(rest > 0, np.log(np.maximum(rest, 1)) - np.log(np.maximum(others, 1)), -np.log(others + 1.0))
                out, level = value, (rest > 0).astype(np.int64)
            else:
                context = np.zeros(tokens, np.int64)
                context[1:] = previous[:-1]
                seen = rest > 0
                value = np.log(np.maximum(rest, 1)) - np.log(np.maximum(context, 1))
                out = np.where(b.place >= k, np.where(seen, value, out + np.log(backoff)), out)
                level = np.where(seen, k + 1, level)
            previous = rest
        sums = np.bincount(b.doc, out, docs_n) if tokens else np.zeros(docs_n)
        full = np.bincount(b.doc, level == order, docs_n).astype(np.int64) if tokens else np.zeros(docs_n, np.int64)
        none = np.bincount(b.doc, level == 0, docs_n).astype(np.int64) if tokens else np.zeros(docs_n, np.int64)
        with np.errstate(invalid="ignore"):
            mean = np.where(b.sizes > 0, sums / np.maximum(b.sizes, 1), np.nan)
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(b.sizes), "n_full": pa.array(full), "n_unseen": pa.array(none),
            "log_score": pa.array(sums), "mean_log_score": pa.array(mean, pa.float64(), from_pandas=True),
        })

    return score


SCORES = "doc_id long, n_words long, n_full long, n_unseen long, log_score double, mean_log_score double"


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, n_full (words scored at the full order), n_unseen, log_score, mean_log_score: a row per row.

    A word w after the context c, at most order - 1 words of the same document, scores count(c w) / count(c) if c w
    stands in another document, else backoff times its score after the shorter context; without context it scores
    count(w) / N, and 1 / (N + 1) if no other document has it. Counts and N are those of all other rows. log_score
    sums the logarithms. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Texts without words, and null ones,
    score 0 with a null mean. Rows that repeat count as documents of their own. No rows in, no rows out.
    """
    if order < 1 or not 0 < backoff <= 1:
        raise ValueError("order must be at least 1 and backoff in (0, 1]")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    raw = t.encode()
                    n, size = n + len(raw.split()), size + len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size])], ["n", "size"])

    r = docs.select("text").mapInArrow(sizes, "n long, size long").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    total, batches = r.n or 0, -(-(r.size or 0) // BATCH_BYTES) or 1
    bits = max(0, (batches - 1).bit_length())
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).mapInArrow(_chunks, "batch long, size long, chunk binary")
    asked = docs.groupBy("batch").applyInArrow(_asked(order, bits), "part long, batch long, grams binary")
    replies = asked.groupBy("part").applyInArrow(_answered, "batch long, part long, reply binary")
    return docs.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_scored(order, backoff, bits, total), SCORES)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return stupid_backoff(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLE: dict[str, str] = {}
