"""Token ids of documents, cut into pieces."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 2048
END_ID = 1


def default_vocabulary() -> str:
    """The byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to the ids that the tokenizers library gives without special tokens added. Texts that hold a string of an
    added token go through it; for all others the rank file beside the vocabulary, where there is one, gives the same
    ids several times as fast."""
    library: list = []  # loaded by the first text that needs it

    def slow(text: str) -> list[int]:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return library[0].encode(text, add_special_tokens=False).ids

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    with open(path, encoding="utf-8") as f:
        added = re.compile("|".join(re.escape(t["content"]) for t in json.load(f)["added_tokens"]) or "(?!)")
    return lambda text: slow(text) if added.search(text) else fast(text)


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (, ids: little-endian unsigned 16-bit): every document's ids, with
    END_ID at the end, cut into full windows and a last piece of less. Null texts count as empty: one piece, END_ID.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = encode(text.as_py() or "")
                tokens.append(END_ID)
                raw = np.array(tokens, "<u4").tobytes()
                for at in range(0, len(tokens), window):
                    part = raw[4 * at : 4 * (at + window)]
                    for column, x in zip(out, (doc_id, at, len(part) // 4, zlib.crc32(part), len(tokens), narrow(part) if ids else None)):
                        column.append(x)
                held += len(raw)
                if ids and held > 1 << 25:
                    yield _batch(out, ids)
                    out, held = [[] for _ in range(6)], 0
            yield _batch(out, ids)

    schema = T.StructType([*PIECE.fields, T.StructField("ids", T.BinaryType())]) if ids else PIECE
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def narrow(raw: bytes) -> bytes:
    """32-bit ids as 16-bit ones."""
    wide = np.frombuffer(raw, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError("an id doesn't fit into 16 bits")
    return wide.astype("<u2").tobytes()


def _batch(out: list[list], ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in out[:5]]
    names = PIECE.names
    if ids:
        arrays, names = [*arrays, pa.array(out[5], pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)
