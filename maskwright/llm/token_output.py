"""Packed token matrices: best-fit-decreasing windows with their ids, cumulative segment lengths and position resets."""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_folder, table
from .packing import bucket_packer, with_buckets
from .tokens import WINDOW, pieces

#: Bytes of text to a bucket, about: what one packing task holds as ids.
BUCKET_BYTES = 1 << 24
PAD_ID = 0
SEQUENCE = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


def sequences(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """A row per packed window: sequence_id, n_tokens, ids (window little-endian unsigned 16-bit ids, PAD_ID behind
    n_tokens), cu_seqlens (0 and the end of each segment), position_resets (the start of each segment, where positions
    begin at 0 again), doc_ids and starts (the document and first token of each segment).

    Overlong documents are split losslessly. Null texts count as empty: a segment of the end id. Repeated rows are
    packed each for itself. No rows in, no rows out.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long") + 1)).first()[0] or 0
    buckets = -(-total // BUCKET_BYTES) or 1
    pack = bucket_packer(window)

    def build(t: pa.Table) -> pa.Table:
        t = pack(t).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        raw, n = t.column("ids").to_pylist(), t.column("length").to_numpy()
        seq, doc, start = (t.column(c).to_pylist() for c in ("sequence_id", "doc_id", "start"))
        first = [i for i in range(len(seq)) if i == 0 or seq[i] != seq[i - 1]]
        out: dict[str, list] = {k: [] for k in ("sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts")}
        for a, b in zip(first, [*first[1:], len(seq)]):
            ends = np.cumsum(n[a:b])
            row = np.full(window, PAD_ID, "<u2")
            row[: ends[-1]] = np.frombuffer(b"".join(raw[a:b]), "<u2")
            cu = [0, *ends.tolist()]
            for k, x in zip(out, (seq[a], int(ends[-1]), row.tobytes(), cu, cu[:-1], doc[a:b], start[a:b])):
                out[k].append(x)
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({k: pa.array(v, ty) for (k, v), ty in zip(out.items(), types)})

    p = pieces(docs, window, vocabulary, ids=True)
    return with_buckets(p, buckets).groupBy("bucket").applyInArrow(build, SEQUENCE)


MAGIC, VERSION = b"MWPK", 2
INDEX = "path string, row long, sequence_id long, n_tokens long, n_segments long, ids_crc32 long"


def _file_system(folder: str):
    """The file system of a folder's URI and its path there; without a scheme the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def write_shards(seqs: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """Writes each partition of *seqs* as a binary shard into *folder*, on any file system that executors reach by its
    URI. Once computed, the result has a row per window: path, row (its place in the shard), sequence_id, n_tokens,
    n_segments, and ids_crc32 of its row of ids.

    A shard: MAGIC, version, window (unsigned 32-bit numbers); the rows of 16-bit ids; rows + 1 offsets into the segments
    (64-bit); per segment its end in the row (32-bit), which implies where positions restart; rows and segments (64-bit).
    Ids are written as they come; only the segments' ends are held. A task writes under a name of its own attempt and
    renames at the end, so a lost executor leaves no half shard. Empty partitions write none.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = _file_system(folder)
        ctx = TaskContext.get()
        path = f"{base}/part-{ctx.partitionId():06d}.mwpk"
        tmp = f"{path}.{ctx.taskAttemptId()}.tmp"
        out, ends, offsets = None, array("I"), array("Q", [0])
        for b in batches:
            if out is None and b.num_rows:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(tmp)
                out.write(MAGIC + struct.pack("<2I", VERSION, window))
            first, crc = len(offsets) - 1, []
            cu = b.column("cu_seqlens").to_pylist()
            for ids, c in zip(b.column("ids"), cu):
                raw = ids.as_py()
                out.write(raw)
                crc.append(zlib.crc32(raw))
                ends.extend(c[1:])
                offsets.append(len(ends))
            n = pa.array([c[-1] for c in cu], pa.int64())
            rows = [pa.array([path] * len(cu), pa.string()), pa.array(range(first, first + len(cu)), pa.int64()), b.column("sequence_id"), n, pa.array([len(c) - 1 for c in cu], pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["path", "row", "sequence_id", "n_tokens", "n_segments", "ids_crc32"])
        if out is not None:
            out.write(np.array(offsets, "<u8").tobytes() + np.array(ends, "<u4").tobytes() + struct.pack("<2Q", len(offsets) - 1, len(ends)))
            out.close()
            files.move(tmp, path)

    return seqs.select("sequence_id", "ids", "cu_seqlens").mapInArrow(write, INDEX)


def manifest(index: DataFrame) -> DataFrame:
    """path, n_sequences, n_tokens, n_segments of each shard of a computed result of write_shards."""
    return index.groupBy("path").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_segments").alias("n_segments"))


def read_shard(path: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The id matrix, each row's cumulative segment lengths, and the matrix of position ids."""
    files, name = _file_system(path)
    with files.open_input_stream(name) as f:
        raw = f.read()
    version, window = struct.unpack("<2I", raw[4:12])
    if raw[:4] != MAGIC or version != VERSION:
        raise ValueError(f"{path} isn't a packed shard")
    rows, segments = struct.unpack("<2Q", raw[-16:])
    at = 12 + rows * window * 2
    ids = np.frombuffer(raw[12:at], "<u2").reshape(rows, window)
    offsets = np.frombuffer(raw[at : at + 8 * (rows + 1)], "<u8")
    ends = np.frombuffer(raw[at + 8 * (rows + 1) : -16], "<u4")
    assert len(ends) == segments
    cu = [np.concatenate(([0], ends[int(a) : int(b)])) for a, b in zip(offsets, offsets[1:])]
    positions = np.zeros((rows, window), "<u2")
    for row, c in zip(positions, cu):
        for a, b in zip(c, c[1:]):
            row[a:b] = np.arange(b - a)
    return ids, cu, positions


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed windows, written as shards into the shared folder; a row per window, with its shard."""
    return write_shards(sequences(table(spark, sf_dir, "documents")), own_folder(spark, "shards"))


QUERIES = {"op8_token_output": op8_token_output}
ORACLE: dict[str, str] = {}
