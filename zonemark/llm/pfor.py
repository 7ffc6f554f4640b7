"""Token-id files of patched frame-of-reference blocks (operator 10).

Format of a segment (all integers little-endian):

    header   4 bytes  b"PFB1"; then u32: block length, documents, blocks; u64: ids
    docs     per document i64 doc_id (as given), u8 null flag; u32 number of ids
    index    per block u32: byte offset of the block in the payload (the index of block starts)
    payload  per block u32 minimum, u8 width, u16 exceptions; then ceil(len*width/8) bytes, the values
             less the minimum, most significant bit first; then for each exception u16 position and
             u32 value less the minimum

The width is the number of bits that ``percentile`` of the block's values need; larger values are
exceptions.  Segments are rows of a Parquet table written by Spark, so a task's files appear whole or
not at all, also when it runs again on another executor, in any store that Spark can write.

Defined cases: a null text is an empty one; rows without doc_id come first; rows that share a doc_id
follow the order of their texts; an empty table gives no segments; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import lean
from .storage import shared_folder
from .tokens import default_path, ragged, tokenizer_for

BLOCK, PERCENTILE = 256, 0.9
_HEAD = struct.Struct("<4sIIIQ")
_MAGIC = b"PFB1"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.uint8)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, width bits each."""
    if width == 0:
        return np.empty((len(v), 0), np.uint8)
    kind = ">u2" if width <= 16 else ">u4"
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(v.astype(kind).view(np.uint8).reshape(v.shape[0], v.shape[1], size // 8), axis=2)
    return np.packbits(bits[:, :, size - width :].reshape(len(v), -1), axis=1)


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(raw), n), np.uint32)
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(raw), n, size), np.uint8)
    bits[:, :, size - width :] = np.unpackbits(raw, axis=1)[:, : n * width].reshape(len(raw), n, width)
    return np.packbits(bits, axis=2).view(">u2" if size == 16 else ">u4").reshape(len(raw), n).astype(np.uint32)


def encode_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts, payload) of a run of ids."""
    if not 0 < block <= 1 << 16:
        raise ValueError("places in a block have 16 bits")
    nblk = -(-len(ids) // block)
    if not nblk:
        return np.empty(0, np.uint32), b""
    short = nblk * block - len(ids)
    v = np.concatenate([ids, np.repeat(ids[-1:], short)]).astype(np.uint32).reshape(nblk, block)
    low = v.min(1)
    v = v - low[:, None]
    at = min(block - 1, int(block * percentile))
    width = _bits(np.partition(v, at, axis=1)[:, at])
    need = _bits(v)
    odd = need > width[:, None]
    odd[-1, block - short :] = False
    nodd = odd.sum(1)
    lens = np.full(nblk, block)
    lens[-1] -= short
    size = 7 + (lens * width.astype(np.int64) + 7) // 8 + 6 * nodd
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(nblk, np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2")]))
    head["low"], head["width"], head["odd"] = low, width, nodd
    out[(starts[:, None] + np.arange(7)).ravel()] = head.view(np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(np.where(odd[rows], 0, v[rows]), int(w))
        for r, p in ((rows[lens[rows] == block], packed[lens[rows] == block]), (rows[lens[rows] < block], packed[lens[rows] < block])):
            if len(r):
                k = (int(lens[r[0]]) * int(w) + 7) // 8
                out[(starts[r][:, None] + 7 + np.arange(k)).ravel()] = p[:, :k].ravel()
    if nodd.any():
        r, c = np.nonzero(odd)
        exc = np.zeros(len(r), np.dtype([("at", "<u2"), ("v", "<u4")]))
        exc["at"], exc["v"] = c, v[r, c]
        first = starts + 7 + (lens * width.astype(np.int64) + 7) // 8
        out[ragged(first, 6 * nodd)] = exc.view(np.uint8)
    return starts.astype(np.uint32), out.tobytes()


def decode_ids(starts: np.ndarray, payload: bytes, n: int, block: int = BLOCK) -> np.ndarray:
    nblk = len(starts)
    out = np.zeros((nblk, block), np.uint32)
    if not nblk:
        return out.ravel()
    raw, starts = np.frombuffer(payload, np.uint8), starts.astype(np.int64)
    head = raw[(starts[:, None] + np.arange(7)).ravel()].view(np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2")]))
    width, nodd = head["width"].astype(np.int64), head["odd"].astype(np.int64)
    lens = np.full(nblk, block)
    lens[-1] = n - (nblk - 1) * block
    for w in np.unique(width):
        for size in {block, int(lens[-1])}:
            r = np.flatnonzero((width == w) & (lens == size))
            if len(r):
                k = (size * int(w) + 7) // 8
                out[r, :size] = _unpack(raw[(starts[r][:, None] + 7 + np.arange(k)).ravel()].reshape(len(r), k), int(w), size)
    if nodd.any():
        first = starts + 7 + (lens * width + 7) // 8
        exc = raw[ragged(first, 6 * nodd)].view(np.dtype([("at", "<u2"), ("v", "<u4")]))
        out[np.repeat(np.arange(nblk), nodd), exc["at"]] = exc["v"]
    return (out + head["low"][:, None]).astype(np.uint32).ravel()[:n]


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    run = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    starts, payload = encode_ids(run, block, percentile)
    docs = np.zeros(len(ids), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]))
    docs["id"] = [d or 0 for d in doc_ids]
    docs["null"] = [d is None for d in doc_ids]
    docs["n"] = [len(x) for x in ids]
    return _HEAD.pack(_MAGIC, block, len(ids), len(starts), len(run)) + docs.tobytes() + starts.astype("<u4").tobytes() + payload


def read_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, block, ndocs, nblk, n = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a segment of patched frame-of-reference blocks")
    docs = np.frombuffer(data, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]), ndocs, _HEAD.size)
    at = _HEAD.size + docs.nbytes
    starts = np.frombuffer(data, "<u4", nblk, at)
    ids = decode_ids(starts, data[at + starts.nbytes :], n, block)
    ends = np.concatenate([[0], np.cumsum(docs["n"].astype(np.int64))])
    return [None if z else int(i) for i, z in zip(docs["id"], docs["null"])], [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def read_block(data: bytes, k: int) -> np.ndarray:
    """One block of a segment by its index entry, without decoding what is before it."""
    _, block, ndocs, nblk, n = _HEAD.unpack_from(data)
    at = _HEAD.size + 13 * ndocs
    starts = np.frombuffer(data, "<u4", nblk, at)
    end = int(starts[k + 1]) if k + 1 < nblk else None
    first = at + starts.nbytes
    return decode_ids(np.zeros(1, np.uint32), data[first + int(starts[k]) : None if end is None else first + end], min(block, n - k * block), block)


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int | None = 1,
    segment_ids: int = 1 << 20,
    block: int = BLOCK,
    percentile: float = PERCENTILE,
) -> None:
    """Write the ids of all texts to ``path``, in ascending order of ``id_col``.

    Rows are dealt out by ranges of the id and sorted by Spark, which can spill; a task then holds one
    segment of about ``segment_ids`` ids at a time.
    """
    tok_path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = tokenizer_for(tok_path), TaskContext.get().partitionId()
        tail = [] if end_id is None else [end_id]
        doc_ids: list = []
        ids: list[np.ndarray] = []
        held = before = k = 0

        def flush() -> pa.RecordBatch:
            data = write_segment(doc_ids, ids, block, percentile)
            cols = [pa.array([x], pa.int64()) for x in (part, k, before, held)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([data], pa.binary())], ["part", "segment", "ids_before", "n_ids", "data"])

        for b in batches:
            new, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(new), 5000):
                for d, x in zip(new[lo : lo + 5000], tok.encode(texts.slice(lo, 5000))):
                    doc_ids.append(d)
                    ids.append(np.append(x, tail).astype(np.uint32))
                    held += len(ids[-1])
                    if held >= segment_ids:
                        yield flush()
                        before, k = before + held, k + 1
                        doc_ids, ids, held = [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows.repartitionByRange("i").sortWithinPartitions("i", "t").mapInArrow(
        lean(run, "tokens"), "part long, segment long, ids_before long, n_ids long, data binary"
    ).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The only thing gathered is the number of ids of each part, one row a task of the writer.
    """
    files = spark.read.parquet(path)
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    first, total = {}, 0
    for p, n in parts:
        first[p], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, data in zip(*(b.column(c).to_pylist() for c in range(3))):
                doc_ids, ids = read_segment(data)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                start = first[part] + before + np.cumsum(n) - n
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "ids_before", "data").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_roundtrip(docs: DataFrame, **options) -> DataFrame:
    """Write to a new folder of the shared store, and read back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
