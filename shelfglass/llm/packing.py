"""Packing documents into training sequences along a space-filling curve.

A document's vector (hashed byte trigrams) is projected to three dimensions, and its cell there
gives a Hilbert key. Rows are range-sorted by that key, so similar documents are neighbours, and
each range partition cuts its stream of tokens into sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfglass.llm import wordtokens
from shelfglass.llm.registry import query, read

DIMS, BITS = 3, 12
_BUCKETS = 256
_SEED = 20


def document_vectors(texts: list[bytes]) -> np.ndarray:
    """Unit vectors of hashed byte trigram counts; zero for texts under three bytes."""
    out = np.zeros((len(texts), _BUCKETS))
    for i, t in enumerate(texts):
        if len(t) > 2:
            b = np.frombuffer(t, np.uint8).astype(np.uint16)
            code = (b[:-2] * 40503 ^ b[1:-1] * 30011 ^ b[2:] * 14057) >> 8
            out[i] = np.bincount(code, minlength=_BUCKETS)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1e-300)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows), by Skilling's bit transposition."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= p
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of texts: project their vectors, cut each axis into 2 ** BITS cells."""
    axes = np.random.default_rng(_SEED).standard_normal((_BUCKETS, DIMS))
    at = document_vectors(texts) @ axes
    cells = np.clip((at / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def with_curve_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wordtokens.parts(batches, 1, wordtokens.GATHER_BYTES):
            raw = part.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(curve_keys([t or b"" for t in raw]))],
                ["key", "text", "curve"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        wordtokens.frugal(run), f"key {kind}, text string, curve bigint")


def _cut(pieces: Iterator[tuple[int, bytes, int]], length: int, width: int):
    """Cut (row, ids, tokens) into (sequence, offset, row, start, ids).

    Full sequences first; what is left at the end fills sequences of powers of two.
    """
    held: list[tuple[int, int, bytes]] = []
    filled = number = 0
    for row, ids, tokens in pieces:
        start = 0
        while start < tokens:
            take = min(tokens - start, length - filled)
            held.append((row, start, ids[start * width:(start + take) * width]))
            start, filled = start + take, filled + take
            if filled == length:
                yield from _placed(held, [length], number, width)
                held, filled, number = [], 0, number + 1
    sizes = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
    yield from _placed(held, sizes, number, width)


def _placed(held, sizes: list[int], number: int, width: int):
    at = 0
    sizes = list(sizes)
    for row, start, ids in held:
        left = len(ids) // width
        while left:
            take = min(left, sizes[0] - at)
            yield number, at, row, start, ids[:take * width]
            ids, start, left, at = ids[take * width:], start + take, left - take, at + take
            if at == sizes[0]:
                sizes, number, at = sizes[1:], number + 1, 0


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 2048,
         end_id: int = 1, path: str = wordtokens.VOCABULARY) -> DataFrame:
    """One row per piece: key, sequence_id, offset, start, doc_tokens, ids (little-endian 32-bit).

    A document's ids are those of its text and ``end_id``. Every id lies in exactly one piece,
    and the pieces of a sequence follow each other from offset 0 without gaps. All sequences hold
    ``length`` ids but the last few of a range partition, whose sizes are powers of two, so none
    needs padding. A null or empty text is the end id alone; repeated rows are packed each; equal
    keys on the curve are spread by a hash of the key column; other columns are not read; an
    empty table gives an empty result. A task streams its rows; it holds one batch and a sequence.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = wordtokens.tokenizer(path).encode
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        keys: list = []
        key_type = None
        out: list[tuple] = []
        totals: list[int] = []

        def pieces():
            nonlocal key_type
            for batch in wordtokens.parts(batches, 1, wordtokens.SLICE_BYTES):
                key_type = batch.column(0).type
                for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)),
                                  strict=True):
                    raw = ids.astype("<u4").tobytes() + end
                    keys.append(k)
                    totals.append(len(raw) // 4)
                    yield len(keys) - 1, raw, len(raw) // 4

        def flush():
            rows = [r[2] for r in out]
            return pa.RecordBatch.from_arrays([
                pa.array([keys[r] for r in rows], key_type),
                pa.array([base + r[0] for r in out], pa.int64()),
                pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[3] for r in out], pa.int64()),
                pa.array([totals[r] for r in rows], pa.int64()),
                pa.array([r[4] for r in out], pa.binary())],
                ["key", "sequence_id", "offset", "start", "doc_tokens", "ids"])

        held = 0
        for piece in _cut(pieces(), length, 4):
            out.append(piece)
            held += len(piece[4])
            if held > 4_000_000:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    placed = with_curve_key(docs, key, text).withColumn("tie", F.xxhash64("key")).repartitionByRange(
        "curve", "tie").sortWithinPartitions("curve", "tie", "key", "text")
    return placed.select("key", "text").mapInArrow(
        wordtokens.frugal(run), f"key {kind}, sequence_id bigint, offset bigint, start bigint, doc_tokens bigint, "
                                "ids binary").withColumnRenamed("key", key)


@query("op6_curve_packing")
def op6_curve_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
