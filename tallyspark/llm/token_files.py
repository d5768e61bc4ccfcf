"""Token-ID / binary output: ids of a corpus in patched frame-of-reference blocks.

A token file set is a Parquet table whose rows are segments in ascending document order (part, segment).
A segment's ``payload`` is the binary format below; ``doc_ids`` and ``doc_lengths`` say which documents it
holds. A segment holds whole documents and is closed once it has ``segment_ids`` ids.

Payload, all little-endian: magic ``PFR1``, u32 number of ids, u32 number of blocks, then the index of block
starts (u32 byte offsets from the end of the index), then the blocks of 512 ids. A block: u32 minimum,
u8 width, u8 unused, u16 number of exceptions, the 512 differences to the minimum packed with ``width`` low bits
each, then the exceptions' u16 positions and u32 whole differences. The width is the bit length of the
block's 90th percentile of differences; what doesn't fit is an exception. The last block is padded with its
minimum.

Null or empty texts give one id (the end id). Repeated documents, also with equal doc_id, are each written;
equal doc_ids are ordered by text. Null doc_ids come first. An empty table gives a file set of no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

BLOCK = 512
SEGMENT_SCHEMA = "part int, segment int, start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one row of bytes for each row of a block's values. Eight values fill ``width`` bytes."""
    eight = (values & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(len(values), -1, 8)
    out = np.zeros((*eight.shape[:2], width + 8), np.uint8)
    for k in range(8):
        byte, bit = divmod(k * width, 8)
        part = eight[:, :, k] << np.uint64(bit)
        for j in range((bit + width + 7) // 8):
            out[:, :, byte + j] |= (part >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :, :width].reshape(len(values), -1)


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    eight = rows.reshape(len(rows), -1, width)
    out = np.empty((*eight.shape[:2], 8), np.uint32)
    for k in range(8):
        byte, bit = divmod(k * width, 8)
        value = eight[:, :, byte].astype(np.uint64)
        for j in range(1, (bit + width + 7) // 8):
            value |= eight[:, :, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, :, k] = (value >> np.uint64(bit)) & np.uint64((1 << width) - 1)
    return out.reshape(len(rows), -1)


def pack_blocks(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    n = len(ids)
    if n == 0:
        return b"PFR1" + struct.pack("<II", 0, 0)
    count = -(-n // BLOCK)
    padded = np.full(count * BLOCK, ids[-1], dtype=np.uint32)
    padded[:n] = ids
    rows = padded.reshape(count, BLOCK)
    rows[-1, n - (count - 1) * BLOCK :] = rows[-1, : n - (count - 1) * BLOCK].min()
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    high = np.partition(diff, at, axis=1)[:, at]
    width = np.ceil(np.log2(high.astype(np.float64) + 1)).astype(np.uint8)
    odd = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = odd.sum(axis=1).astype(np.uint16)
    body: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        for i in range(0, len(which), 256):
            some = which[i : i + 256]
            packed = _pack(diff[some], w)
            for b, p in zip(some.tolist(), packed):
                body[b] = p.tobytes()
    blocks = []
    for b in range(count):
        spots = np.flatnonzero(odd[b]) if exceptions[b] else np.empty(0, np.int64)
        blocks.append(struct.pack("<IBBH", int(low[b]), int(width[b]), 0, int(exceptions[b])) + body[b] + spots.astype("<u2").tobytes() + diff[b, spots].astype("<u4").tobytes())
    starts = np.cumsum([0] + [len(x) for x in blocks[:-1]]).astype("<u4")
    return b"PFR1" + struct.pack("<II", n, count) + starts.tobytes() + b"".join(blocks)


def unpack_blocks(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first..last (not included); all by default. The index leads straight to the blocks asked for."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a token segment")
    n, count = struct.unpack_from("<II", payload, 4)
    last = count if last is None else min(last, count)
    starts = np.frombuffer(payload, "<u4", count, 12)
    base = 12 + 4 * count
    out = np.empty((max(0, last - first), BLOCK), dtype=np.uint32)
    heads = [struct.unpack_from("<IBBH", payload, base + int(starts[b])) for b in range(first, last)]
    widths = np.array([h[1] for h in heads], dtype=np.int64)
    data = np.frombuffer(payload, np.uint8)
    for w in np.unique(widths).tolist():
        which = np.flatnonzero(widths == w)
        for i in range(0, len(which), 256):
            some = which[i : i + 256]
            if w == 0:
                out[some] = 0
                continue
            at = base + starts[first + some].astype(np.int64) + 8
            out[some] = _unpack(data[at[:, None] + np.arange(BLOCK * w // 8)], w)
    for k, (low, w, _, odd) in enumerate(heads):
        if odd:
            at = base + int(starts[first + k]) + 8 + BLOCK * w // 8
            out[k, np.frombuffer(payload, "<u2", odd, at)] = np.frombuffer(payload, "<u4", odd, at + 2 * odd)
        out[k] += np.uint32(low)
    flat = out.reshape(-1)
    return flat[: min(n, last * BLOCK) - first * BLOCK]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = 1 << 18) -> None:
    """Encodes every whole text and writes the token file set: one range shuffle of the texts by doc_id, no global sort in one task."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = common.word_tokenizer(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        number = start = held = 0
        ids: list[bytes] = []
        names: list = []
        sizes: list[int] = []

        def close() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "segment": [number], "start": [start], "n_ids": [held], "doc_ids": [names], "doc_lengths": [sizes], "payload": [pack_blocks(np.frombuffer(b"".join(ids), "<u4"))]})

        for batch in batches:
            texts = batch["text"].tolist()
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for a, b in common.slices(texts):
                for key, data in zip(keys[a:b], coder.encode(texts[a:b])):
                    data += end
                    ids.append(data)
                    names.append(key)
                    sizes.append(len(data) // 4)
                    held += sizes[-1]
                    if held >= segment_ids:
                        yield close()
                        number, start, held = number + 1, start + held, 0
                        ids, names, sizes = [], [], []
        if names:
            yield close()

    ordered = common.texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a file set with ``base``, the number of ids in all parts before: part, segment, start, n_ids, doc_ids, doc_lengths, payload, base.

    Only one total for each part (a write task) reaches the driver.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, bases = 0, {}
    for part, n in sorted(map(tuple, totals)):
        bases[part] = before
        before += n
    known = spark.createDataFrame(list(bases.items()) or [(0, 0)], "part int, base long")
    return files.join(F.broadcast(known), "part")


def document_tokens(segments: DataFrame) -> DataFrame:
    """From the files alone, a row for each document: doc_id, start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, sizes, payload, start, base in zip(batch["doc_ids"], batch["doc_lengths"], batch["payload"], batch["start"], batch["base"]):
                data = unpack_blocks(payload).astype("<u4").tobytes()
                ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
                starts = ends - np.asarray(sizes, dtype=np.int64)
                crc = [common.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in names], dtype="Int64"), "start": starts + start + base, "n_tokens": ends - starts, "ids_crc32": crc})

    narrow = segments.select("doc_ids", "doc_lengths", "payload", "start", "base")
    return narrow.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark)
    write_token_files(common.table(spark, sf_dir, "documents"), path, common.default_tokenizer())
    return document_tokens(read_token_files(spark, path))
