"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes ends a chunk wherever its low bits are all ones; each chunk becomes one of 64
letters. A fingerprint is ``size:letters:letters``, the letters at block sizes ``size`` and ``2 * size``; the size is the
least power of two that makes about 64 chunks or fewer, halved while fewer than 32 come out. At most 64 letters: the
last stands for all that is left of the text. Two fingerprints are compared, at the block sizes they share, by
edit distance: likeness = 1 - distance / longer length, the best of the shared sizes, 0 if none is shared; equal
fingerprints have likeness 1.

Null texts count as empty; an empty text's fingerprint is ``8::``. Documents without a doc_id come before all others in the
order used for "next". Equal doc_ids are ordered by text. A table of one document has itself as next. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST, LONGEST, WINDOW = 8, 64, 7


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a mixed hash of it and the six before it, in blocks so that temporary arrays stay small."""
    out, step = np.empty(len(data), np.uint32), 1 << 20
    for at in range(0, len(data), step):
        part = data[max(0, at - WINDOW + 1) : at + step].astype(np.uint32)
        h = part * np.uint32(0x9E3779B1)
        for k in range(1, WINDOW):
            h[k:] += part[:-k] * np.uint32((0x9E3779B1 * (2 * k * k + 3) | 1) & 0xFFFFFFFF) if len(part) > k else np.uint32(0)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        out[at : at + step] = h[min(at, WINDOW - 1) :]
    return out


def _letters(rolled: np.ndarray, size: int) -> str:
    ends = np.flatnonzero((rolled & np.uint32(size - 1)) == size - 1) + 1
    if len(ends) and ends[-1] == len(rolled):
        ends = ends[:-1]
    starts = np.concatenate([[0], ends[: LONGEST - 1]])
    sums = np.add.reduceat(rolled, starts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return LETTERS[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{LEAST}::"
    rolled, size = _rolling(data), LEAST
    while size * LONGEST < len(data):
        size *= 2
    while size > LEAST and np.count_nonzero((rolled & np.uint32(size - 1)) == size - 1) < LONGEST // 2:
        size //= 2
    return f"{size}:{_letters(rolled, size)}:{_letters(rolled, 2 * size)}"


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of at most 64 letters, bit-parallel over a pattern and vectorized over the pairs."""
    n = len(left)
    pattern_len = np.array([len(x) for x in left])
    text_len = np.array([len(x) for x in right])
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.full(256, 0, np.int64)
    order[LETTERS] = np.arange(64)
    codes = [order[np.frombuffer("".join(x.ljust(LONGEST, "A") for x in side).encode(), np.uint8)].reshape(n, LONGEST) for side in (left, right)]
    rows, one = np.arange(n), np.uint64(1)
    equal = np.zeros((n, 64), np.uint64)
    for k in range(LONGEST):
        live = rows[pattern_len > k]
        equal[live, codes[0][live, k]] |= one << np.uint64(k)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = pattern_len.astype(np.int64)
    last = one << np.maximum(pattern_len - 1, 0).astype(np.uint64)
    for k in range(int(text_len.max(initial=0))):
        live = text_len > k
        eq = equal[rows, codes[1][:, k]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += np.where(live & (ph & last != 0), 1, 0) - np.where(live & (mh & last != 0), 1, 0)
        ph, mh = (ph << one) | one, mh << one
        plus, minus = np.where(live, mh | ~(xv | ph), plus), np.where(live, ph & xv, minus)
    return np.where(pattern_len == 0, text_len, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    pairs, owner = ([], []), []
    for i, (a, b) in enumerate(zip(left, right)):
        (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
        x, y = {int(sa): a1, 2 * int(sa): a2}, {int(sb): b1, 2 * int(sb): b2}
        for size in x.keys() & y.keys():
            pairs[0].append(x[size])
            pairs[1].append(y[size])
            owner.append(i)
    longer = np.array([max(len(a), len(b), 1) for a, b in zip(*pairs)], dtype=np.float64)
    out = np.zeros(len(left))
    if owner:
        np.maximum.at(out, np.array(owner), 1.0 - edit_distances(*pairs) / longer)
    out[[i for i, (a, b) in enumerate(zip(left, right)) if a == b]] = 1.0
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_chars": b["text"].str.len(), "fingerprint": [fingerprint(t) for t in b["text"]]})

    return common.texts_of(docs).mapInPandas(each, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, rows_per_bucket: int = 500, most_buckets: int = 10_000) -> DataFrame:
    """Deals documents into runs of doc_id, sorted, each run followed by a copy of the document after it.

    Columns: bucket, follows (0: a document of the run; 1: the copy), doc_id, text. One shuffle of the texts; only
    run boundaries, at most ``most_buckets``, reach the driver. Runs are cut at quantiles, so hot id ranges are split.
    """
    docs = common.texts_of(docs)
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null")
    total = ids.count()
    n = max(1, min(most_buckets, total // rows_per_bucket))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * most_buckets)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.where(k.isna(), 0, np.searchsorted(np.array(cuts, dtype=np.float64), k.to_numpy(dtype=np.float64, na_value=-np.inf), side="right")), dtype="int32")

    firsts = sorted(map(tuple, ids.withColumn("bucket", bucket("doc_id")).groupBy("bucket").agg(F.min("doc_id")).collect()))
    runs = [(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)]
    if not runs:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("follows"), "doc_id", "text")
    after = spark.createDataFrame(runs, "bucket int, doc_id long")
    copies = docs.join(F.broadcast(after), "doc_id").groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    dealt = docs.withColumn("bucket", bucket("doc_id")).select("bucket", F.lit(0).alias("follows"), "doc_id", "text")
    return dealt.unionByName(copies.select("bucket", F.lit(1).alias("follows"), "doc_id", "text"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the second half replaced from the next document, and their likeness."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: tuple | None = None  # (bucket, doc_id, text, fingerprint) of the last document seen
        for batch in batches:
            rows = []
            for bucket, follows, key, text in zip(batch["bucket"].tolist(), batch["follows"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist()):
                own = fingerprint(text)
                if waiting is not None and waiting[0] == bucket:
                    _, name, before, mark = waiting
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    rows.append((None if pd.isna(name) else int(name), len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, fingerprint(edited), own))
                waiting = None if follows else (bucket, key, text, own)
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["near_edited"] = likeness(out["fingerprint"].tolist(), out["edited_fingerprint"].tolist())
                out["near_next"] = likeness(out["fingerprint"].tolist(), out.pop("next").tolist())
                yield out

    runs = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", "follows", "doc_id", "text")
    return runs.mapInPandas(each, EDITED)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(common.table(spark, sf_dir, "documents"))
