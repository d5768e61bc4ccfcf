"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids; only longer documents are cut. Bins are chosen over the
histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus holds: a bin starts from
the longest length left, a bitset subset-sum over the available lengths finds the fullest feasible filling of
the rest, and that combination is removed as often as the counts allow. The chosen combinations form a slot
table, also bounded by the capacity, that turns a piece's rank among the pieces of its length into its
sequence and offset.

Null and empty texts give a piece with the end id alone. Repeated rows are separate documents. Empty tables give no
rows. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = common.word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].tolist()
            for a, b in common.slices(texts):
                rows = []
                for key, data in zip(keys[a:b], coder.encode(texts[a:b])):
                    data += end
                    key = None if pd.isna(key) else int(key)
                    rows += [(key, k, at // 4, len(data[at : at + 4 * capacity]) // 4, common.crc32(data[at : at + 4 * capacity])) for k, at in enumerate(range(0, len(data), 4 * capacity))]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return common.texts_of(docs).mapInPandas(cut, PIECES)


def fullest(counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """The subset of the available lengths with the largest sum of at most ``space``: (length, times) pairs.

    Bit s of a reach set says that sum s can be had; multiples of a length are added by doubling steps.
    """
    mask, steps, reach = (1 << (space + 1)) - 1, [], 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], space // length) if length else 0
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> space & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            used[length] = used.get(length, 0) + times
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, times), ...]) until the histogram is used up."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        rest = fullest({k: v for k, v in left.items() if v > 0}, capacity - first)
        left[first] += 1
        bin_ = dict(rest)
        bin_[first] = bin_.get(first, 0) + 1
        times = min(left[k] // m for k, m in bin_.items())
        out.append((times, sorted(bin_.items(), reverse=True)))
        for k, m in bin_.items():
            left[k] -= times * m
            if not left[k]:
                del left[k]
    return out


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of this length in a bin, offset of the first of them)."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, content in bins:
        offset = 0
        for length, m in content:
            rows.setdefault(length, []).append((taken.get(length, 0), sequence, m, offset))
            taken[length] = taken.get(length, 0) + times * m
            offset += length * m
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``length`` of 1 to capacity.

    Ranks within a length come from a range partitioning by (length, hash of the piece), so a length that
    holds most pieces is spread over many tasks; one count for each task and length met there reaches the driver.
    """
    names = pieces.columns
    kept = common.stored(pieces)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            batch["part"] = part
            batch["rank"] = batch.groupby("length").cumcount()
            batch["rank"] += batch["length"].map(seen).fillna(0).astype("int64")
            for k, n in batch["length"].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            yield batch

    spread = kept.withColumn("mix", F.xxhash64(*names)).repartitionByRange("length", "mix").drop("mix")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", part int, rank long"
    ranks = common.stored(spread.mapInPandas(ranked, schema))
    met = sorted(map(tuple, ranks.groupBy("part", "length").agg(F.count("*").alias("n")).collect()))
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for part, length, n in met:
        before[part, length] = histogram.get(length, 0)
        histogram[length] = before[part, length] + n
    plan = slots(minimum_bin_slack(histogram, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (part, length), some in batch.groupby(["part", "length"]):
                rank = some["rank"].to_numpy() + before[int(part), int(length)]
                table = plan[int(length)]
                row = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
                behind = rank - row[:, 0]
                out.append(some[names].assign(sequence_id=row[:, 1] + behind // row[:, 2], offset=row[:, 3] + behind % row[:, 2] * int(length)))
            if out:
                yield pd.concat(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id long, offset long"
    return ranks.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(token_pieces(docs, tokenizer or common.default_tokenizer(), end_id, capacity), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
