"""Suffix-array dedup: bytes covered by a repeated string of ``length`` bytes go, found by merging shard Burrows-Wheeler transforms.

Every window (string of ``length`` bytes inside a document) is owned by its anchor, the first of the least hashes of the 32-byte strings in
it, so equal windows have equal anchors at equal places. Neighbouring windows of one anchor make up a piece, and pieces with equal bytes are one piece with a count.
An anchor that stands once in the corpus repeats nothing, and its bytes never leave the first scan. Pieces that share an anchor but differ
are brought together by anchor, many small buckets of them, and there:

* the bucket is cut into shards; each shard's suffixes are sorted and its transform and last-to-first map written down;
* the shards' rows are interleaved by refinement: a round reads the transform in the present interleave and deals the rows out by
  what it reads, stably, which puts them in order of STEP more bytes. No suffix is compared or sorted again;
* rows that a round tells apart for the first time get their common prefix then. Rows still together after ``length`` bytes are
  the repeated intervals; counts of the pieces they stand in say how often they occur.

Of pieces with an anchor of their own that stand more than once, every window repeats as it is. An anchor with over ``most`` different pieces
(near copies by the million) would be a large bucket: its pieces are dealt out by the hash of each window instead, 128 bits, summed before the shuffle.

What goes is judged on the input: the first copy goes too. Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Null
doc_ids, repeated rows and equal doc_ids with different texts are documents of their own, told apart by doc_id and a 64-bit hash of the text, and copies
count as other places. Anchors and pieces are compared by 64-bit hashes each, within one anchor. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

LENGTH, GRAM, STEP = 200, 32, 16
#: Bytes that a bucket, a shard and a scan aim at.
BUCKET, SHARD, PART = 120_000, 30_000, 500_000

_U = np.uint64
#: A place within a part and what stands over.
_PLACE = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


_BYTES = _mixed(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.cumprod(out)


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on."""
    h, step, base = _BYTES[buf], 1, _BASE
    while step < gram:
        h = h[:-step] * _U(base) + h[step:]
        base, step = base * base % (1 << 64), step * 2
    return _mixed(h)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of n neighbours from each place on."""
    step = 1
    while step * 2 <= n:
        h, step = np.minimum(h[:-step], h[step:]), step * 2
    return np.minimum(h[: len(h) - (n - step)], h[n - step :]) if n > step else h


def pieces_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, part: int = PART) -> tuple[np.ndarray, ...]:
    """document (place in the list), start, windows, anchor, hash of each piece, for all texts in turn. Longer texts are gone through in parts of ``part`` windows."""
    cut = [(i, at, t[at : at + part + length - 1] if len(t) > part else t) for i, t in enumerate(texts) for at in range(0, max(len(t) - length + 1, 0), part)]
    found = []
    while cut:
        n = size = 0
        while n < len(cut) and (not n or size + len(cut[n][2]) < part):
            size, n = size + len(cut[n][2]), n + 1
        found.append(_pieces(cut[:n], length, gram))
        cut = cut[n:]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _pieces(parts: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchor of a window is the first of its least hashes, so that no two windows of a piece are equal, not even in periodic texts."""
    sizes = np.array([len(t) for _, _, t in parts], np.int64)
    ends = np.cumsum(sizes)
    begins, windows, n = ends - sizes, sizes - length + 1, int(ends[-1])
    h = _gram_hashes(np.frombuffer(b"".join(t for _, _, t in parts) + bytes(length + gram), np.uint8), gram)
    # the least hash by its upper bits, and where it stands in the lower ones
    least = _least((h & _U(~_PLACE & (1 << 64) - 1)) | np.arange(len(h), dtype=_U), length - gram + 1)[:n]
    edge = np.zeros(n + 1, np.int8)
    edge[begins] += 1
    edge[begins + windows] -= 1
    new = np.cumsum(edge[:n], dtype=np.int8) > 0
    new[1:] &= least[1:] != least[:-1]
    new[begins] = True
    start = np.flatnonzero(new)
    which = np.searchsorted(ends, start, side="right")
    stop = np.minimum(np.append(start[1:], n), (begins + windows)[which])
    total = np.concatenate([np.zeros(1, _U), np.cumsum(h[:n] * _powers(_BASE, n))])
    value = (total[stop + length - gram] - total[start]) * _powers(_BACK, n)[start]
    anchor = h[(least[start] & _U(_PLACE)).astype(np.int64)]
    doc, at = np.array([x[0] for x in parts]), np.array([x[1] for x in parts])
    return doc[which], start - begins[which] + at[which], stop - start, anchor.view(np.int64), _mixed(value).view(np.int64)


# --- shard transforms and their merge --------------------------------------------------------------------------------


def _order(codes: np.ndarray) -> np.ndarray:
    """Stable order of codes, by counting: 16 bits at a time."""
    if len(codes) and codes.dtype == np.uint16:
        return np.argsort(codes, kind="stable")
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((codes[low] >> 16).astype(np.uint16), kind="stable")]


def _ranked(keys: np.ndarray) -> np.ndarray:
    found, codes = np.unique(keys, return_inverse=True)
    return codes.astype(np.uint16 if len(found) <= 1 << 16 else np.uint32)


def _codes(buf: np.ndarray, around: dict[int, np.ndarray], step: int) -> dict[int, np.ndarray]:
    """Order-keeping codes of the step // 2 and of the step bytes from each place on; around: the place so many bytes further, round each shard's end."""
    half, wide, k = step // 2, buf.astype(_U), 1
    while k < half:  # half is 8 at most, so its bytes fit into one number
        wide, k = (wide << _U(8 * k)) | wide[around[k]], k * 2
    short = _ranked(wide)
    return {half: short, step: _ranked((short.astype(_U) << _U(32)) | short[around[half]])}


def _rounds(length: int, step: int) -> list[int]:
    return [step // 2] * (length % step // (step // 2)) + [step] * (length // step)


def merged_intervals(texts: list[bytes], length: int = LENGTH, step: int = STEP, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, prefix, place): the merged suffix order of all texts as places in their concatenation, the common prefix of each row with the one
    before (as of the round that told them apart, ``length`` at most), and where each text begins. ``length`` is a multiple of step // 2, and no text is shorter.

    Texts of a shard stand one after the other and round; a window that leaves its text isn't one, and callers leave it out.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    which = begins // shard  # a shard begins with the first text past each multiple
    firsts = begins[np.append(True, which[1:] != which[:-1])]
    lasts = np.append(firsts[1:], n)
    low, high = np.repeat(firsts, lasts - firsts), np.repeat(lasts, lasts - firsts)
    place, around, back = np.arange(n), {}, {}
    k = 1
    while k <= step // 2:
        around[k] = np.where(place + k < high, place + k, place + k - high + low)
        k *= 2
    codes = _codes(buf, around, step)
    for k in codes:
        back[k] = np.where(place - k >= low, place - k, place - k + high - low)
    rounds = _rounds(length, step)
    rows = np.empty(n, np.int64)  # the shards' suffix orders, one after the other
    for a, b in zip(firsts, lasts):
        order = np.arange(a, b)
        for k in rounds:
            order = back[k][order]
            order = order[_order(codes[k][order])]
        rows[a:b] = order
    rank = np.empty(n, np.int64)
    rank[rows] = place
    transform = {k: codes[k][back[k][rows]] for k in set(rounds)}  # the bytes before each row
    first = {k: rank[back[k][rows]] for k in set(rounds)}  # last to first
    del rank, back, around
    woven, block, prefix, depth = place, np.zeros(n, np.int64), np.full(n, length, np.int64), 0
    prefix[:1] = 0
    for k in rounds:
        read = transform[k][woven]
        order = _order(read)
        woven, read, block = first[k][woven][order], read[order], block[order]
        apart = np.append(False, (read[1:] != read[:-1]) | (block[1:] != block[:-1]))
        prefix[apart & (prefix == length)] = depth
        block, depth = np.cumsum(apart), depth + k
    prefix[np.append(False, block[1:] == block[:-1])] = length
    return rows[woven], prefix, begins


def repeated_windows(texts: list[bytes], counts: np.ndarray, length: int = LENGTH, step: int = STEP, shard: int = SHARD) -> list[np.ndarray]:
    """For each text (at least ``length`` bytes, standing ``counts`` times) which of its windows stand at two places or more."""
    rows, prefix, begins = merged_intervals(texts, length, step, shard)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[rows]
    whole = rows - begins[owner] <= sizes[owner] - length
    interval = np.cumsum(prefix < length) - 1 if len(rows) else rows
    often = np.bincount(interval, np.where(whole, counts[owner], 0))
    hit = np.zeros(len(rows), bool)
    hit[rows] = whole & (often[interval] >= 2)
    return [hit[b : b + s - length + 1] for b, s in zip(begins.tolist(), sizes.tolist())]


def covered(hit: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The (from, to) bytes that the windows marked in hit cover, rising and apart."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist()))


# --- the Spark job ----------------------------------------------------------------------------------------------------

_MARKS = "anchor long, hash long, marks array<struct<a:int,b:int>>"


def _texts(docs: DataFrame) -> DataFrame:
    return common.texts_of(docs).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each piece: doc_id, th, start, windows, anchor, hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in common.slices(texts, 4 * PART):
                doc, start, windows, anchor, value = pieces_of(texts[i:j], length, gram)
                own = b.select(["doc_id", "th"]).take(pa.array(doc + i))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(anchor), pa.array(value)], ["doc_id", "th", "start", "windows", "anchor", "hash"])

    return _texts(docs).mapInArrow(scan, "doc_id long, th long, start int, windows int, anchor long, hash long")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces, each from the document named in it."""
    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "anchor", "hash", "n", "kinds")).alias("wanted"))
    texts = _texts(docs).alias("t").join(by_doc.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th")))
    one = texts.select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                for i in range(0, len(wanted), 2000):
                    some = wanted[i : i + 2000]
                    yield pa.RecordBatch.from_pylist([{"anchor": w["anchor"], "hash": w["hash"], "n": w["n"], "kinds": w["kinds"], "bytes": text[w["start"] : w["start"] + w["windows"] + length - 1]} for w in some], schema=_CUT)

    return one.mapInArrow(cut, "anchor long, hash long, n long, kinds long, bytes binary")


_CUT = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("bytes", pa.binary())])


def _by_bucket(cut: DataFrame, buckets: int, length: int) -> DataFrame:
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "hash"]).sort_values(["anchor", "hash"])
        hits = repeated_windows(group["bytes"].tolist(), group["n"].to_numpy(), length)
        marks = [[{"a": a, "b": b} for a, b in covered(h, length)] for h in hits]
        return pd.DataFrame({"anchor": group["anchor"].to_numpy(), "hash": group["hash"].to_numpy(), "marks": marks})

    return cut.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(merge, _MARKS).where("size(marks) > 0")


def _by_window(cut: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors of very many pieces: windows counted by two 64-bit hashes, whatever piece they stand in."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["bytes"]) - length + 1
                h = _gram_hashes(np.frombuffer(row["bytes"], np.uint8), gram)
                sums = [np.append(_U(0), np.cumsum(x * _powers(_BASE, len(x)))) for x in (h, _mixed(h ^ _U(_BASE)))]
                two = [_mixed((s[length - gram + 1 :] - s[:n]) * _powers(_BACK, n)).view(np.int64) for s in sums]
                same = [np.full(n, row[k]) for k in ("anchor", "hash", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, np.arange(n, dtype=np.int32), *two)], ["anchor", "hash", "n", "at", "w1", "w2"])

    rows = common.stored(cut.mapInArrow(windows, "anchor long, hash long, n long, at int, w1 long, w2 long"))
    twice = rows.groupBy("w1", "w2").agg(F.sum("n").alias("often")).where("often > 1").drop("often")
    found = rows.join(twice, ["w1", "w2"]).groupBy("anchor", "hash").agg(F.collect_set("at").alias("at"))
    spans = F.udf(lambda at: covered(np.isin(np.arange(max(at) + 1), at), length), "array<struct<a:int,b:int>>")
    return found.select("anchor", "hash", spans("at").alias("marks"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 5000) -> DataFrame:
    """doc_id, th (hash of the text), spans: the (a, b) bytes to remove, which may overlap; documents that lose none aren't listed."""
    if length % (STEP // 2) or length <= gram:
        raise ValueError(f"length is a multiple of {STEP // 2} over {gram}")
    scan = common.stored(_scan(docs, length, gram))
    several = scan.groupBy("anchor").agg(F.count("*").alias("often")).where("often > 1").select("anchor")
    rows = common.stored(scan.join(several, "anchor", "left_semi"))
    # first() of several columns is of one row, whichever it is
    pieces = rows.groupBy("anchor", "hash").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "th", "start", "windows")))
    kinds = pieces.groupBy("anchor").agg(F.count("*").alias("kinds"))
    pieces = common.stored(pieces.join(kinds, "anchor"))
    alone = pieces.where("kinds = 1").select("anchor", "hash", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") + (length - 1)).cast("int").alias("b"))).alias("marks"))
    size = pieces.where("kinds > 1").agg(F.sum(F.col("windows") + (length - 1)).alias("bytes"), F.max("kinds").alias("kinds")).first()
    marks = alone
    if size["bytes"]:
        cut = common.stored(_cut(docs, pieces.where("kinds > 1"), length))
        marks = marks.unionByName(_by_bucket(cut.where(F.col("kinds") <= most).select("anchor", "hash", "n", "bytes"), int(size["bytes"]) // BUCKET + 1, length))
        if size["kinds"] > most:
            marks = marks.unionByName(_by_window(cut.where(F.col("kinds") > most).dropDuplicates(["anchor", "hash"]), length, gram))
    marks = common.stored(marks)
    found = rows.join(marks, ["anchor", "hash"]).select("doc_id", "th", "start", F.explode("marks").alias("m"))
    return found.groupBy("doc_id", "th").agg(F.collect_set(F.struct((F.col("start") + F.col("m.a")).alias("a"), (F.col("start") + F.col("m.b")).alias("b"))).alias("spans"))


def _joined(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["a"], x["b"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 5000) -> DataFrame:
    """doc_id, kept (the bytes left), spans: the maximal (a, b) byte runs removed. One row for each document."""
    spans = common.stored(repeated_spans(docs, length, gram, most))
    both = _texts(docs).alias("t").join(spans.alias("s").hint("merge"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.th") == F.col("s.th")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, runs = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                gone = _joined(spans or [])
                edges = [0, *(x for s in gone for x in s), len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])) if gone else text)
                runs.append([{"a": i, "b": j} for i, j in gone])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["doc_id", "kept", "spans"])

    return both.select("t.doc_id", "t.text", "s.spans").mapInArrow(remove, "doc_id long, kept binary, spans array<struct<a:int,b:int>>")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(common.table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + (s["b"] - s["a"]))
    return left.select("doc_id", (F.length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by counting every window's hash.
OP11_SQL = """
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS x FROM documents
), n AS (
  SELECT *, octet_length(x) AS n FROM t
), w AS (
  SELECT r, i, md5(x[i + 1 : i + 200]) AS h FROM (SELECT r, x, unnest(range(n - 199)) AS i FROM n WHERE n >= 200)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1
), s AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit
), runs AS (
  SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM s) GROUP BY r, g
), edges AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM runs
), parts AS (
  SELECT n.r, e.from_ AS a, e.a AS b FROM n JOIN edges e USING (r)
  UNION ALL
  SELECT n.r, coalesce(l.b, 0), n.n FROM n LEFT JOIN (SELECT r, max(b) AS b FROM runs GROUP BY r) l USING (r)
), kept AS (
  SELECT p.r, string_agg(hex(n.x[p.a + 1 : p.b]), '' ORDER BY p.a) AS k FROM parts p JOIN n USING (r) WHERE p.b > p.a GROUP BY p.r
), gone AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY r
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(g.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.k, ''))) AS kept_sha256
FROM n LEFT JOIN gone g USING (r) LEFT JOIN kept k USING (r)
"""
