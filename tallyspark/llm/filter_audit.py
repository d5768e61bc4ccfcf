"""Filter interaction audit: what each of five filters removes, alone and in every order, from one word a document.

A document's word has a bit for each of the 32 subsets of the filters: set if it survives that subset. The words of a part of
the corpus, and of a label in it, are summed by carry-save positional popcounts: full adders turn three words of a weight
into one of that weight and a carry of twice the weight, all 32 bits at once, until each weight has one word; its bits are the
digits of the 32 counts. Tasks send their counts only, which are then added up, and every figure of every order is a difference of survivors.

The filters fail a text (null: empty; words are runs between white space) with: A under 200 words; B under half of its words
distinct; C over 3 % of its code points in A-Z; D any of ``#$%&*|``; E the text of a smaller doc_id, removed or not. Texts are
compared by two 64-bit hashes. A null doc_id has no smaller one, is none, and has no label; repeated rows are documents of
their own and no copies of each other. A null lang is the empty part. Of several labels of one doc_id, any that says 1 counts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: By mask of failures, the word: the bit of each subset of filters that has none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], np.uint32)


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits."""
    out, level, weight = np.zeros(32, np.int64), words.astype(np.uint32, copy=False), 0
    while len(level):
        carries = []
        while len(level) > 1:
            m = len(level) // 3
            if m:
                a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
                both = a ^ b
                carries.append((a & b) | (both & c))
                level = np.concatenate([both ^ c, level[3 * m :]])
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        out += ((int(level[0]) >> np.arange(32)) & 1) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return out


def failures_of_text(text: Column) -> Column:
    """The mask of A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 200, distinct * 100 < n * 50, F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.char_length(text).cast("long") * 3, text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document. Rows are slim before they are shuffled, and no key is that of a group: a copy looks for its own doc_id as the first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("id"),  # so that unknown ones are spread
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failures_of_text(text).alias("mask"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(FILTERS), text).alias("h2"),
    )
    slim = common.stored(slim)
    firsts = slim.where("known").groupBy("h1", "h2").agg(F.min("id").alias("id")).select("h1", "h2", "id", F.lit(True).alias("known"), F.lit(True).alias("first"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = slim.join(said.withColumn("known", F.lit(True)), ["id", "known"], "left").join(firsts, ["id", "known", "h1", "h2"], "left")
    copy = F.when(F.col("known") & F.col("first").isNull(), 1 << 4).otherwise(0)
    return both.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


_KINDS = ["every", "good", "toxic"]


def survivors(failed: DataFrame, most: int = 10_000) -> DataFrame:
    """One row for each part: of all documents, the good and the toxic, how many survive each subset of the filters (arrays of 32)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            columns = [pa.array([sums[p][k].tolist() for p in sums], pa.list_(pa.int64())) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *columns], ["part", *_KINDS])

        for b in batches:
            part = b.column("part").dictionary_encode()
            names, at = part.dictionary.to_pylist(), part.indices.to_numpy(zero_copy_only=False)
            words = WORDS[b.column("mask").to_numpy(zero_copy_only=False)]
            within = [np.ones(len(words), bool)] + [b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in _KINDS[1:]]
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(len(names) + 1))
            for p, name in enumerate(names):
                own = order[cuts[p] : cuts[p + 1]]
                row = sums.setdefault(name, np.zeros((3, SUBSETS), np.int64))
                for k in range(3):
                    row[k] += positional_popcounts(words[own[within[k][own]]])
            if len(sums) > most:
                yield told()
                sums.clear()
        if sums:
            yield told()

    counted = failed.select("part", "mask", *_KINDS[1:]).mapInArrow(count, "part string, every array<long>, good array<long>, toxic array<long>")
    total = lambda k: F.array(*(F.sum(F.col(k)[s]) for s in range(SUBSETS))).alias(k)
    return counted.groupBy("part").agg(*map(total, _KINDS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = survivors(failures(docs, labels))
    every, full = (lambda s: F.col("every")[s]), SUBSETS - 1
    single = [1 << k for k in range(len(FILTERS))]
    fails = F.array(*(every(0) - every(f) for f in single))
    alone = F.array(*(every(full - f) - every(full) for f in single))
    # an order in which exactly the filters of s stand before f: s and the rest may each stand in any order
    orders = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
    worth = F.array(*(sum((every(s) - every(s | f)) * orders(s) for s in range(SUBSETS) if not s & f) for f in single))
    told = F.array(*(F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*(F.lit(FILTERS.index(x)) for x in p)).alias("filters"), F.array(*(F.lit(sum(1 << FILTERS.index(x) for x in p[:k])) for k in range(len(p) + 1))).alias("sets")) for p in permutations(FILTERS)))
    rows = rows.select("*", fails.alias("fails"), alone.alias("alone"), worth.alias("worth"))
    rows = rows.select("*", F.explode(told).alias("o")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before, after, own = F.col("o.sets")[F.col("step") - 1], F.col("o.sets")[F.col("step")], F.col("o.filters")[F.col("step") - 1]
    lost = lambda k: F.get(k, before) - F.get(k, after)
    return rows.select(
        "part", F.col("o.filter_order").alias("filter_order"), "step",
        F.get("every", after).alias("kept"), lost("every").alias("removed"), (F.get("fails", own) - lost("every")).alias("redundant"), F.get("alone", own).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("worth", own).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


#: The same figures by sending every kind of document through every order.
OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN said s ON s.doc_id = w.doc_id
), k AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), m AS (
  SELECT k.*, s.*, contains(fails, own) AS hit, before <> '' AND fails <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM k, s
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit AND good = 1), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
