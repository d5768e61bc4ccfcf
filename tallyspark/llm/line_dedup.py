"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are compared with white space at their ends removed; lines without words are neither compared nor deleted. A window
is a run of consecutive such lines that just reaches ``words`` words, grown forward from a line or backward to one. Of each
window the place of its smallest line hash (the first, in ties) is selected; neighbouring windows mostly select the same place, so
a text has far fewer fingerprints than windows. Every repeated run of at least ``words`` words contains whole
windows, whose minima stand at the same place in every copy: such a run can't be missed.

Fingerprints are joined on the line hash: most meet no other and are done with. A frequent line meets many, so of the
places left the windows that selected them are compared by their hashes, each with the earliest of its kind, by (doc_id,
line), and no two places are paired otherwise. Matched windows that overlap or touch make up one run, the match extended both
ways as far as lines agree (all windows in a longer match are matched); later runs are deleted.

So a line goes if and only if it is part of a run of consecutive lines, of at least ``words`` words together, that also stands
at an earlier place. The first copy of a line always stays.

Null texts stay null and empty ones empty; no row is dropped, also where all of its lines go (its text is then empty).
Repeated rows (equal doc_id and text) are one document and get the same result; equal doc_ids with different texts
are ordered by a hash of the text. Null doc_ids come first. Columns other than text come back unchanged, n_chars
too, if there, except that it is set to the new length where lines were deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

#: White space at a line's ends, and between words, as everywhere in these operators.
_EDGES, _SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", r"[\x20\x09-\x0D]+"


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart, and the text with null as empty. Structs compare equal also where the doc_id in them is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h")), text


def lines_of(docs: DataFrame) -> DataFrame:
    """One row for each line with words: doc (doc_id, hash of the text), line number from 0, hash, words. By document, repeated rows once."""
    key, text = _key(docs)
    lines = docs.select(key.alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    lines = lines.select("doc", "line", F.regexp_replace("text", _EDGES, "").alias("text")).where("text != ''")
    lines = lines.select("doc", "line", F.xxhash64("text").alias("hash"), F.size(F.split("text", _SPACE)).cast("long").alias("words"))
    return lines.repartition("doc").dropDuplicates(["doc", "line"])


def fingerprints_of(lines: DataFrame, words: int) -> DataFrame:
    """The selected places: minimum (the line hash there), doc, spot, and the windows that selected it (first place, size, hash of all lines).

    Places count a document's lines with words from 1. A window has at most ``words`` lines, as each has a word.
    """
    by_doc = Window.partitionBy("doc")
    at = lines.withColumn("place", F.row_number().over(by_doc.orderBy("line")))
    at = at.withColumn("through", F.sum("words").over(by_doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("before", F.col("through") - F.col("words"))
    ahead, behind = by_doc.orderBy("before").rangeBetween(0, words - 1), by_doc.orderBy("through").rangeBetween(1 - words, 0)
    at = at.select(
        "doc", "place",
        F.collect_list("hash").over(ahead).alias("ahead"), F.sum("words").over(ahead).alias("ahead_words"),
        F.collect_list("hash").over(behind).alias("behind"), F.sum("words").over(behind).alias("behind_words"),
    )
    back = (F.col("place") - F.size("behind") + 1).alias("first")
    both = F.array(F.struct(F.col("place").alias("first"), F.col("ahead").alias("run"), F.col("ahead_words").alias("n")), F.struct(back, F.col("behind").alias("run"), F.col("behind_words").alias("n")))
    runs = at.select("doc", F.explode(both).alias("w")).where(F.col("w.n") >= words)
    runs = runs.select("doc", F.col("w.first").alias("first"), F.size("w.run").alias("size"), F.xxhash64("w.run").alias("hash"), F.array_min("w.run").alias("minimum"), F.array_position("w.run", F.array_min("w.run")).cast("int").alias("nth"))
    return runs.groupBy("doc", (F.col("first") + F.col("nth") - 1).alias("spot"), "minimum").agg(F.collect_set(F.struct("first", "size", "hash")).alias("windows"))


def repeated_runs(docs: DataFrame, words: int = 50) -> DataFrame:
    """doc, runs: the (first, last) places to delete, rising and apart, for each document that loses any."""
    prints = common.stored(fingerprints_of(lines_of(docs), words))
    place = F.struct("doc", "spot")
    met = prints.groupBy("minimum").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("minimum")
    windows = prints.join(met, "minimum", "left_semi").select("minimum", "doc", F.explode("windows").alias("w")).select("minimum", "doc", "w.*")
    windows = common.stored(windows)
    start = F.struct("doc", "first")
    origins = windows.groupBy("minimum", "hash").agg(F.min(start).alias("origin"), F.max(start).alias("last")).where("origin < last").drop("last")
    matched = windows.join(origins, ["minimum", "hash"]).where(start > F.col("origin")).select("doc", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    # gaps and islands: a window that neither overlaps nor touches those before it begins a run
    by_doc = Window.partitionBy("doc").orderBy("first", "last")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = matched.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("doc", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return islands.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, words: int = 50) -> DataFrame:
    """The documents with every later copy of a repeated run of lines deleted; the columns stay as they are."""
    key, text = _key(docs)
    runs = common.stored(repeated_runs(docs, words))
    both = docs.select(F.struct("*").alias("row"), key.alias("doc"), text.alias("text")).join(runs.hint("merge"), "doc", "left")
    lines = F.split("text", "\n")
    worded = F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)))
    gone = F.transform(F.array(worded), lambda w: F.flatten(F.transform("runs", lambda r: F.slice(w, r["first"], r["last"] - r["first"] + 1))))
    both = both.withColumn("gone", F.when(F.col("runs").isNotNull(), F.get(gone, F.lit(0))))
    # a lambda over an array of one names the lines, so that the text is split once and not for each line
    left = F.transform(F.array(lines), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)))
    new = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.get(left, F.lit(0)), "\n"))
    both = both.select("row", "gone", new.alias("new"))
    columns = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        columns.append((F.col("new") if c == "text" else F.when(F.col("gone").isNull(), own).otherwise(F.char_length("new").cast(docs.schema[c].dataType)) if c == "n_chars" else own).alias(c))
    return both.select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")  # what the SQL returns too
    return dedup_lines(docs)


#: The same rows by another way: a line goes if it lies in a window that stands earlier too.
OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS line, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), t AS (
  SELECT doc_id, line, regexp_replace(raw, '^[ 	-
]+|[ 	-
]+$', '', 'g') AS x FROM l
), w AS (
  SELECT doc_id, line, x, len(string_split_regex(x, '[ 	-
]+')) AS words FROM t WHERE x <> ''
), c AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place,
    CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through FROM w
), r AS (
  SELECT doc_id, place,
    list(x) OVER ahead AS ax, sum(words) OVER ahead AS aw, list(x) OVER behind AS bx, sum(words) OVER behind AS bw
  FROM (SELECT *, through - words AS before FROM c)
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         behind AS (PARTITION BY doc_id ORDER BY through RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), v AS (
  SELECT doc_id, place AS a, place + len(ax) - 1 AS b, md5(array_to_string(ax, chr(10))) AS h FROM r WHERE aw >= 50
  UNION SELECT doc_id, place - len(bx) + 1, place, md5(array_to_string(bx, chr(10))) FROM r WHERE bw >= 50
), o AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) AS k FROM v
), gone AS (
  SELECT DISTINCT c.doc_id, c.line FROM o JOIN c ON c.doc_id = o.doc_id AND c.place BETWEEN o.a AND o.b WHERE o.k > 1
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, kept.text FROM documents d LEFT JOIN kept USING (doc_id)
"""
