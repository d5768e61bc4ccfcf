"""Quoted files read by as many tasks as they have blocks, with each record's place in the order of the files.

Spark's text reader deals a file out by blocks, and a line belongs to the block it begins in. Whether a line begins inside a quoted
cell can't be seen in the block, so two passes go over the lines:

1. each block counts its quotes, and what its brackets add to the depth if it began outside quotes and if it began inside; one
   small row a block, combined along each file to the state that every block begins in;
2. every block is cut into records by itself. What a record has in other blocks than its first (a cell with a line end across a block's edge) comes
   out as fragments; only if there are any, a third pass reads those blocks' fragments and puts each record together from its own.

A record's ordinal is the bytes of all files before, by name, plus the block's start, plus its number in the block: it rises along
each file and from file to file, and needs no count of records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.sources.shared import stored

#: With more blocks than this (some 128 TB at Spark's own block size), their rows are joined to the lines by a shuffle.
MOST_BLOCKS = 1_000_000


class CsvCells:
    """Cells by header name. As in the files' own dialect, a quote anywhere opens or closes, a doubled one inside is a quote, CR ends a record too, and empty lines are none."""

    separator, strict = "\n", False

    def __init__(self, columns: list[str]):
        self.columns = columns

    def counted(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line its quotes, and what it adds to the depth from outside and from inside quotes: nothing."""
        none = np.zeros(len(values), np.int64)
        return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64), none, none

    def cells_of(self, text: str) -> list[list[str]]:
        """The records of a text that ends outside quotes: one, or more where CR ends them."""
        if '"' not in text:
            return [r.split(",") for r in text.split("\r") if r]
        out, row, cell, begun, parts = [], [], "", False, text.split('"')
        for k, part in enumerate(parts):
            if k % 2:
                cell, begun = cell + part, True
            elif not part and 0 < k < len(parts) - 1:
                cell += '"'
            else:
                for j, piece in enumerate(part.split("\r")):
                    if j:
                        if begun or row or cell:
                            out.append([*row, cell])
                        row, cell, begun = [], "", False
                    first, *rest = piece.split(",")
                    cell += first
                    for x in rest:
                        row.append(cell)
                        cell, begun = x, True
        return [*out, [*row, cell]] if begun or row or cell else out

    def header(self, text: str) -> str | None:
        found = self.cells_of(text)
        return json.dumps([h.strip().strip("\ufeff").strip() for h in found[0]]) if found else None

    def rows_of(self, text: str, header: str | None, first: bool) -> list[list[str]]:
        """The wanted cells of each record, missing ones empty. The first record of a file is its header."""
        found, names = self.cells_of(text), json.loads(header or "[]")
        if first:
            found = found[1:]
        at = [names.index(c) if c in names else -1 for c in self.columns]
        return [[r[i] if 0 <= i < len(r) else "" for i in at] for r in found]


class JsonObjects:
    """The objects of a JSON array, cut behind their closing brackets; anything but an array of objects is an error."""

    separator, strict = "}", True
    _escape, message = re.compile(r"\\."), "labels must be a JSON array of objects"

    def __init__(self, columns: list[str]):
        self.columns = columns

    def counted(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        quotes, outside, inside = [], [], []
        for v in values.to_pylist():
            parts = self._escape.sub("", v).split('"')
            opens = [p.count("{") for p in parts]
            odd = len(parts) % 2 == 0  # quotes are odd: it ends on the other side
            quotes.append(len(parts) - 1)
            outside.append(sum(opens[::2]) - (not odd))
            inside.append(sum(opens[1::2]) - odd)
        return np.array(quotes, np.int64), np.array(outside, np.int64), np.array(inside, np.int64)

    def header(self, text: str) -> str | None:
        return ""

    def rows_of(self, text: str, header: str | None, first: bool) -> list[list[str | None]]:
        """One object with what stands before it; or what stands after the last one."""
        body = text.strip()
        if body in (("[]", "]") if not first else ("[]",)) or re.fullmatch(r"\[\s*\]", body):
            return []
        if body[:1] != ("[" if first else ","):
            raise ValueError(self.message)
        try:
            row = json.loads(body[1:] + "}")
        except ValueError as e:
            raise ValueError(self.message) from e
        if not isinstance(row, dict) or not any(row.get(c) is not None for c in ("record_id", "true_cause")):
            raise ValueError(self.message)
        return [[None if row.get(c) is None else row[c] if isinstance(row[c], str) else json.dumps(row[c]) for c in self.columns]]


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of lines of one block, and whether the block is a new one. A block's lines come one after the other."""
    known = None
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file").dictionary_encode(), b.column("start").to_numpy(zero_copy_only=False)
        kind = file.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (start[1:] != start[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            key = (file[i].as_py(), int(start[i]))
            yield b.slice(i, j - i), key != known
            known = key


def _lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.text(path, lineSep=separator).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))


def _measured(lines: DataFrame, form) -> DataFrame:
    """One row a block: the state it begins in, whether it ends inside a record, its place in all bytes, its file's header."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([at | {"header": form.header(at["header"]) if at["start"] == 0 else None}], schema=schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("header", pa.string())])
        done = False
        for b, new in _blocks_in(batches):
            if new:
                if at:
                    yield told()
                at, done = {"file": b.column("file")[0].as_py(), "start": b.column("start")[0].as_py(), "size": b.column("size")[0].as_py(), "quotes": 0, "outside": 0, "inside": 0, "header": ""}, False
            quotes, outside, inside = form.counted(b.column("value"))
            before = (at["quotes"] + np.cumsum(quotes) - quotes) % 2
            at["outside"] += int(np.where(before, inside, outside).sum())
            at["inside"] += int(np.where(before, outside, inside).sum())
            if at["start"] == 0 and not done:
                for v, closed in zip(b.column("value").to_pylist(), ((before + quotes) % 2 == 0).tolist()):
                    at["header"] += v
                    done = closed and at["header"].strip("\r\n") != ""
                    if done:
                        break
                    at["header"] = at["header"] + form.separator if not closed else ""
            at["quotes"] += int(quotes.sum())
        if at:
            yield told()

    rows = stored(lines.mapInArrow(measure, "file string, start long, size long, quotes long, outside long, inside long, header string"))
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(along), F.lit(0)) % 2)
    rows = rows.withColumn("deep", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("deep").over(along), F.lit(0)))
    rows = rows.withColumn("open", (F.col("odd") != 0) | (F.col("depth") > 0)).withColumn("ends_open", ((F.col("odd") + F.col("quotes")) % 2 != 0) | (F.col("depth") + F.col("deep") > 0))
    # one row a file, and one a block: small
    files = rows.groupBy("file").agg(F.max("size").alias("size"), F.max("header").alias("header"))
    files = files.select("file", "header", (F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("file")) - F.col("size")).alias("before"))
    state = ["file", "start", "odd", "depth", "open", "ends_open", (F.col("depth") + F.col("deep")).alias("end_depth")]
    return rows.select(*state).join(files, "file").select("*", (F.col("before") + F.col("start")).alias("offset"))


def read_records(spark: SparkSession, path: str, form, ordinal: str | None = None) -> DataFrame:
    """The records of all files below path as text columns; with ``ordinal``, beside them a long that rises in the order of the files."""
    lines = _lines(spark, path, form.separator)
    blocks = stored(_measured(lines, form))
    seen = blocks.agg(F.count("*").alias("n"), F.count_if("ends_open").alias("open")).first()
    if form.strict and not blocks.groupBy("file").agg(F.max_by("end_depth", "start").alias("depth")).where("depth != -1").isEmpty():
        raise ValueError(form.message)  # behind the last object each file has one more part, its closing bracket
    schema = pa.schema([("ordinal", pa.int64()), ("cells", pa.list_(pa.string())), ("open", pa.bool_()), ("text", pa.string())])

    def cut(whole: bool):
        """Records that begin and end in a block, or the fragments of others: with open set where one begins."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[str] = []
            n = odd = depth = 0
            head = first = False
            offset, header = 0, None

            def put(rows: list[dict], text: str) -> None:
                nonlocal n, head, first
                if head:
                    head = False
                    if not whole:
                        rows.append({"ordinal": offset, "cells": None, "open": False, "text": text})
                elif form.strict or text.strip("\r\n"):
                    got = form.rows_of(text, header, first)
                    if whole:
                        rows += ({"ordinal": offset + n + i, "cells": r, "open": None, "text": None} for i, r in enumerate(got))
                    n, first = n + len(got), False

            def left(rows: list[dict]) -> None:
                """What a block holds at its end: a record's first part, or all of the block within one."""
                if not held:
                    return
                text = form.separator.join(held)
                if odd or depth > 0:
                    if not whole:
                        rows.append({"ordinal": offset + (0 if head else n), "cells": [header or "", "first" if first else ""], "open": not head, "text": text + form.separator})
                elif form.strict and whole and text.strip():
                    form.rows_of(text, header, first)  # what stands after the last object
                held.clear()

            for b, new in _blocks_in(batches):
                rows: list[dict] = []
                if new:
                    left(rows)
                    one = b.slice(0, 1).to_pylist()[0]
                    n, odd, depth, head, offset, header, first = 0, one["odd"], one["depth"], one["open"], one["offset"], one["header"], one["start"] == 0
                quotes, outside, inside = form.counted(b.column("value"))
                side = (odd + np.cumsum(quotes)) % 2
                deep = depth + np.cumsum(np.where((side - quotes) % 2, inside, outside))
                values = b.column("value").to_pylist()
                ends = (side == 0) & ((deep == 0) if form.strict else True)
                at = 0
                for k in np.flatnonzero(ends).tolist():
                    held += values[at : k + 1]
                    text, at = form.separator.join(held), k + 1
                    held.clear()
                    put(rows, text)
                held += values[at:]
                odd, depth = int(side[-1]), int(deep[-1])
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=schema)
            rows = []
            left(rows)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return run

    out_schema = "ordinal long, cells array<string>, open boolean, text string"

    def over(which: DataFrame, whole: bool) -> DataFrame:
        if seen["n"] <= MOST_BLOCKS:
            return lines.join(F.broadcast(which), ["file", "start"]).mapInArrow(cut(whole), out_schema)
        numbered = lines.withColumn("nth", F.monotonically_increasing_id()).join(which.hint("merge"), ["file", "start"])
        run = cut(whole)
        by_block = lambda t: pa.Table.from_batches(list(run(iter(t.sort_by("nth").combine_chunks().to_batches()))), schema=schema)
        return numbered.groupBy("file", "start").applyInArrow(by_block, out_schema)

    columns = lambda df: df.select("ordinal", *(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(form.columns)))
    found = columns(over(blocks, True))
    if seen["open"]:
        pieces = over(blocks.where("open or ends_open"), False)
        # a record's parts follow each other; the rows of a cell across many blocks are as many as those blocks
        along = Window.partitionBy(F.lit(1)).orderBy("ordinal", F.col("open")).rowsBetween(Window.unboundedPreceding, 0)
        pieces = stored(pieces).withColumn("record", F.max(F.when(F.col("open"), F.col("ordinal"))).over(along))
        joined = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.expr("not open").alias("later"), "text"))), lambda x: x["text"])
        named = pieces.groupBy("record").agg(F.array_join(joined, "").alias("text"), F.max(F.when(F.col("open"), F.get("cells", F.lit(0)))).alias("header"), F.max(F.when(F.col("open"), F.get("cells", F.lit(1)))).alias("first"))

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [{"ordinal": r["record"], "cells": c, "open": None, "text": None} for r in b.to_pylist() for c in form.rows_of(r["text"], r["header"], r["first"] != "")]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        found = found.unionByName(columns(named.mapInArrow(parse, out_schema)))
    return found.withColumnRenamed("ordinal", ordinal) if ordinal else found.drop("ordinal")
