"""What the operators of this subpackage share: intermediate tables, table reading, word-cached tokenizing."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns the operators read, whatever else the table carries: doc_id and text, null text as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


class WordTokenizer:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit numbers, by a tokenizers file that drops white space.

    The tokenizer's own pre-tokenizer cuts a text into pieces that are encoded one by one, so a text's ids are the ids of its
    pieces in turn; each distinct piece goes through the library once and is kept. Where the file cuts by the pattern
    PIECES, and a text has only characters that it, NFC and lower-casing treat as Python does (none of ODD), the text is cut here into those
    very pieces. Any other text is cut at white space, which no piece crosses, and its words are kept instead.
    The caches are emptied at ``limit`` pieces or words.
    """

    SEPARATOR = "\x01"
    #: Fixed value: the split pattern of the tokenizer file for which PIECES stands.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The same in Python's words, for lower-cased texts without letters after Latin and numbers other than digits.
    LETTERS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
    PIECES = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|\d|[^\s0-9{LETTERS}]+")
    #: What such a text mustn't have: controls, superscripts and fractions, dotted capital I, anything after Latin; nor "<|", which begins special tokens.
    ODD = re.compile("[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]")

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.pieces = Tokenizer.from_file(path), limit, {"": b""}, {}
        ids = self._ids([self.SEPARATOR])[0]
        self.mark = ids[0] if len(ids) == 1 else None
        made = json.loads(self.tokenizer.to_str())
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        forms = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        suffix = made["model"].get("end_of_word_suffix")
        self.plain = cuts[0].get("pattern") == {"Regex": self.PATTERN} and forms == ["NFC", "Replace", "Lowercase"] and bool(suffix)
        if self.plain:  # the last id of every piece is one that ends a word
            self.last = np.zeros(max(made["model"]["vocab"].values()) + 1 + len(made["added_tokens"]), bool)
            self.last[[i for x, i in made["model"]["vocab"].items() if x.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, found: list[str], into: dict[str, bytes], between: str, ends_of) -> None:
        """Puts the ids of pieces, or of words without white space, into a cache: many in one text, cut where ``ends_of`` its ids says."""
        step = len(between) > 1
        alone = [w for w in found if step and (self.mark is None or self.SEPARATOR in w or "<|" in w)]
        joined = [w for w in found if not (step and (self.mark is None or self.SEPARATOR in w or "<|" in w))]
        runs = [joined[at : at + 1000] for at in range(0, len(joined), 1000)]
        for run, ids in zip(runs, self._ids([between.join(run) for run in runs])):
            ids = np.array(ids, dtype="<u4")
            ends = ends_of(ids)
            if len(ends) != len(run):
                alone += run
                continue
            data, start, skip = ids.tobytes(), 0, 4 * step
            for w, end in zip(run, (4 * ends).tolist()):
                into[w] = data[start:end]
                start = end + skip
        for w, ids in zip(alone, self._ids(alone)):
            into[w] = np.array(ids, dtype="<u4").tobytes()

    def _encode(self, cut: list[list[str]], known: dict[str, bytes], between: str, ends_of) -> list[bytes]:
        get, found, new = known.get, [], set()
        for parts in cut:
            ids = list(map(get, parts))
            missing = [i for i, x in enumerate(ids) if x is None]
            new.update([parts[i] for i in missing])
            found.append((ids, missing))
        self._learn(list(new), known, between, ends_of)
        for parts, (ids, missing) in zip(cut, found):
            for i in missing:
                ids[i] = known[parts[i]]
        return [b"".join(ids) for ids, _ in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {"": b""}
        if len(self.pieces) > self.limit:
            self.pieces = {}
        plain, odd = [], []
        for i, t in enumerate(texts):
            (odd if not self.plain or "<|" in t or self.ODD.search(t) else plain).append(i)
        out: list[bytes] = [b""] * len(texts)
        cut = [self.PIECES.findall(texts[i].lower()) for i in plain]
        for i, ids in zip(plain, self._encode(cut, self.pieces, " ", lambda ids: np.flatnonzero(self.last[ids]) + 1)):
            out[i] = ids
        words = [_SPACES.sub(" ", texts[i]).split(" ") for i in odd]
        for i, ids in zip(odd, self._encode(words, self.known, f" {self.SEPARATOR} ", lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)))):
            out[i] = ids
        return out


_SPACES = re.compile("[\t-\r]")


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker; it outlives a task."""
    return WordTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: list[str], chars: int = 1_000_000):
    """(from, to) runs of a batch holding about so many characters each, so that very long texts don't add up in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
