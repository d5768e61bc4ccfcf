"""Unigram segmentation over the pieces of a SentencePiece model: count-only Viterbi, and N-best encoding and decoding.

Normalisation: runs of white space (space, tab to carriage return) become one ``▁``, one stands before the first word and none at the end. The
pieces of the model that are neither control, unknown nor byte pieces make a unigram vocabulary with the model's
scores. No piece has ``▁`` after another character, so a text's segmentations are those of its words put together;
each worker keeps what it has worked out for a word.

Ties, as in the unigram tokenizers: at each place the first of the best candidates wins, candidates being tried by
where they begin, leftmost first, an unknown character last; unknown characters score 10 less than the worst piece, only
where no piece is the single character itself, and neighbouring ones count as one token.

Null texts count as empty; texts without words have no tokens, score 0. Words over ``LONG`` characters are worked out each time
rather than kept. Repeated rows give equal results; empty tables no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

SPACE, LONG, INF = "▁", 64, float("inf")
_HEAD = struct.Struct("<dd")


def _ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """The vocabulary of a SentencePiece model file as an Aho-Corasick automaton."""

    def __init__(self, path: str, limit: int = 800_000, records: int = 600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.most_records, self.size = limit, records, model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = {self.pieces[i]: i for i in range(self.size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.scores: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or SPACE in piece.lstrip(SPACE):
                continue
            self.scores[piece] = model.get_score(i)
            self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
        self.automaton.make_automaton()
        self.unknown_score = min(self.scores.values()) - 10.0
        self.counts: dict[str, tuple[int, float]] = {}
        self.single: dict[str, bytes] = {}
        self.options: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.packed = [_ids_bytes([i]) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if p in self.byte_ids else p.replace(SPACE, " ").encode() for p in self.pieces]

    def edges(self, word: str) -> list[list[tuple[int, float, int]]]:
        """For each end of a piece (1 to len): (start, score, id), leftmost start first; an unknown character's id is -1."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        for last, (n, score, i) in self.automaton.iter(word):
            ends[last + 1].append((last + 1 - n, score, i))
        for end in range(1, len(ends)):
            if not ends[end] or ends[end][-1][0] != end - 1:
                ends[end].append((end - 1, self.unknown_score, -1))
        return ends

    def count(self, word: str) -> tuple[int, float]:
        """Token count and score of the best segmentation of ``▁word``: dynamic programming that carries nothing else."""
        n = len(word) + 1
        best, pieces, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = self.edges(SPACE + word)
        for end in range(1, n + 1):
            top = None
            for start, score, i in ends[end]:
                value = best[start] + score
                if top is None or value > top:
                    top, best[end] = value, value
                    pieces[end] = pieces[start] + (0 if i < 0 and loose[start] else 1)
                    loose[end] = i < 0
        return pieces[n], best[n]

    def _ids(self, text: str, start: int, i: int) -> list[int]:
        return [i] if i >= 0 else [self.byte_ids.get(f"<0x{b:02X}>", self.unknown) for b in text[start].encode("utf-8", "surrogatepass")]

    def viterbi(self, word: str) -> bytes:
        """Of ``▁word``: the best segmentation's score, what the second best loses against it (infinite if there is none), and its ids, packed."""
        return self.viterbi_all([word])[0]

    def viterbi_all(self, words: list[str]) -> list[bytes]:
        """``viterbi`` of each word. What a place can score depends only on what stands before it, so a word begins where it leaves the one before: sorted words share most places."""
        forward, second, spelt, before, out = [0.0], [-INF], [b""], "", []
        find, unknown = self.automaton.iter, (1, self.unknown_score, -1)
        for word in words:
            text, at = SPACE + word, 0
            for a, b in zip(text, before):
                if a != b:
                    break
                at += 1
            del forward[at + 1 :], second[at + 1 :], spelt[at + 1 :]
            ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(text) - at)]
            for last, piece in find(text):
                if last >= at:
                    ends[last - at].append(piece)
            for end, found in enumerate(ends, at + 1):
                if not found or found[-1][0] != 1:
                    found.append(unknown)
                top = other = -INF
                step = took = 0
                for n, score, i in found:
                    value = forward[end - n] + score
                    if value > top:
                        top, other, step, took = value, top, n, i
                    elif value > other:
                        other = value
                    value = second[end - n] + score
                    if value > other:
                        other = value
                forward.append(top)
                second.append(other)
                spelt.append(spelt[end - step] + (self.packed[took] if took >= 0 else _ids_bytes(self._ids(text, end - 1, took))))
            before = text
            out.append(_HEAD.pack(forward[-1], forward[-1] - second[-1]) + spelt[-1])
        return out

    def best(self, word: str, n_best: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of ``▁word`` as (score, ids): forward Viterbi scores, then backward A* search.

        A hypothesis covers the word from some place to its end; the forward score of that place is exactly the best that can
        still come, so complete hypotheses leave the queue in order of their score. Ties: the one that reaches further back, then the one made first.
        """
        text = SPACE + word
        ends = self.edges(text)
        forward = [0.0] * (len(text) + 1)
        for end in range(1, len(forward)):
            forward[end] = max(forward[start] + score for start, score, _ in ends[end])
        queue, made, out = [(-forward[-1], len(text), 0, 0.0, None)], 0, []
        while queue and len(out) < n_best:
            _, place, _, behind, path = heapq.heappop(queue)
            if place == 0:
                ids: list[int] = []
                while path is not None:
                    start, i, path = path
                    ids += self._ids(text, start, i)
                out.append((behind, np.array(ids, "<u4").tobytes()))
                continue
            for start, score, i in ends[place]:
                made += 1
                heapq.heappush(queue, (-(forward[start] + score + behind), start, made, score + behind, (start, i, path)))
        return out

    def records(self, cut: list[list[str]]) -> list[list[bytes]]:
        """``viterbi`` of the words of each text. Each word's is kept, in a record of some 80 bytes; new ones are worked out together."""
        known = self.single
        if len(known) > self.most_records:
            known.clear()
        found, new = [], set()
        for words in cut:
            got = list(map(known.get, words))
            missing = [k for k, x in enumerate(got) if x is None]
            new.update([words[k] for k in missing])
            found.append((got, missing))
        order = sorted(new)
        made = dict(zip(order, self.viterbi_all(order)))
        for words, (got, missing) in zip(cut, found):
            for k in missing:
                got[k] = made[words[k]]
        known.update((w, x) for w, x in made.items() if len(w) <= LONG)
        return [got for got, _ in found]

    def options_of(self, word: str, n_best: int) -> list[tuple[float, bytes]]:
        """``best``, kept for the words that are asked for again and again: those whose second best loses least."""
        got = self.options.get((word, n_best))
        if got is None:
            got = self.best(word, n_best)
            if len(word) <= LONG:
                if len(self.options) >= 20_000:
                    self.options.clear()
                self.options[word, n_best] = got
        return got

    def nbest_all(self, cut: list[list[str]], n_best: int) -> list[list[tuple[float, bytes]]]:
        """The n best segmentations of each text, given as its words."""
        out = []
        for words, found in zip(cut, self.records(cut)):
            if not words:
                out.append([(0.0, b"")])
                continue
            # one buffer of all records; a head takes as much as four ids
            data = np.frombuffer(b"".join(found), "<u4")
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
            at = np.empty_like(ends)
            at[0], at[1:] = 0, ends[:-1]
            head = (at[:, None] + np.arange(4)).ravel()
            heads, ids = data[head].view("<f8").reshape(-1, 2), np.ones(len(data), bool)
            ids[head] = False
            places = np.append(at, len(data)) - 4 * np.arange(len(at) + 1)  # where each word's ids begin in the text's, and the end
            out.append(combine(heads[:, 0], heads[:, 1], data[ids].tobytes(), places, lambda k, n: self.options_of(words[k], n), n_best))  # noqa: B023
        return out

    def nbest_of(self, words: list[str], n_best: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text of these words."""
        return self.nbest_all([words], n_best)[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces put together, byte pieces as UTF-8, ``▁`` as space, without the one at the front."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[str]:
    """Runs of what isn't a space, tab, line feed, vertical tab, form feed or carriage return."""
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score: how many unigram tokens each whole text has, and the score of that segmentation."""
    path = model or default_model()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces_of(path)
        known = vocabulary.counts
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                if len(known) > vocabulary.limit:
                    known.clear()
                words, n, total = words_of(text), 0, 0.0
                for w in words:
                    got = known.get(w)
                    if got is None:
                        got = vocabulary.count(w)
                        if len(w) <= LONG:
                            known[w] = got
                    n += got[0]
                    total += got[1]
                rows.append((None if pd.isna(key) else int(key), n, total))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "score"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return common.texts_of(docs).mapInPandas(each, "doc_id long, n_tokens long, score double")


ENCODED = "doc_id long, ids array<array<int>>, scores array<double>"


def combine(scores: np.ndarray, gaps: np.ndarray, first: bytes, places: np.ndarray, options_of: Callable[[int, int], list[tuple[float, bytes]]], n_best: int) -> list[tuple[float, bytes]]:
    """The n best of a text: scores and gaps (what a word's second best loses) of its words, the best ids of all, and at which of them each word's begin and the last one's end; options_of(k, n) gives word k's n best.

    At most n_best - 1 words can differ from their best within the n best, and they are among those with the smallest
    gap (in ties the earlier word): only those are searched further. Their losses are merged best first.
    """
    near = np.flatnonzero(gaps <= np.partition(gaps, n_best - 2)[n_best - 2]) if 1 < n_best <= len(gaps) else np.arange(len(gaps))
    chosen = sorted(near[np.argsort(gaps[near], kind="stable")][: n_best - 1].tolist())
    options = {k: options_of(k, n_best) for k in chosen if gaps[k] < INF}
    merged: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for some in options.values():
        merged = sorted((loss + some[0][0] - s, picks + (i,)) for loss, picks in merged for i, (s, _) in enumerate(some))[:n_best]
    best, out = float(scores.sum()), []
    for loss, picks in merged:
        parts, done = [], 0
        for (k, some), i in zip(options.items(), picks):
            parts += first[done : 4 * int(places[k])], some[i][1]
            done = 4 * int(places[k + 1])
        out.append((best - loss, b"".join([*parts, first[done:]])))
    return out


def encode_nbest(docs: DataFrame, n_best: int = 3, model: str | None = None) -> DataFrame:
    """doc_id, ids (the n best segmentations of each whole text, best first), scores. Fewer where a text has fewer."""
    path = model or default_model()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(path)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in common.slices(texts):
                done = vocabulary.nbest_all([words_of(t) for t in texts[a:b]], n_best)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *_columns(done)], ["doc_id", "ids", "scores"])

    return common.texts_of(docs).mapInArrow(each, ENCODED)


def _columns(done: list[list[tuple[float, bytes]]]) -> tuple[pa.Array, pa.Array]:
    """ids and scores of some texts, made from their bytes: as Python lists the ids would take half as long as finding them, and ten times the memory."""
    ids = [x for some in done for _, x in some]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    each = pa.ListArray.from_arrays(ends(len(x) // 4 for x in ids), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    texts = ends(map(len, done))
    return pa.ListArray.from_arrays(texts, each), pa.ListArray.from_arrays(texts, pa.array([x for some in done for x, _ in some], pa.float64()))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text: what the first of ``ids`` says."""
    path = model or default_model()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces_of(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [vocabulary.decode(np.asarray(x, dtype=np.int64)) for x in batch["best"]]})

    return encoded.select("doc_id", F.get("ids", F.lit(0)).alias("best")).mapInPandas(each, "doc_id long, text string")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))


def op3_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_found, scores, ids_crc32 (of each segmentation), text_crc32 (of the text decoded from the best one)."""
    encoded = encode_nbest(common.table(spark, sf_dir, "documents"))
    path = default_model()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces_of(path)
        for batch in batches:
            rows = []
            for some in batch["ids"]:  # text by text: a batch's ids stand in memory once
                ids = [np.asarray(x, dtype="<u4") for x in some]
                rows.append((len(ids[0]), len(ids), [common.crc32(x) for x in ids], common.crc32(vocabulary.decode(ids[0]).encode("utf-8", "surrogatepass"))))
            out = pd.DataFrame(rows, columns=["n_pieces", "n_found", "ids_crc32", "text_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            out.insert(3, "scores", batch["scores"])
            yield out

    return encoded.mapInPandas(digest, "doc_id long, n_pieces long, n_found int, scores array<double>, ids_crc32 array<long>, text_crc32 long")
