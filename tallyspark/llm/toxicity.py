"""Toxicity by a subsequence string kernel support vector machine with Nyström landmarks.

The kernel of two words sums over the subsequences of three letters they share, gaps allowed and weighed down by
``decay`` for each letter spanned, normalised to 1 for equal words, and is sharpened by a Gaussian of the distance it
defines; so inserted characters and changed endings keep a word near. A mark at its front lets a word's beginning count. Words are the runs between white space, lower-cased; marks in and around a word are dropped, and where they stand
inside, its parts are looked at as well; three or more single letters in a row are also looked at put together. A word of over 32 characters is looked at in overlapping pieces of 32, so that no part of it is left out.

A word's features are its kernel values to a few dozen landmark words, whitened by the landmarks' own kernel matrix (Nyström).
The machine is fitted on labelled texts by taking, in turns, each text's strongest word as its example
(multiple-instance learning), with squared hinge loss, and beside it copies of it with a letter put in, left out or doubled, made of the allowed texts' words
alone; clean texts' strongest words are copied so too. A text's score is a logistic function, fitted on the same texts, of the
margins of its four strongest words, so that one borderline word weighs less than several. Fitting reads at most ``bound`` labelled texts of each class, the first by a hash of doc_id; scoring reads
every whole text, and each worker keeps the margins of words it has met.

Null and empty texts, and texts without a piece of three letters, score 0. With fewer than FEWEST labelled texts that have pieces in either
class outside the held-out fold, nothing is fitted and every score is 0. Repeated rows are scored alike. Empty tables give no rows. Of the documents only doc_id
and text are read, and doc_id only for the fold; of several labels of one doc_id the highest holds, null ones don't count.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

ORDER, LONGEST, TOP = 3, 32, 4
#: Fewer labelled texts with words than this in either class, and nothing is fitted.
FEWEST = 5
#: How fast nearness falls with the kernel's distance; landmarks are less near to each other than ALIKE; each letter spanned counts DECAY.
SHARPNESS, ALIKE, FRONT, DECAY = 2.5, 0.4, "^", 0.8
#: Changed copies of a clean text's words that are learnt from, their share of the word's weight, and what clean texts weigh to toxic ones.
CLEAN_COPIES, SHARE, CLEAN_TO_TOXIC = 2, 0.5, 2.5


#: Three or more single letters in a row, a word spelt out.
_SPELT = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…–—"


def words_of(text: str) -> list[str]:
    """The runs between white space, lower-cased, and after them each run of three or more single letters put together."""
    text = text.lower()
    return text.split() + ["".join(x.split()) for x in _SPELT.findall(text)]


def pieces_of(word: str) -> list[str]:
    """What of a word is looked at: its letters and digits put together and, where marks stand between them, each run of them too."""
    core = word if word.isalnum() else word.strip(_MARKS)
    if core.isalnum():
        found = [core]
    else:
        runs = "".join(x if x.isalnum() else " " for x in word).split()
        found = list(dict.fromkeys(["".join(runs), *runs]))
    out = []
    for w in found:
        if len(w) > LONGEST:
            out += [FRONT * (i == 0) + w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
        elif len(w) >= ORDER:
            out.append(FRONT + w)
    return out


def changed(piece: str, most: int | None = None) -> list[str]:
    """Copies of a piece with a letter put in, left out (or starred) or doubled, at every inner place; or of them the ``most`` that a hash puts first."""
    front, body = (FRONT, piece[1:]) if piece[:1] == FRONT else ("", piece)
    made = [body[:i] + chr(97 + zlib.crc32(f"{piece}{i}".encode()) % 26) + body[i:] for i in range(1, len(body))]
    for i in range(1, len(body) - 1):
        made += [body[:i] + body[i + 1 :], body[:i] + body[i] + body[i:]]
    made = [w for w in dict.fromkeys(made) if ORDER <= len(w) and w != body]
    if most is not None:
        made = sorted(made, key=lambda w: zlib.crc32(w.encode()))[:most]
    return [front + w for w in made]


def codes_of(words: list[str]) -> np.ndarray:
    width = max(map(len, words), default=1) or 1
    return np.array([w.ljust(width, "\0") for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, 1), np.uint32)


@functools.lru_cache(maxsize=64)
def _places(n: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """The places (i < j < k) of all subsequences of three of n letters, and decay for each letter that they span."""
    at = np.array(list(combinations(range(n), ORDER)), np.int32).reshape(-1, ORDER).T
    return at, np.power(decay, at[2] - at[0] + 1.0)


class _Index:
    """The landmarks' subsequences of three letters, an inverted list for each: which landmarks have it, with what weight."""

    def __init__(self, landmarks: tuple[str, ...], decay: float):
        weight: dict[tuple[str, ...], dict[int, float]] = {}
        for m, word in enumerate(landmarks):
            at, spans = _places(len(word), decay)
            for i, j, k, x in zip(*at.tolist(), spans.tolist()):
                row = weight.setdefault((word[i], word[j], word[k]), {})
                row[m] = row.get(m, 0.0) + x
        norm = np.zeros(len(landmarks))
        for row in weight.values():
            for m, x in row.items():
                norm[m] += x * x
        self.letters = np.array(sorted({ord(x) for t in weight for x in t}), np.uint32)
        place, self.base = {chr(x): i for i, x in enumerate(self.letters.tolist())}, len(self.letters) + 1
        self.table = np.full(self.base**ORDER, -1, np.int32)
        self.first = np.zeros(len(weight) + 1, np.int64)
        owner, value = [], []
        for row, (t, lists) in enumerate(weight.items()):
            self.table[(place[t[0]] * self.base + place[t[1]]) * self.base + place[t[2]]] = row
            owner += lists
            value += [x / norm[m] ** 0.5 for m, x in lists.items()]
            self.first[row + 1] = len(owner)
        self.owner, self.value, self.size = np.array(owner, np.int64), np.array(value), len(landmarks)

    def products(self, w: np.ndarray, decay: float) -> np.ndarray:
        """Of words of one length, the kernel with each landmark, normalised on the landmark's side."""
        at, spans = _places(w.shape[1], decay)
        place = np.searchsorted(self.letters, w)
        letter = np.where(self.letters[np.minimum(place, len(self.letters) - 1)] == w, place, self.base - 1)
        row = self.table[(letter[:, at[0]] * self.base + letter[:, at[1]]) * self.base + letter[:, at[2]]].ravel()
        hit = np.flatnonzero(row >= 0)
        row, word, x = row[hit], hit // len(spans), spans[hit % len(spans)]
        many = self.first[row + 1] - self.first[row]
        spot = np.repeat(self.first[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(word * self.size, many) + self.owner[spot]
        return np.bincount(cell, self.value[spot] * np.repeat(x, many), len(w) * self.size).reshape(len(w), self.size)


@functools.lru_cache(maxsize=8)
def _index(landmarks: tuple[str, ...], decay: float) -> _Index:
    return _Index(landmarks, decay)


def kernel(words: list[str], landmarks: list[str], decay: float = DECAY) -> np.ndarray:
    """The normalised subsequence kernel of every word with every landmark.

    Each word's subsequences are looked up among the landmarks', words of one length at a time; those that no landmark has, most
    of them, cost no more than the lookup.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    index = _index(tuple(landmarks), decay)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, which in by_length.items():
        if n < ORDER or not len(index.letters):
            continue
        step = max(1, 50_000 // len(_places(n, decay)[1]))
        for a in range(0, len(which), 4096):
            some = np.array(which[a : a + 4096])
            w = codes_of([words[i] for i in some.tolist()])
            own = np.sqrt(np.maximum(_self_kernel(w, decay), 1e-12))[:, None]
            for b in range(0, len(some), step):
                out[some[b : b + step]] = index.products(w[b : b + step], decay) / own[b : b + step]
    return out


def nearness(words: list[str], landmarks: list[str], decay: float = DECAY) -> np.ndarray:
    """1 for equal words, falling to exp(-2 * SHARPNESS) for words that share no subsequence."""
    return np.exp(-2 * np.float32(SHARPNESS) * (1 - kernel(words, landmarks, decay)))


def _self_kernel(w: np.ndarray, decay: float) -> np.ndarray:
    n, width = w.shape
    partial, total, square = np.zeros((ORDER - 1, width + 1, n), np.float32), np.zeros(n, np.float32), np.float32(decay * decay)
    for i in range(width):
        same = [((w[:, i] == w[:, j]) & (w[:, i] != 0)).astype(np.float32) * square for j in range(width)]
        for j in range(width):
            total += same[j] * partial[ORDER - 2, j]
        for q in range(ORDER - 2, -1, -1):
            run = np.zeros(n, np.float32)
            for j in range(width):
                run *= np.float32(decay)
                run += same[j] * partial[q - 1, j] if q else same[j]
                partial[q, j + 1] *= np.float32(decay)
                partial[q, j + 1] += run
    return total


@dataclass
class ToxicityModel:
    """landmarks, their weights and the bias for words; slopes (for the TOP strongest words) and offset for texts."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray | None = None
    offset: float = 0.0
    decay: float = DECAY

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        return nearness(pieces, self.landmarks, self.decay) @ self.weights.astype(np.float32) + np.float32(self.bias)

    def strongest(self, texts: list[str], known: dict[str, float], value: dict[str, float] | None = None) -> np.ndarray:
        """The margins of each text's TOP strongest words, falling; minus infinity where there are fewer words with pieces. known, value: margins of words and of pieces met so far."""
        value = {} if value is None else value
        split = [words_of(t) for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new -= known.keys()
        cut = {w: pieces_of(w) for w in new}
        ask = sorted({p for ps in cut.values() for p in ps} - value.keys())
        value.update(zip(ask, self.of_pieces(ask).tolist()))
        for w, ps in cut.items():
            known[w] = max([value[p] for p in ps], default=-np.inf)
        out = np.full((len(texts), TOP), -np.inf)
        for i, words in enumerate(split):
            if words:
                m = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                m = np.sort(np.partition(m, len(m) - TOP)[-TOP:] if len(m) > TOP else m)[::-1]
                out[i, : len(m)] = m
        return out

    def score(self, strongest: np.ndarray) -> np.ndarray:
        """0 for a text without pieces; missing words count as the bare bias."""
        margins = np.where(np.isneginf(strongest), self.bias, strongest)
        likely = 1.0 / (1.0 + np.exp(-np.clip(margins @ self.slopes + self.offset, -60, 60)))
        return np.where(np.isneginf(strongest[:, 0]), 0.0, likely)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_words(docs: DataFrame, labels: DataFrame, bound: int, pieces: int = 20_000) -> list[tuple[int, str, bytes]]:
    """(label, distinct word pieces separated by spaces, their counts up to TOP) of at most ``bound`` labelled texts of each class outside the held-out fold.

    A doc_id stands for one of its texts, the first by a hash, and of a very long text at most ``pieces`` distinct pieces count, also the first by a hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t in b["text"]:
                count = Counter(p for w in words_of(t) for p in pieces_of(w))
                if len(count) > pieces:
                    count = {p: count[p] for p in sorted(count, key=lambda p: zlib.crc32(p.encode("utf-8", "replace")))[:pieces]}
                found.append(count)
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "at": b["at"], "words": [" ".join(f) for f in found], "counts": [bytes(min(n, TOP) for n in f.values()) for f in found]})

    cut = common.texts_of(docs).join(F.broadcast(ids), "doc_id").withColumn("at", F.xxhash64("text")).mapInPandas(distinct, "doc_id long, toxic int, at long, words string, counts binary")
    rows = cut.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "words", "counts"), F.struct("at", "words")).alias("row")).select("doc_id", "row.*").collect()
    return [(r.toxic, r.words, bytes(r.counts)) for r in sorted(rows, key=lambda r: (r.doc_id, r.words))]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps (signs y are -1 or 1)."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x1.shape[1]), ridge * np.eye(x1.shape[1])
    keep[-1, -1] = 1e-8
    for _ in range(rounds):
        live = y * (x1 @ w) < 1
        a = x1[live] * weight[live, None]
        new = np.linalg.solve(keep + a.T @ x1[live] / weight.sum(), a.T @ y[live] / weight.sum())
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _weights(docs: list[np.ndarray], hashes: int = 32) -> np.ndarray:
    """One over the number of texts that share about a third of a text's pieces, itself included: near copies count once. By least hashes; texts are few (the bound)."""
    mixed = np.random.default_rng(1).integers(1, 1 << 62, hashes, dtype=np.uint64) | np.uint64(1)
    least = np.full((len(docs), hashes), np.iinfo(np.uint64).max, np.uint64)
    for i, d in enumerate(docs):
        if len(d):
            h = (d.astype(np.uint64)[:, None] + np.uint64(1)) * mixed
            least[i] = ((h ^ (h >> np.uint64(31))) * mixed).min(axis=0)
    same = np.zeros((len(docs), len(docs)), np.int16)
    for k in range(hashes):
        same += least[:, k][:, None] == least[:, k]
    return 1.0 / (same >= hashes // 3).sum(axis=1)


def fit(rows: list[tuple[int, str, bytes]], landmarks: int = 72, turns: int = 5) -> ToxicityModel | None:
    at: dict[str, int] = {}
    docs = [np.array([at.setdefault(w, len(at)) for w in words.split()], dtype=np.int32) for _, words, _ in rows]
    y = np.array([2.0 * v - 1 for v, _, _ in rows])
    worded = np.array([len(d) > 0 for d in docs], bool)
    if min(np.count_nonzero(worded & (y > 0)), np.count_nonzero(worded & (y < 0))) < FEWEST:
        return None
    words = list(at)
    del at
    worth = _weights(docs)
    have = [np.bincount(np.concatenate([d for d, v in zip(docs, y) if v == sign] or [np.zeros(0, np.int32)]), np.concatenate([np.full(len(d), w) for d, v, w in zip(docs, y, worth) if v == sign] or [np.zeros(0)]), len(words)) for sign in (-1, 1)]
    odds = np.log((have[1] + 0.5) / (worth[y > 0].sum() + 1)) - np.log((have[0] + 0.5) / (worth[y < 0].sum() + 1))
    name = np.array(words)
    telling = [words[i] for i in np.lexsort((name, -have[1] * odds))[: 40 * landmarks] if have[1][i] >= 2]
    chosen: list[str] = []
    for at in range(0, len(telling), 64):
        if len(chosen) >= landmarks * 8 // 9:
            break
        some = telling[at : at + 64]
        near = nearness(some, chosen + some)
        picked = np.arange(len(chosen) + len(some)) < len(chosen)
        for i, w in enumerate(some):
            if len(chosen) < landmarks * 8 // 9 and not (near[i] >= ALIKE)[picked].any():
                picked[len(picked) - len(some) + i] = True
                chosen.append(w)
    chosen += [w for w in (words[i] for i in np.lexsort((name, -have[0]))[: 2 * landmarks]) if w not in chosen][: landmarks - len(chosen)]
    del name
    value, vector = np.linalg.eigh(nearness(chosen, chosen).astype(np.float64))
    whiten = vector / np.sqrt(np.maximum(value, 1e-3))
    z = np.empty((len(words), len(chosen)), np.float32)
    for i in range(0, len(words), 20_000):
        z[i : i + 20_000] = nearness(words[i : i + 20_000], chosen) @ whiten.astype(np.float32)
    strength, negatives = odds * np.log1p(have[1]), [set() for _ in rows]
    copies: dict[int, np.ndarray] = {}

    def learn(found: set[int], most: int | None) -> None:
        """Features of the changed copies of words."""
        new = sorted(found - copies.keys())
        made = [changed(words[w], most) for w in new]
        every = [c for m in made for c in m]
        features, at = (nearness(every, chosen) @ whiten.astype(np.float32) if every else np.zeros((0, len(chosen)), np.float32)), 0
        for w, m in zip(new, made):
            copies[w], at = features[at : at + len(m)], at + len(m)

    for turn in range(turns):
        strongest = [int(d[np.argmax(strength[d])]) if len(d) else -1 for d in docs]
        for i, d in enumerate(docs):
            if y[i] < 0 and len(d):
                negatives[i].update(map(int, d[np.argsort(-strength[d])[:3]]))
        learn({w for w, v in zip(strongest, y) if v > 0 and w >= 0}, None)
        learn(set().union(*negatives), CLEAN_COPIES)
        sample, sign, weight = [], [], []
        for i, d in enumerate(docs):
            if not len(d):
                continue
            if y[i] > 0:  # a text whose strongest word stays weak may be labelled wrongly, and counts less
                picked, most, share = [strongest[i]], None, worth[i] * (1.0 if turn == 0 else float(np.clip((strength[strongest[i]] + 1) / 2, 0.02, 1)))
            else:
                picked, most, share = sorted(negatives[i]), CLEAN_COPIES, worth[i]
            for w in picked:
                other = copies[w][:most]
                sample += [z[w : w + 1], other]
                sign += [y[i]] * (1 + len(other))
                weight += [share / len(picked) * (1 - SHARE if len(other) else 1)] + [share / len(picked) * SHARE / max(len(other), 1)] * len(other)
        # a word that is near no landmark is clean, also where the sample has none such
        sample, sign, weight = [*sample, np.zeros((1, len(chosen)), np.float32)], [*sign, -1.0], [*weight, 0.3 * sum(weight)]
        u, bias = _svm(np.concatenate(sample).astype(np.float64), np.array(sign), np.array(weight))
        strength = z @ u.astype(np.float32) + np.float32(bias)
    model = ToxicityModel(chosen, whiten @ u, bias)
    tops, toxic = [], []
    learn({int(w) for d, v in zip(docs, y) if v > 0 for w in d[strength[d] > 0]}, None)
    for i, (d, (_, _, counts)) in enumerate(zip(docs, rows)):
        for anew in (False, True):  # toxic texts once more, as they would be with each of their insults changed; clean ones weigh as much as before
            m = strength[d].copy()
            if anew and y[i] > 0:
                for k in np.flatnonzero(m > 0).tolist():
                    if len(copies[int(d[k])]):
                        m[k] = np.median(copies[int(d[k])] @ u.astype(np.float32)) + bias
            m = np.sort(np.repeat(m, np.frombuffer(counts, np.uint8)))[::-1][:TOP]
            tops.append(np.append(m, np.full(TOP - len(m), bias)))
            toxic.append(y[i] > 0)
    for _ in range(len(rows) // 5 + 1):  # and so is a text of such words
        tops.append(np.full(TOP, bias))
        toxic.append(False)
    toxic = np.array(toxic)
    # the sample's mixture isn't the corpus's: clean texts weigh CLEAN_TO_TOXIC times as much as toxic ones, however many there are of each
    model.slopes, model.offset = _logistic(np.array(tops), toxic, np.where(toxic, 1 / toxic.sum(), CLEAN_TO_TOXIC / (~toxic).sum()) * len(toxic) / (1 + CLEAN_TO_TOXIC))
    return model


def _logistic(x: np.ndarray, positive: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps, with Platt's smoothed targets."""
    p, q = positive.sum(), (~positive).sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (q + 2))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x1.shape[1]), ridge * weight.sum() * np.eye(x1.shape[1])
    keep[-1, -1] = 1e-9
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x1 @ w, -60, 60)))
        step = np.linalg.solve((x1 * (weight * np.maximum(s * (1 - s), 1e-9))[:, None]).T @ x1 + keep, x1.T @ (weight * (s - target)) + keep @ w)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, bound: int = 1000) -> ToxicityModel | None:
    return fit(labelled_words(docs, labels, bound))


#: Margins by word and by piece, for the model last used in this worker; emptied when they have grown to their limits.
_known: dict = {"model": None, "words": {}, "pieces": {}}


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = 1000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, bound)
    scored = common.texts_of(docs).select("doc_id", _score_udf(model)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = 1000) -> DataFrame:
    """The documents scored below the threshold, columns as they were. Scoring travels beside the row, so any column may be null."""
    model = train(docs, labels, bound)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where(_score_udf(model)("text") < threshold).select("row.*")


def _score_udf(model: ToxicityModel | None, words: int = 300_000, pieces: int = 1_000_000):
    stamp = None if model is None else (tuple(model.landmarks), model.bias, model.weights.tobytes())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        if model is not None:
            if _known["model"] != stamp:
                _known.update(model=stamp, words={}, pieces={})
            every = texts.tolist()
            for i, j in common.slices(every):
                if len(_known["words"]) > words:
                    _known["words"] = {}
                if len(_known["pieces"]) > pieces:
                    _known["pieces"] = {}
                out[i:j] = model.score(model.strongest(every[i:j], _known["words"], _known["pieces"]))
        return pd.Series(out)

    return score


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
